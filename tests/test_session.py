import subprocess
import sys

from quern import session


def test_executors_get_the_library_whatever_the_folder(tmp_path):
    """A driver that finds the library by its own path only still runs Python on executors."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from quern.session import session, ship
spark = session("local[2]", **{{"spark.ui.enabled": "false"}})
ship(spark)
from quern.operators import linear
assert linear.covariance(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v").count() == 4
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_intermediate_tables_are_cleared(spark):
    import os

    session.clear(spark)
    paths = [session.shared_dir(spark, "x") for _ in range(3)]
    kept = [session.stored(spark.range(5), f"{p}/rows") for p in paths[:2]]
    assert [r.count() for r in kept] == [5, 5] and session.clear(spark) == 3 and session.clear(spark) == 0
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)

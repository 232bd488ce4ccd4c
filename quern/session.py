"""A session with the settings that the library's plans expect, and the library on its executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
_SHIPPED: set[str] = set()
#: The local folder of each application whose settings name no shared one.
_LOCAL: dict[str, str] = {}
#: The folders of intermediate tables that each application has made.
_MADE: dict[str, list[str]] = {}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("quern")
    if master:
        builder = builder.master(master)
    spark = builder.config(map=SETTINGS | settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the library's sources to the application's executors, once; Spark sends them the file."""
    application = spark.sparkContext.applicationId
    package = Path(__file__).resolve().parent
    if application in _SHIPPED or not package.is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a local one only in local mode, where that is unset.

    It is a full address, so that Spark and the files that tasks write themselves mean the same place.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(context.applicationId)
    if not base:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", context.master):
            raise ValueError(f"spark.checkpoint.dir is unset: on {context.master}, driver and executors need a folder that they share")
        base = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quern-")
    path = context._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    made = f"{re.sub('^file:/+', 'file:///', whole).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(context.applicationId, []).append(made)
    return made


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this application has made so far, and returns how many folders there were.

    Results are read from them when an action asks for it, so they must have been written or collected before.
    """
    context = spark.sparkContext
    made = _MADE.pop(context.applicationId, [])
    for folder in made:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path as Parquet and read again: lineage ends there, and lost executors cost no rework before it."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

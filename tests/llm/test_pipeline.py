"""The pipeline against a plain version, stage by stage."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import credentials, encoders, packing
from tests.llm.test_operators import brute_jaccard, brute_winnow, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    passage = prose(50, 15)
    rows = [(i, prose(i, 60), "en", "a", 1) for i in range(12)]
    rows += [(20, prose(3, 60), "en", "b", 1), (21, prose(3, 60) + " tail", None, "b", None), (22, prose(90, 20) + " " + passage, "en", None, 2)]
    rows += [(23, None, "en", "a", 0), (24, "1234 !!", None, "a", 7), (25, "", "en", "a", 0), (26, prose(77, 30) + " password=abcdefgh12345 end", "en", "a", 3)]
    rows += [(5, "another text with the id of five " + prose(78, 30), "en", "a", 3), (5, prose(5, 60), "en", "a", 1), (None, prose(79, 20), "en", "a", 1), (None, prose(79, 20), "en", "a", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, [(1, passage)]


def test_run(spark, folder):
    path, rows, items = folder
    letters = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    with_id = [r for r in letters if r[0] is not None]
    component = {tuple(x[:1]): x[2] for x in brute_jaccard([(r[0], r[1]) for r in with_id])}
    firsts = {i for (i,), c in component.items() if c == i}
    bad = {x[0] for x in brute_winnow([(r[0], r[1]) for r in letters], items) if x[-1]}
    got = corpus_pipeline.run(spark, path).collect()
    kept = {r.doc_id for r in got}
    assert kept == (firsts - bad) | {None} and 20 not in kept and 21 not in kept and 22 not in kept
    import public_tokenizers

    encoder = encoders.Encoder(public_tokenizers.path("byte_bpe_50k.json"), packing.END)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.ids))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    texts = {r[0]: r[1] for r in letters if r[0] != 5}
    for i, rows_ in pieces.items():
        ids = [x for _, part in sorted(rows_) for x in part]
        if i != 5:
            want = credentials.redacted(texts[i], credentials.scan(texts[i]))
            assert ids == [*encoder.whole([want])[0], packing.END]
    assert "abcdefgh12345" not in encoder.tokenizer.decode([x for _, part in sorted(pieces[26]) for x in part])


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), path).count() == 0


def test_rows_without_an_id_or_with_a_shared_one_are_judged_by_their_own_text(spark, folder):
    path, _, [(_, passage)] = folder
    dirty = prose(200, 20) + " " + passage
    rows = [(None, dirty), (None, prose(201, 40)), (7, dirty), (7, prose(202, 40)), (8, prose(203, 40)), (8, prose(204, 60)), (9, prose(204, 60)), (None, prose(203, 40) + " end"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, path).collect()}
    assert got == {r for r in rows if r[1] != dirty}
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, path).collect()), key=repr)
    gone = {(None, dirty), (9, prose(204, 60)), (None, prose(203, 40) + " end")}
    assert got == sorted((r for r in rows if r not in gone), key=repr)

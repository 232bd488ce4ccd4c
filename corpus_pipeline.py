"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents:

1. language: documents whose language the model cannot tell go: those without a letter, and those whose best language has
   less than MIN_SCORE of the words' probability. `lang` becomes the prediction.
2. near duplicates: of each group of documents linked by n-gram Jaccard similarity, the one with the smallest id stays;
   rows without an id come last, and of equal ids the least hash of the text decides.
3. decontamination: documents that contain a benchmark window go.
4. secrets: credentials in the text are replaced by [REDACTED], and `n_chars` follows; no document goes.
5. packing: every remaining text as pieces of sequences of token ids.

Defined results: rows that share an id, or have none, are documents of their own, judged by their own text; of rows with
equal texts one stays at stage 2, and every text without words; a null text has no language and goes at stage 1; an empty
table stays empty; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, credentials, decontaminate, jaccard_join, language_id, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a document's words that its best language must reach; clean documents of a learned language are near 1.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with the language predicted."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs, model, list(COLUMNS))
    kept = found.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group, that with the least id, and all that link with nothing."""
    # rows go by a number of their own; stored, as another run may number otherwise
    rows = common.stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), f"{common.shared_dir(spark, 'rows')}/rows")
    found = jaccard_join.near_duplicates(rows, "__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row").alias("order")
    firsts = rows.select("__row", order).join(found, "__row").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(firsts.select("order.__row"), "__row", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.select(*COLUMNS, F.sha2(own, 256).alias("__row"))
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row")
    return rows.join(found.filter("contaminated").select("__row").distinct(), "__row", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its credentials redacted."""
    found = credentials.link_credentials(docs, ["doc_id", "lang", "source"], redact="text")
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: Language identification and packing cannot be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    path = common.shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"{path}/{i}-{name}")
    return docs

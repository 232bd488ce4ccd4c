"""The queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import clustering, common, conversations, credentials, decontaminate, embedding_dedup, jaccard_join, language_id, oracles, packing, substring_dedup, suffix_dedup, token_index, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, "page_id", "html", "url")
    return warc.payload_digests(warc.read(spark, path, data=False))


def op3_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), vocabulary=49_408)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_index": op2_token_index,
    "op3_credentials": op3_credentials,
    "op4_packing": op4_packing,
    "op5_language": op5_language,
    "op6_suffixes": op6_suffixes,
    "op7_embeddings": op7_embeddings,
    "op8_substrings": op8_substrings,
    "op9_decontaminate": op9_decontaminate,
    "op10_jaccard": op10_jaccard,
    "op11_conversations": op11_conversations,
    "op12_balls": op12_balls,
    "op13_toxicity": op13_toxicity,
}
ORACLES = {
    "op1_warc": oracles.WARC,
    "op6_suffixes": oracles.SUFFIXES,
    "op7_embeddings": oracles.EMBEDDINGS,
    "op8_substrings": oracles.SUBSTRINGS,
    "op9_decontaminate": oracles.WINNOW,
    "op10_jaccard": oracles.JACCARD,
    "op11_conversations": oracles.CONVERSATIONS,
    "op12_balls": oracles.BALLS,
}

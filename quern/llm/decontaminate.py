"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is `WINDOW` consecutive words of an item, or the whole of a shorter item. Its fingerprint is the least hash of the
word GRAM-grams in it, so any document span equal to a window has the window's fingerprint: no shared span is missed.

1. Each document's distinct fingerprints are joined with the benchmark's; a document that meets one is a candidate.
2. In candidates, the windows with a shared fingerprint are extended to their whole words and joined with the benchmark's
   windows by these words, which leaves exact hits only.
3. Hits of a document are joined into covered stretches.

The benchmark's windows are broadcast only if they number at most BROADCAST_ROWS and their words have at most BROADCAST_BYTES,
both of which are counted first; beyond that the joins shuffle. Fingerprints leave a task aggregated by document, and hits are gathered by document, which its words bound.

Defined results: a null text has no words; items that are null or have no words have no windows; a null item id is left
out of the list; repeated rows are documents of their own with equal results; an empty benchmark contaminates nothing; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, stored, text_column

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 1 << 20
#: Bytes of their words, at most: words can be of any length.
BROADCAST_BYTES = 128 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters that are neither letters nor digits stand between words.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The words; only A to Z are lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def gram_size(length: int) -> int:
    return min(GRAM, length)


def spanned(n: int):
    """A window's place and fingerprint with its words."""
    return lambda m: F.struct(m["at"].alias("at"), F.lit(n).alias("length"), m["fingerprint"].alias("fingerprint"), F.array_join(F.slice("words", m["at"] + 1, F.lit(n)), " ").alias("span"))


def reached(df: DataFrame, base: str, k: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds the column base_k: at each place, `join` over the k values of `base` from there; its last k - 1 places mean nothing.

    Values over 2, 4, 8 places come from two of half as many, so that a place costs as many steps as k has binary digits.
    """
    if k == 1 or f"{base}_{k}" in df.columns:
        return df if k > 1 else df.withColumn(f"{base}_1", F.col(base))
    left = 1 << (k - 1).bit_length() - 1
    df = reached(reached(df, base, left, join), base, k - left, join)
    shifted = F.slice(f"{base}_{k - left}", left + 1, F.size(base))
    return df.withColumn(f"{base}_{k}", F.zip_with(f"{base}_{left}", shifted, join))


def with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds h, the words' hashes, and, as far as the lengths of windows need them, g1 .. g5, the gram hashes, and their minima."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for n in lengths:
        k = gram_size(n)
        if f"g{k}" not in df.columns:
            df = reached(df, "h", k, lambda x, y: F.xxhash64(x, y))
            df = df.withColumn(f"g{k}", F.slice(f"h_{k}", 1, F.greatest(F.size("h") - (k - 1), F.lit(0))))
        df = reached(df, f"g{k}", n - k + 1, lambda x, y: F.least(x, y))
    return df


def fingerprints(length: int) -> Column:
    """The fingerprint of every window of `length` words, in order; none if there are fewer words."""
    k = gram_size(length)
    least = F.slice(f"g{k}_{length - k + 1}", 1, F.greatest(F.size("h") - (length - 1), F.lit(0)))
    return least if length == WINDOW else F.transform(least, lambda x: F.xxhash64(x, F.lit(length)))


def windows(df: DataFrame, lengths: list[int], keep: list[str], of_length: Column | None = None) -> DataFrame:
    """keep, at, length, fingerprint and span (the window's words) of every window, or of those of each row's own length."""
    out = None
    for n in lengths:
        rows = df if of_length is None else df.filter(of_length == n)
        made = rows.select(*keep, "words", F.transform(fingerprints(n), lambda f, i: F.struct(i.alias("at"), f.alias("fingerprint"))).alias("made"))
        made = made.select(*keep, F.inline(F.transform("made", spanned(n))))
        out = made if out is None else out.unionByName(made)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    spark = docs.sparkSession
    path = shared_dir(spark, "winnow")
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(text_column(benchmark, item_text)).alias("words"))
    items = items.withColumn("n", F.least(F.size("words"), F.lit(WINDOW))).filter("n > 0")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # 1 .. WINDOW
    body = text_column(docs, text)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), body).alias("row"), F.hash(body).alias("tag"), body.alias("body"))
    if not lengths:
        return rows.select(F.col("key").alias(key), F.size(words_of(F.col("body"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    held = stored(windows(with_grams(items, lengths), lengths, ["item"], F.col("n")).select("item", "fingerprint", "length", "span").distinct(), f"{path}/benchmark")
    n_held, size = held.agg(F.count("*"), F.sum(F.octet_length("span").cast("long") + 24)).first()
    small = n_held <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    sized = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    # 1. one row a document, with whether any of its fingerprints is the benchmark's
    tokens = with_grams(rows.select("key", "row", "tag", words_of(F.col("body")).alias("words")), lengths)
    every = F.array_distinct(F.concat(*[fingerprints(n) for n in lengths]) if len(lengths) > 1 else fingerprints(lengths[0]))
    single = tokens.select("key", "row", "tag", F.size("words").alias("n_words"), F.monotonically_increasing_id().alias("number"), every.alias("f"))
    exploded = single.select("key", "row", "tag", "n_words", "number", F.explode_outer("f").alias("fingerprint"))
    known = held.select("fingerprint").distinct().withColumn("shared", F.lit(True))
    met = exploded.join(sized(known), "fingerprint", "left").groupBy("number", "key", "row", "tag", "n_words").agg(F.max("shared").alias("candidate"))
    met = stored(met.select("key", "row", "tag", "n_words", "candidate"), f"{path}/documents")

    # 2. the windows of candidates, whole
    candidates = met.filter("candidate").select("row", "tag").distinct()
    texts = rows.join(candidates, ["row", "tag"], "left_semi").select("row", "tag", words_of(F.col("body")).alias("words")).dropDuplicates(["row", "tag"])
    spans = windows(with_grams(texts, lengths), lengths, ["row", "tag"])
    hits = spans.join(sized(held), ["fingerprint", "length", "span"]).select("row", "tag", "at", "length", "item")

    # 3. covered stretches and items
    ends = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end"))
    told = hits.groupBy("row", "tag").agg(F.array_sort(F.collect_set(ends)).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    told = told.select("row", "tag", F.aggregate("spans", zero, step, lambda acc: acc["n"]).alias("n_hit"), "items")
    out = met.join(told, ["row", "tag"], "left")
    return out.select(
        F.col("key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )

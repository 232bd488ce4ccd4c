"""Repair of a conversation's structure: the cheapest edits after which its roles alternate, found by a fold over its turns.

Faults come from windows: a turn is blank, repeats an earlier turn's role and text, or ends without a sentence mark. Turns are
collected, sorted, as structs, and aggregate() carries four (cost, audit) structs over them, one for each state in which what
has been kept so far can end (nothing, system, user, assistant), by least() of the edits: Keep, Rerole, Delete, Insert. What is
kept must read (s?(ua)+)? by the initials of its roles. least() compares costs, then audits, so ties go to the audit that is
least in ASCII; scripts that reach a state at equal cost are never prefixes of one another, as inserting costs.

A conversation may be any share of the table. Rows are dealt by ranges of (conversation, turn, role, text, row), which cuts a
long one, and even a run of equal rows, at the borders of partitions, and a partition's part of a conversation into blocks of
at most BLOCK turns and about BLOCK_BYTES of text. A first block is folded from the state of nothing kept, a later one from
each of the four states: a table of 4 x 4 structs, which a second fold over a conversation's blocks combines. Repeats are found
within a part, and between the parts of the few conversations that span several (at most one for each border) by the digests of
their turns, once a part. Ordered rows and blocks are written tables, and the former are deleted when the latter are there.
The second fold holds, for a conversation of several blocks, 16 letters a turn, as many times its audit, which is a value of
the result.

Defined results: nulls in role or text are one space; turns without a number come first; rows of the same turn are ordered by
role, then text; a null conversation id is a conversation like others; no rows give an empty result; a gap count beyond 64 bits
is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import release, remove, shared_dir, small_batches, stored

BLOCK, BLOCK_BYTES = 512, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: The states, by what was kept last, and a cost that no script has.
STATES, NEVER = "nsua", 1 << 40


@dataclass
class Repaired:
    """conversations: key, counts of faults, cost and audit; turns: key, part, block and the repaired turns (role, text) of a block."""

    conversations: DataFrame
    turns: DataFrame


def pair(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def plus(state: Column, cost: Column | int, letter: Column | str) -> Column:
    """The state's script with one more edit."""
    return pair(state["cost"] + cost, F.concat(state["audit"], letter if isinstance(letter, Column) else F.lit(letter)))


def closed(n: Column, s: Column, u: Column, a: Column) -> Column:
    """The four scripts, with turns inserted where that is cheaper."""
    user = F.least(u, plus(n, INSERT, "I"), plus(s, INSERT, "I"), plus(a, INSERT, "I"))
    return F.struct(n.alias("n"), s.alias("s"), user.alias("u"), F.least(a, plus(user, INSERT, "I")).alias("a"))


def folded(turns: Column, entry: Column) -> Column:
    """The four cheapest scripts over the turns, for what precedes them having ended in state number `entry`."""
    start = [pair(F.when(entry == i, 0).otherwise(NEVER), F.lit("")) for i in range(4)]

    def edit(acc: Column, turn: Column) -> Column:
        n, s, u, a = (acc[x] for x in STATES)
        keep = F.when(turn["must"], NEVER).when(turn["truncated"], TRUNCATED).otherwise(0)

        def as_role(state: Column, initial: str) -> Column:
            same = turn["initial"] == initial
            return plus(state, keep + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R"))

        return closed(
            plus(n, DELETE, "D"),
            F.least(plus(s, DELETE, "D"), plus(n, keep + F.when(turn["initial"] == "s", 0).otherwise(NEVER), "K")),
            F.least(plus(u, DELETE, "D"), as_role(n, "u"), as_role(s, "u"), as_role(a, "u")),
            F.least(plus(a, DELETE, "D"), as_role(u, "a")),
        )

    return F.aggregate(turns, closed(*start), edit)


def combined(blocks: Column) -> Column:
    """The cheapest scripts over all blocks, with the state in which each block begins (path), and what borders between parts change."""

    def triple(cost: Column, audit: Column, path: Column) -> Column:
        return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), path.alias("path"))

    def append(acc: Column, b: Column) -> Column:
        ends = []
        for q in STATES:
            ways = []
            for e, name in enumerate(STATES):
                end = F.get(b["scripts"], F.lit(e))[q]
                ways.append(triple(acc[name]["cost"] + F.coalesce(end["cost"], F.lit(NEVER)), F.concat(acc[name]["audit"], F.coalesce(end["audit"], F.lit(""))), F.concat(acc[name]["path"], F.lit(str(e)))))
            ends.append(F.least(*ways).alias(q))
        border = F.coalesce(acc["part"] != b["part"], F.lit(False))
        return F.struct(
            *ends,
            b["part"].alias("part"), b["last"].alias("last"), b["last_turn"].alias("last_turn"),
            (acc["illegal"] + F.when(border & ~alternate(acc["last"], b["first"]), 1).otherwise(0)).alias("illegal"),
            (acc["shared"] + F.when(border & F.coalesce(acc["last_turn"] == b["first_turn"], F.lit(False)), 1).otherwise(0)).alias("shared"),
        )

    none = lambda kind: F.lit(None).cast(kind)
    start = [triple(F.lit(0 if q == "n" else NEVER), F.lit(""), F.lit("")).alias(q) for q in STATES]
    zero = F.struct(*start, none("int").alias("part"), none("string").alias("last"), none("long").alias("last_turn"), F.lit(0).alias("illegal"), F.lit(0).alias("shared"))
    return F.aggregate(blocks, zero, append)


def rewritten(turns: Column, audit: Column, entry: Column) -> Column:
    """The repaired (role, text) structs of a block: its audit's letters are read along its turns."""
    letters = F.when(F.length(audit) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(audit), F.lit(1))), lambda i: audit.substr(i, F.lit(1))))

    def emit(acc: Column, letter: Column) -> Column:
        turn = F.get(turns, acc["at"])
        role = F.when(letter == "K", turn["role"]).when(acc["user"], "assistant").otherwise("user")
        one = F.struct(role.alias("role"), F.when(letter == "I", "").otherwise(turn["text"]).alias("text"))
        return F.struct(
            (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"),
            F.when(letter == "D", acc["user"]).otherwise(role.substr(1, 1) == "u").alias("user"),
            F.when(letter == "D", acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), (entry == STATES.index("u")).alias("user"), F.array().cast("array<struct<role:string,text:string>>").alias("out"))
    return F.aggregate(letters, start, emit)["out"]


def alternate(before: Column, after: Column) -> Column:
    return F.concat(before, after).isin("su", "ua", "au")


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def repeated_in_parts(rows: DataFrame, spanning: DataFrame) -> DataFrame:
    """The rows with `again`: whether an earlier part of the same conversation has the turn. Only conversations of several parts are looked at."""
    same = F.col("key").eqNullSafe(F.col("span"))
    few = rows.join(F.broadcast(spanning), same)  # at most a conversation for each border between partitions
    few = few.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    once = few.select("key", "part", "role", "digest").distinct()
    later = once.withColumn("n", F.row_number().over(Window.partitionBy("key", "role", "digest").orderBy("part"))).filter("n > 1")
    later = later.select(*[F.col(c).alias(f"l_{c}") for c in ("key", "part", "role", "digest")])
    on = F.col("key").eqNullSafe(F.col("l_key")) & (F.col("part") == F.col("l_part")) & (F.col("role") == F.col("l_role")) & (F.col("digest") == F.col("l_digest"))
    few = few.join(later, on, "left").select(*rows.columns, F.col("lo"), F.col("l_part").isNotNull().alias("again"))
    rest = rows.join(F.broadcast(spanning), same, "left_anti")
    return few.unionByName(rest.withColumn("lo", F.lit(None).cast("int")).withColumn("again", F.lit(False)))


def folded_blocks(rows: DataFrame, block: int) -> DataFrame:
    """A row per block: its sorted turns, its counts of faults, and its cheapest scripts from each state in which it may begin."""
    place = Window.partitionBy("key", "part").orderBy(*in_order())
    rows = rows.withColumn("n", F.row_number().over(place)).withColumn("bytes", F.sum(F.octet_length("text")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("initial", F.col("role").substr(1, 1)).withColumn("before", F.lag("initial").over(place)).withColumn("turn_before", F.lag("turn").over(place))
    rows = rows.withColumn("again", F.col("again") | (F.row_number().over(Window.partitionBy("key", "part", "role", "text").orderBy("n")) > 1))
    rows = rows.withColumn("block", (F.floor((F.col("n") - 1) / block) + F.floor(F.col("bytes") / BLOCK_BYTES)).cast("long"))
    rows = rows.withColumn("blocks", F.max("block").over(Window.partitionBy("key", "part")))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    blank, again = bare == "", F.col("again")
    truncated = ~blank & ~again & ~F.substring(bare, -1, 1).isin(".", "!", "?")
    turn = F.struct("n", "initial", "role", "text", "turn", (blank | again).alias("must"), truncated.alias("truncated"))
    count = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).cast("long")
    out = rows.groupBy("key", "part", "block", "lo", "blocks").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),  # at most `block` of them
        count(blank).alias("blank"), count(~blank & again).alias("duplicate"), count(truncated).alias("truncated"),
        count(F.col("before").isNotNull() & ~alternate(F.col("before"), F.col("initial"))).alias("illegal"),
        count(F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn") != F.col("turn_before")))).alias("n_turns"),
        F.min("turn").alias("least_turn"), F.max("turn").alias("most_turn"),
    )
    first = (F.col("block") == 0) & F.coalesce(F.col("part") == F.col("lo"), F.lit(True))
    entries = F.when(first, F.array(F.lit(0))).otherwise(F.array(*[F.lit(i) for i in range(4)]))
    out = out.withColumn("single", F.col("lo").isNull() & (F.col("blocks") == 0))
    return out.withColumn("scripts", F.transform(entries, lambda e: folded(F.col("turns"), e))).drop("lo", "blocks")


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> Repaired:
    """The cheapest repair of every conversation that has a row."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark, "conversations")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first(), *in_order(), F.col("row").asc()).withColumn("part", F.spark_partition_id()).drop("row")
    rows = stored(rows, f"{path}/rows")
    spanning = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select(F.col("key").alias("span"), "lo")
    blocks = stored(folded_blocks(repeated_in_parts(rows, spanning), block), f"{path}/blocks")
    remove(spark, f"{path}/rows")

    facts = ["blank", "duplicate", "truncated", "illegal", "n_turns", "least_turn", "most_turn"]
    whole = blocks.filter("single").withColumn("best", F.least(F.col("scripts")[0]["n"], F.col("scripts")[0]["a"]))
    one = whole.select("key", *facts, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))

    ends = [F.element_at("turns", i)[f].alias(name) for i, f, name in ((1, "initial", "first"), (-1, "initial", "last"), (1, "turn", "first_turn"), (-1, "turn", "last_turn"))]
    cut = blocks.filter("NOT single").select("key", *facts, F.struct("part", "block", *ends, "scripts").alias("b"))
    sums = [F.sum(c).alias(c) for c in facts[:5]] + [F.min("least_turn").alias("least_turn"), F.max("most_turn").alias("most_turn")]
    many = cut.groupBy("key").agg(F.array_sort(F.collect_list("b")).alias("b"), *sums).withColumn("f", combined(F.col("b")))
    many = many.withColumn("best", F.least("f.n", "f.a")).withColumn("end", F.when(F.col("f.n") == F.col("best"), "0").otherwise("3"))
    many = stored(many, f"{path}/long")
    more = many.select("key", *facts[:3], (F.col("illegal") + F.col("f.illegal")).alias("illegal"), (F.col("n_turns") - F.col("f.shared")).alias("n_turns"), *facts[5:], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))

    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.when(F.col("least_turn").isNull(), F.lit(0).cast("long")).otherwise((wide("most_turn") - wide("least_turn") + 1 - wide("n_turns")).try_cast("long"))
    summary = one.unionByName(more).select(F.col("key").alias(key), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    states = F.concat("best.path", "end")
    script = lambda e, q: F.coalesce(*[F.when(q == i, F.get(F.col("x.scripts"), e)[s]["audit"]) for i, s in enumerate(STATES)])
    at = lambda i: states.substr(i, F.lit(1)).cast("int")
    steps = many.select("key", "best", "end", F.posexplode("b").alias("i", "x"))
    steps = steps.select(F.col("key").alias("s_key"), F.col("x.part").alias("s_part"), F.col("x.block").alias("s_block"), at(F.col("i") + 1).alias("entry"), script(at(F.col("i") + 1), at(F.col("i") + 2)).alias("audit"))
    on = F.col("key").eqNullSafe(F.col("s_key")) & (F.col("part") == F.col("s_part")) & (F.col("block") == F.col("s_block"))
    pieces = blocks.filter("NOT single").join(steps, on).select("key", "part", "block", "single", rewritten(F.col("turns"), F.col("audit"), F.col("entry")).alias("turns"))
    alone = whole.select("key", "part", "block", "single", rewritten(F.col("turns"), F.col("best.audit"), F.lit(0)).alias("turns"))
    return Repaired(summary, alone.unionByName(pieces).withColumnRenamed("key", key))


def digests(turns: DataFrame, key: str) -> DataFrame:
    """key and the SHA-256 of a conversation's repaired `role:text` lines; the blocks of a longer one pass through one task as a stream."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = turns.filter("single").select(key, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    blocks = turns.filter("NOT single AND size(turns) > 0").select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(key).isNull().alias("none"), "part", "block", lines.alias("lines"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, value = None, None, None
        ready = lambda: pa.RecordBatch.from_arrays([value, pa.array([digest.hexdigest()])], names=[key, "repaired_sha256"])
        for batch in batches:
            for i, (name, none, text) in enumerate(zip(batch.column("name").to_pylist(), batch.column("none").to_pylist(), batch.column("lines").to_pylist(), strict=True)):
                if (name, none) != now:
                    if now is not None:
                        yield ready()
                    now, digest, value = (name, none), hashlib.sha256(text.encode()), batch.column(0).slice(i, 1)
                else:
                    digest.update(b"\n" + text.encode())
        if now is not None:
            yield ready()
        release()

    schema = turns.select(key).schema.add("repaired_sha256", "string")
    streamed = blocks.repartition(F.col("name"), F.col("none")).sortWithinPartitions("name", "none", "part", "block").mapInArrow(stream, schema)
    return one.unionByName(streamed)


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: of 20 cases, one each is dropped, emptied, cut of its marks, repeated, or turned to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(space(key), F.lit(":"), space(turn)).cast("binary")), F.lit(20))
    new_text = F.when(case == 1, "").when(case == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    rows = df.select(key, turn, F.when(case == 4, "user").otherwise(space(role)).alias(role), new_text.alias(text), case.alias("case")).filter("case <> 0")
    return rows.withColumn("copy", F.explode(F.expr("IF(case = 3, array(0, 1), array(0))"))).drop("case", "copy")


def damaged_and_repaired(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for every conversation of df: faults after damage, cost and audit of the repair, digest of what it gives."""
    done = repair(damaged(df, key, turn, role, text), key, turn, role, text, block)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    named = lambda x, name: x.withColumnRenamed(key, name)
    out = df.select(key).distinct().join(named(done.conversations, "c_key"), F.col(key).eqNullSafe(F.col("c_key")), "left")
    out = out.withColumn("has", F.col("cost").isNotNull()).join(named(digests(done.turns, key), "d_key"), F.col(key).eqNullSafe(F.col("d_key")) & F.col("has"), "left")
    gaps = F.when(F.col("has"), F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps")
    return out.select(key, gaps, *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

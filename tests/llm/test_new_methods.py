"""Conversation repair, ball k-means and toxicity on small tables, against plain versions."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import clustering, conversations, toxicity

TURNS = "conv_id long, turn long, role string, text string, key string, part int, block long, span long"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) of the cheapest script: all scripts in order of cost and audit, by a queue over (rows read, initials kept)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, kept, lines = heapq.heappop(queue)
        if at == len(rows) and LEGAL.fullmatch(kept):
            return cost, audit, lines
        state = (at, kept[-1:])
        if state in done:
            continue
        done.add(state)
        following = "assistant" if kept[-1:] == "u" else "user"
        heapq.heappush(queue, (cost + 5, audit + "I", at, kept + following[0], (*lines, f"{following}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, kept, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] == following[0] or (role[:1] == "s" and not kept):
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, kept + role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, kept + following[0], (*lines, f"{following}:{text}")))


def plain_repair(rows, damage=True):
    """The query's rows from (conv_id, turn, role, text), a conversation at a time."""
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        kept += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = []
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faulty.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        count = lambda fault: sum(f == fault for _, _, f in faulty)  # noqa: E731, B023
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, lines = cheapest(faulty)
        out.append([conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()])
    return sorted(out, key=repr)


def repaired_rows(df, **settings):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(([r[n] for n in names] for r in conversations.damaged_and_repaired(df, **settings).collect()), key=repr)


def talk(seed, conv, n, roles=("user", "assistant"), odd=0.2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        role = roles[i % len(roles)] if rng.random() > odd else str(rng.choice(["system", "user", "assistant", "tool", ""]))
        rows.append((conv, i if rng.random() > odd / 4 else int(rng.integers(n)), role, str(rng.choice(["Fine.", "No", "Why?", "", " \t", "One. two", "é!", f"Turn {i}."]))))
    return rows


@pytest.fixture(scope="module")
def turns():
    rows = [r for c in range(60) for r in talk(c, c, c % 9)]
    rows += talk(100, 100, 90) + talk(101, 101, 40, ("user",)) + talk(102, None, 7)
    rows += [(103, None, "user", "Hi."), (103, None, None, None), (103, 2, "assistant", "x" * 5000 + "."), (104, 1, None, None), (105, 5, "system", "Only."), (106, None, "assistant", "No number.")]
    rows += [(107, 3, "user", "Same.")] * 12 + [(108, 2**62, "user", "Far."), (108, 0, "assistant", "Away.")]
    return rows


@pytest.mark.parametrize("block, partitions", [(512, 2), (3, 3), (1, 9)])
def test_conversations_are_repaired(spark, turns, block, partitions):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in turns], TURNS).repartition(5)
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired_rows(df, block=block) == plain_repair(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_read_as_they_should(spark, turns):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in turns], TURNS)
    done = conversations.repair(df, block=4)
    said = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r.part, r.block)):
        said.setdefault(r.conv_id, []).extend(t.role[:1] for t in r.turns)
    assert len(said) == len({r[0] for r in turns if r[0] is not None}) + 1
    assert all(LEGAL.fullmatch("".join(x)) for x in said.values())
    kept = {r.conv_id: sum(c in "KRI" for c in r.audit) for r in done.conversations.collect()}
    assert kept == {c: len(x) for c, x in said.items()}


def test_no_conversations(spark):
    assert repaired_rows(spark.createDataFrame([], TURNS)) == []


# --- ball k-means


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(k, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for k, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(k, [max(-clustering.LIMIT, min(clustering.LIMIT, x)) for x in v]) for k, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if i < rounds:
            for j in range(len(centroids)):
                of = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
                if of:
                    centroids[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    total = {j: sum(d for d, c in own if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(([k, c, d, total[c], sum(total.values()), digest[c]] for (k, _), (d, c) in zip(kept, own, strict=True)), key=repr)


def clustered(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(([r[n] for n in names] for r in clustering.cluster(df).collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, key int, v string"


@pytest.mark.parametrize("n", [400, 7, 0])
def test_balls_give_the_plain_clusters(spark, n):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(12, 64))
    rows = [(i, (centers[i % 12] + 0.2 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]
    if n == 400:
        rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[5][1]), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [*[1.0] * 63, None]), (904, [float("inf"), *[0.0] * 63])]
        rows += [(905, [0.0] * 64), (906, [-0.0] * 64), (907, [3e38, -3e38, *[0.5] * 62])]
        rows += [(1000 + i, [0.25] * 64) for i in range(30)]
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], VECTORS).repartition(3)
    assert clustered(df) == plain_clusters(rows)


def test_balls_compare_few_centroids():
    rng = np.random.default_rng(1)
    centers = rng.integers(-400, 400, (16, 64))
    own = rng.integers(0, 16, 3000)
    rows = centers[own] + rng.integers(-60, 60, (3000, 64))
    rows[:200] = rng.integers(-400, 400, (200, 64))
    wrong = own.copy()
    wrong[::50] = rng.integers(0, 16, len(wrong[::50]))
    for start in (own, wrong):
        cluster, distance, computed = clustering.moved(rows, start, centers)
        want, far = clustering.nearest(rows, centers)
        assert (cluster == want).all() and (distance == far).all()
    assert clustering.moved(rows[200:], own[200:], centers)[2] < 2 * 2800


# --- toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, k long, t string, y int"
RUDE = ["blockhead", "nitwit", "dimwit", "rotter"]


def speech(seed, n, rude=0):
    rng = np.random.default_rng(seed)
    syllables = ["ba", "ke", "lo", "mi", "tu", "san", "der", "fo"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]
    for at in rng.integers(0, n, rude):
        words[at] = str(rng.choice(RUDE))
    return " ".join(words)


def test_toxic_texts_of_held_out_rows(spark):
    rows = [(i, speech(i, 120, 6 if i % 4 == 0 else 0), "xx", "s", 0.5, 1, "clash", 1) for i in range(600)]
    rows += [(700, None, None, None, None, None, None, None), (701, "", *rows[0][2:]), (702, " \n", *rows[0][2:]), (703, speech(9, 20000), *rows[0][2:]), (704, rows[4][1].upper(), *rows[0][2:]), (None, rows[8][1], *rows[0][2:]), (4, rows[4][1], *rows[0][2:])]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(600)] + [(8, 0, None), (4, 1, 1), (None, 0, 1), (99999, 0, 1), (12, 0, 7)]
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[700].score == by[701].score and not by[701].predicted and not by[703].predicted and by[704].score == by[4].score and by[None].score == by[8].score
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.withColumn("lang", F.lit("zz")).repartition(2), marks).collect()}
    assert all(again[k].hex() == r.score.hex() for k, r in by.items())


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 1), (5, 1)], 1.0), ([(1, 0)], 0.0)])
def test_toxicity_without_both_labels(spark, labels, score):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 8 and {r.score for r in got} == {score}
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_windows_cover_texts():
    texts = [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 3]
    data, start, length, of = toxicity.windows(texts)
    first = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
    for i, t in enumerate(texts):
        own = [(int(a - first[i]), int(n)) for a, n, o in zip(start, length, of, strict=True) if o == i]
        assert {p for a, n in own for p in range(a, a + n)} == set(range(len(t))) and all(0 < n <= toxicity.WINDOW for _, n in own)
        assert all(b[0] - a[0] == toxicity.STEP for a, b in zip(own, own[1:], strict=False))


def test_marking_words():
    here, there = [f"the {w} of it".encode() for w in ["nitwit"] * 20 + ["tree"] * 5], [b"the tree of it"] * 30
    assert toxicity.marking_words(here, there) == [b"nitwit"]

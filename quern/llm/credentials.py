"""Secret scan with multipart credential linking.

Base kinds are reported wherever they stand. Weak candidates (`weak_id`, `weak_secret`, `endpoint`) say little alone: each
is reported only when its complementary parts co-occur, which an interval join of the document's parts decides.

A part's scope is the stretch of `scope` code points on either side of it. Sorted by start, the parts of one kind do not
overlap, so both their starts and their ends ascend, and the join is a pair of binary searches for each part.

Defined results: a null text is an empty text and has no spans; repeated rows give repeated results; a null id stays null;
other columns are ignored; an empty table gives an empty table. Texts are scanned whole, one at a time; no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quern.llm.common import forget, small_batches, text_column

#: Code points on either side of a part within which its complements must stand.
SCOPE = 400
#: In the order that ties of start are broken.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])A(?:SIA|IDA|ROA|GPA)[A-Z0-9]{12,}(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+""")

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Base spans by kind; a match that is too short is dropped after it has used up its characters."""
    low = text.lower()
    assign = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if any(k in low for k in KEYWORDS) else []
    access = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in HEX.finditer(text)]}


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of `taken`, which are sorted and free of overlaps."""
    starts, ends = [s for s, _ in taken], [e for _, e in taken]
    return [(s, e) for s, e in spans if bisect_right(ends, s) >= bisect_left(starts, e)]


def joined(parts: list[Span], others: list[Span], scope: int) -> list[bool]:
    """For each part, whether one of the others is in its scope: a merge of two sorted lists."""
    starts, ends = [s for s, _ in others], [e for _, e in others]
    return [bisect_right(ends, s - scope) < bisect_left(starts, e + scope) for s, e in parts]


def merged(*lists: list[Span]) -> list[Span]:
    """One sorted list without overlaps that covers the same places."""
    out: list[Span] = []
    for s, e in sorted(x for spans in lists for x in spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def scan(text: str, scope: int = SCOPE) -> list[tuple[int, str, int]]:
    """All (start, kind, end), by start and then by kind as listed."""
    found = base_spans(text)
    if "https://" in text or "http://" in text or any(k in text for k in ("AKIA", "ASIA", "AIDA", "AROA", "AGPA")):
        taken = merged(*found.values())
        weak_id = apart([m.span() for m in WEAK_ID.finditer(text)], taken)
        ids = merged(found["access"], weak_id)
        if ids:
            weak_secret = apart([m.span() for m in WEAK_SECRET.finditer(text)], merged(taken, weak_id))
            secrets = merged(found["assign"], found["hex"], weak_secret)
            found["weak_id"] = [s for s, ok in zip(weak_id, joined(weak_id, secrets, scope), strict=True) if ok]
            found["weak_secret"] = [s for s, ok in zip(weak_secret, joined(weak_secret, ids, scope), strict=True) if ok]
            ends = [m.span() for m in ENDPOINT.finditer(text)] if secrets else []
            both = zip(ends, joined(ends, ids, scope), joined(ends, secrets, scope), strict=True)
            found["endpoint"] = [s for s, a, b in both if a and b]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((s, k, e) for k, spans in found.items() for s, e in spans), key=lambda x: (x[0], order[x[1]], x[2]))


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each stretch of spans replaced by [REDACTED]; endpoints stay."""
    out, at = [], 0
    for s, e in merged([(s, e) for s, k, e in spans if k != "endpoint"]):
        out += [text[at:s], "[REDACTED]"]
        at = e
    return "".join([*out, text[at:]])


def link_credentials(df: DataFrame, keep: list[str], text: str = "text", scope: int = SCOPE, redact: str | None = None) -> DataFrame:
    """`keep` columns, `spans` array of (kind, start, end), and, if `redact` names a column, the text without its secrets.

    Start and end are in code points, end exclusive. A null text has no spans and stays null under `redact`.
    """
    small_batches(df.sparkSession)
    schema = df.select(*keep).schema
    schema = schema.add("spans", DataType.fromDDL("array<struct<kind:string,start:int,end:int>>"), True)
    if redact:
        schema = schema.add(redact, "string", True)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [scan(t, scope) if t else [] for t in texts]
            columns = [batch.column(i) for i in range(len(keep))]
            columns.append(pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in found], arrow))
            if redact:
                columns.append(pa.array([redacted(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "spans"] + [redact] * bool(redact))

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(apply, schema)


def digest(df: DataFrame) -> DataFrame:
    """Per document: the counts of base spans, the SHA-256 of their list, and the list of all spans."""
    rows = link_credentials(df.select("doc_id", text_column(df).alias("text")), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

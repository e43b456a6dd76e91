"""Secret scans: base patterns, and weak parts that count only next to their complements.

Method
------
Three base kinds are found by pattern: an assignment to a telling name, an access key id, a long hex run.
Many credentials come in parts none of which is telling alone: a user or key identifier, a secret, an endpoint.
Their parts are found by looser patterns and linked inside scopes. A scope is a run of lines without a blank line or
an INI header between them; within it, a part reaches ``REACH`` code points to both sides. The interval join of a
text's parts is done on sorted spans: each part asks, by binary search, for the nearest part of another role before
and behind it in its scope, so that no pairs are listed however many parts a scope holds.

* A weak secret (a mixed token of 20 or more characters, or a short value given to a password-like name) is reported
  as ``link_secret`` if an access key id is in reach, or both another identifier and an endpoint are.
* Identifiers and endpoints (``link_id``, ``link_endpoint``) are reported if a secret is in reach: a weak one that
  is itself reported, or a base assignment or hex run (for endpoints, only next to a reported identifier or an access key id).

A weak part that overlaps a base span of its role is that span, and isn't reported again.

Edge cases
----------
Null text is empty: no spans. Null ids and repeated rows are scanned like any other row. An empty table gives an
empty table. Texts are scanned whole, one at a time; memory follows one text and its spans. Spans are in code
points, end exclusive; equal starts are ordered by kind. Columns that aren't carried are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "link_id", "link_secret", "link_endpoint")
#: Code points between a part and its complement, at most.
REACH = 400
#: Least entropy (bits a character) of a mixed token.
LEAST_ENTROPY = 3.5

# The base patterns and the least length of each kind.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a greedy run of 32 or more is the run of any length that has as many
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

_NAMED = r"""(?<![A-Za-z0-9])(?:[A-Za-z0-9]+[_.-]){0,4}(?:%s)["']?[ \t]*(?:=>?|:)[ \t]*["']?(%s)"""
#: Values given to names of identifiers, and identifiers that look like one.
_IDENTIFIER = re.compile(_NAMED % (
    r"user(?:[_-]?(?:name|id))?|login|account(?:[_-]?(?:name|id))?|client[_-]?id|app(?:lication)?[_-]?id|tenant[_-]?id"
    r"|access[_-]?key(?:[_-]?id)?|key[_-]?id|project[_-]?id|email", r"[A-Za-z0-9@._+-]{3,}"), re.ASCII | re.IGNORECASE)
_IDENTIFIER_NAMES = ("user", "login", "account", "client", "app", "tenant", "access", "key", "project", "email")
_TEMPORARY = re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}")
#: Addresses with a scheme, and values given to names of endpoints.
_ENDPOINT = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+", re.ASCII)
_NAMED_ENDPOINT = re.compile(_NAMED % (
    r"host(?:[_-]?name)?|endpoint|server|url|region|bucket|database|db[_-]?name", r"[A-Za-z0-9][A-Za-z0-9._:/-]{2,}"),
    re.ASCII | re.IGNORECASE)
_ENDPOINT_NAMES = ("host", "endpoint", "server", "url", "region", "bucket", "database", "db")
#: Weak secrets: long mixed tokens, and values of any length that are given to a password-like name.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_NAMED_SECRET = re.compile(_NAMED % (
    r"pass(?:word|wd|phrase)?|pwd|secret(?:[_-]?(?:access[_-]?)?key)?|token|api[_-]?key|auth|credentials?|private[_-]?key",
    r"""[^\s"',;]{4,}"""), re.ASCII | re.IGNORECASE)
_SCOPE_END = re.compile(r"\n[ \t\r]*(?=\n)|\n(?=[ \t]*\[[^\]\n]{1,80}\][ \t\r]*(?:\n|$))")

Span = tuple[int, int]


def base_spans(text: str, lower: str) -> dict[str, list[Span]]:
    """Spans of the three base kinds, in order."""
    assign = []
    if any(word in lower for word in ("passw", "secret", "token", "apikey", "api_key")):
        assign = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    access = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] if "AKIA" in text else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in _HEX.finditer(text)]}


def _mixed(token: str) -> bool:
    """Digits, small and capital letters, and too even a spread of characters for words."""
    if not (any("0" <= c <= "9" for c in token) and any("a" <= c <= "z" for c in token)
            and any("A" <= c <= "Z" for c in token)):
        return False
    return -sum(n / len(token) * log2(n / len(token)) for n in Counter(token).values()) >= LEAST_ENTROPY


class Parts:
    """Disjoint spans of one role in order, each with its scope; asks for the nearest one to a span."""

    def __init__(self, spans: Sequence[Span], ends: Sequence[int]):
        self.spans: list[Span] = []
        for start, end in sorted(set(spans), key=lambda s: (s[0], -s[1])):
            if not self.spans or start >= self.spans[-1][1]:
                self.spans.append((start, end))
        self.starts = [s for s, _ in self.spans]
        self.scopes = [bisect_left(ends, s) for s in self.starts]

    def overlaps(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[1]) - 1
        return at >= 0 and self.spans[at][1] > span[0]

    def near(self, span: Span, scope: int) -> bool:
        """True if a part of this role overlaps the span's scope within ``REACH``, other than the span itself."""
        at = bisect_left(self.starts, span[0])
        for i in range(at - 1, min(at + 2, len(self.spans))):  # the one before, itself or the one behind, the next
            if i >= 0 and self.spans[i] != span and self.scopes[i] == scope:
                if self.spans[i][0] - span[1] <= REACH and span[0] - self.spans[i][1] <= REACH:
                    return True
        return False


def linked_spans(text: str, lower: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of parts that count because complementary parts are in reach."""
    weak_ids = [m.span() for m in _TEMPORARY.finditer(text)]
    named = ":" in text or "=" in text
    if named and any(name in lower for name in _IDENTIFIER_NAMES):
        weak_ids += [m.span() for m in _IDENTIFIER.finditer(text)]
    if not weak_ids and not base["access"]:
        return {}
    ends = [m.start() for m in _SCOPE_END.finditer(text)]
    access = Parts(base["access"], ends)
    ids = Parts([s for s in weak_ids if not access.overlaps(s)], ends)
    places = [m.span() for m in _ENDPOINT.finditer(text)] if "://" in text else []
    if named and any(name in lower for name in _ENDPOINT_NAMES):
        places += [m.span() for m in _NAMED_ENDPOINT.finditer(text)]
    endpoints = Parts(places, ends)
    strong = Parts([*base["assign"], *base["hex"]], ends)
    taken = Parts([*strong.spans, *access.spans, *ids.spans, *endpoints.spans], ends)
    tokens = [m.span() for m in _TOKEN.finditer(text) if _mixed(m.group())]
    tokens += [m.span() for m in _NAMED_SECRET.finditer(text)] if named else []
    weak = Parts([s for s in tokens if not taken.overlaps(s)], ends)
    secrets = [s for s, scope in zip(weak.spans, weak.scopes)
               if access.near(s, scope) or (ids.near(s, scope) and endpoints.near(s, scope))]
    secret = Parts([*strong.spans, *secrets], ends)
    # An identifier that isn't telling counts next to a secret only if an endpoint stands there, too.
    names = [s for s, scope in zip(ids.spans, ids.scopes) if secret.near(s, scope) and endpoints.near(s, scope)]
    owner = Parts([*access.spans, *names], ends)
    where = [s for s, scope in zip(endpoints.spans, endpoints.scopes)
             if secret.near(s, scope) and owner.near(s, scope)]
    return {"link_id": names, "link_secret": secrets, "link_endpoint": where}


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a text, by start, then kind as listed in ``KINDS``."""
    lower = text.lower()
    base = base_spans(text, lower)
    found = {**base, **linked_spans(text, lower, base)}
    rows = [(start, n, end) for n, kind in enumerate(KINDS) for start, end in found.get(kind, ())]
    return [(KINDS[n], start, end) for start, n, end in sorted(rows)]


_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                               StructField("end", LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(text.as_py() or "")]
                 for text in batch.column("__text")]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(spans, _ARROW_SPANS)], names=["__id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): one row per document; ``spans`` is an array of (kind, start, end) in order."""
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(_scan, StructType([slim.schema["__id"], StructField("spans", _SPANS)])).withColumnRenamed(
        "__id", id_col)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): counts, digest and text of each document's spans."""
    found = scan(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *(count(k) for k in BASE_KINDS), F.sha2(as_text(base), 256).alias("base_sha256"),
                        as_text(F.col("spans")).alias("spans"))

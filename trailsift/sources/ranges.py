"""Envelopes larger than a row: byte ranges of one file are read in parallel (SRC-2, SRC-4).

Spark's text reader cuts a file into ranges of ``spark.sql.files.maxPartitionBytes`` and, with ``}`` as
line separator, a range into fragments that end at a ``}``; no row is larger than the text between two of
them. Where records begin depends on all text before, but only through two numbers: whether a fragment starts
inside a string, and how many brackets are open. Both compose:

1. Each range is read once for its effect: does it change the string state, and by how much does it change the
   depth if it starts outside or inside a string. Two window sums over the ranges of a file (one row each) give
   every range its true start.
2. Each range is cut into list elements (commas at the depth of the envelope's list). An element that
   crosses ranges comes in pieces, which are joined by element number.

A file is bad, and gives no records, if brackets don't match or a string stays open, if its top level is no object or list,
or if a text between commas of the list isn't JSON (an empty one counts as none). The values of other keys are skipped unseen. Of
several ``Records`` keys all lists count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailsift.session import materialize

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_STRING_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|[{}\[\],]', re.DOTALL)
#: Between two elements of the list, the next of which is an object or a list.
_NEXT = re.compile(r"[ \t\r\n]*(,)[ \t\r\n]*[{\[]")
_BRACKET = re.compile(r"[{}\[\]]")
#: Element texts are sent on in batches of about so many characters.
_BATCH = 1 << 22


def _effect(text: str) -> tuple[bool, int, int]:
    """(changes the string state, depth change from outside a string, and from inside one) of fragments with their ``}``."""
    parts = (_ESCAPE.sub("", text) if "\\" in text else text).split('"')
    change = []
    for side in ("".join(parts[0::2]), "".join(parts[1::2])):
        change.append(side.count("{") + side.count("[") - side.count("}") - side.count("]"))
    return len(parts) % 2 == 0, change[0], change[1]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of ``batch`` that lie in one range, as (first, end)."""
    file, start = batch.column("file"), batch.column("start")
    n = batch.num_rows
    if n:
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        cuts = (np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, n])


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_BATCH`` characters."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size > _BATCH:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: rows of a range come together and in order."""
    current, flips, outside, inside, first, length, file_size = None, False, 0, 0, "", 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [current[0]], "start": [current[1]], "flips": [int(flips)],
                                           "outside": [outside], "inside": [inside], "first": [first], "length": [length],
                                           "size": [file_size]})
    for batch in batches:
        for begin, end in _runs(batch):
            at = batch.column("file")[begin].as_py(), batch.column("start")[begin].as_py()
            if at != current:
                if current is not None:
                    yield row()
                current, flips, outside, inside, first, length = at, False, 0, 0, "", 0
                file_size = batch.column("size")[begin].as_py()
            values = batch.column("value").slice(begin, end - begin)
            texts = values.to_pylist()
            for i, j in _blocks(texts):
                change, a, b = _effect("}".join(texts[i:j]) + "}")
                outside, inside = outside + (b if flips else a), inside + (a if flips else b)
                flips ^= change
            if not first:
                first = texts[0].lstrip(" \t\r\n﻿")[:1] or "}"
            length += pc.sum(pc.binary_length(values)).as_py() + len(texts)
    if current is not None:
        yield row()


class _Cutter:
    """Cuts one range, whose true start is known, into elements of the envelope's list."""

    def __init__(self, in_string: bool, depth: int, level: int):
        self.in_string, self.depth, self.level = in_string, depth, level
        #: Whether the list being read is the envelope's; None: as in the range before.
        self.wanted: bool | None = True if level == 1 else None
        self.number, self.held, self.key = 0, [], None
        #: (number of cuts before it in the range, wanted, text)
        self.pieces: list[tuple[int, bool | None, str]] = []

    def _cut(self) -> None:
        self.pieces.append((self.number, self.wanted, "".join(self.held)))
        self.held = []
        self.number += 1

    def feed(self, text: str) -> None:
        """The next text, which ends with a fragment's ``}``."""
        if self.depth >= self.level and self._pass(text):
            return
        at = kept = 0
        if self.in_string:
            rest = _STRING_REST.match(text)
            if rest is None:
                self._keep(text)
                return
            at, self.in_string, self.key = rest.end(), False, None
        while True:
            token = _TOKEN.search(text, at)
            quote = text.find('"', at, token.start() if token else len(text))
            if token is None or quote >= 0:  # a string that goes on in the next fragment, or the end
                self.in_string = quote >= 0
                break
            at, sign = token.end(), token.group()[0]
            if sign == '"':
                if self.depth == 1:
                    self.key = token.group(1)
            elif sign in "{[":
                if self.depth == self.level - 1:
                    self._cut()
                    if self.level == 2:
                        self.wanted = sign == "[" and self.key == "Records"
                    kept, self.key = at, None
                self.depth += 1
            elif sign in "}]":
                if self.depth == self.level:
                    self._keep(text[kept:at - 1])
                    self._cut()
                    self.wanted, kept = False, at
                self.depth -= 1
            elif self.depth == self.level:
                self._keep(text[kept:at - 1])
                self._cut()
                kept = at
        self._keep(text[kept:])

    def _pass(self, text: str) -> bool:
        """Take a fragment in which nothing but a comma before an element's ``{`` is a cut; most are so.

        False, and nothing done, if there may be other cuts.
        """
        comma = None
        depth = self.depth
        if depth == self.level:
            comma = None if self.in_string else _NEXT.match(text)
            if comma is None:
                return False
            depth += 1
        plain = text if "\\" not in text else _ESCAPE.sub("", text)
        parts = plain.split('"')
        outside = "".join(parts[1 if self.in_string else 0::2])
        in_string = self.in_string ^ (len(parts) % 2 == 0)
        if comma is not None:
            outside = outside[comma.end():]  # no quote and no backslash stands before the bracket
        # The fragment's own "}" may end the element: only a closing bracket before it can cut.
        closed = outside.count("]") + outside.count("}") - (not in_string)
        if depth - closed <= self.level:
            lowest = now = depth
            for sign in _BRACKET.findall(outside if in_string else outside[:-1]):
                now += 1 if sign in "{[" else -1
                lowest = min(lowest, now)
            if lowest <= self.level:
                return False
        if comma is not None:
            self._keep(text[:comma.start(1)])
            self._cut()
            text = text[comma.start(1) + 1:]
        self.depth = depth + outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
        self.in_string = in_string
        self._keep(text)
        return True

    def _keep(self, text: str) -> None:
        if self.depth >= self.level and self.wanted is not False and text:
            self.held.append(text)

    def finish(self) -> None:
        self.pieces.append((self.number, self.wanted, "".join(self.held)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, cutter = None, None

    def written(done: bool) -> Iterator[pa.RecordBatch]:
        if done:
            cutter.finish()
        if cutter.pieces:
            number, wanted, text = zip(*cutter.pieces)
            n = len(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array([current[0]] * n), pa.array([current[1]] * n, pa.int64()), pa.array(number, pa.int64()),
                 pa.array(wanted, pa.bool_()), pa.array(text, pa.string()),
                 pa.array([False] * (n - 1) + [done], pa.bool_())],
                names=["file", "start", "number", "wanted", "text", "last"])
            cutter.pieces = []

    for batch in batches:
        size = 0
        for begin, end in _runs(batch):
            file, start, string, depth, level = (batch.column(c)[begin].as_py() for c in (
                "file", "start", "in_string", "depth", "level"))
            if (file, start) != current:
                if current is not None:
                    yield from written(True)
                current, cutter = (file, start), _Cutter(string, depth, level)
            for text in batch.column("value").slice(begin, end - begin).to_pylist():
                cutter.feed(text + "}")
                size += len(text)
                if size > _BATCH:
                    yield from written(False)
                    size = 0
        if current is not None:
            yield from written(False)
    if current is not None:
        yield from written(True)


def split_envelopes(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, bad files) of large envelopes.

    ``fragments`` (file, size, start, value) are the rows of a text read with line separator ``}``, where
    ``start`` is the byte at which a row's range starts. Records are (file, src_pos, text); bad files are (file).
    """
    slim = fragments.select("file", "start", "value")
    effects = materialize(fragments.select("file", "size", "start", "value").mapInArrow(
        _effects, "file string, start long, flips long, outside long, inside long, first string, length long, size long"),
        "range-effects")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_string = F.coalesce(F.sum("flips").over(earlier) % 2, F.lit(0)) == 1
    # All fragments but a file's last end in the separator; the sum of lengths tells of the last one.
    states = (effects.withColumn("in_string", in_string)
              .withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
              .withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)).cast("int"))
              .withColumns({"first": F.first("first").over(every), "bytes": F.sum("length").over(every),
                            "end_depth": F.sum("change").over(every), "end_string": F.sum("flips").over(every) % 2}))
    states = materialize(states.select("file", "start", "in_string", "depth", "first", "bytes", "end_depth", "end_string", "size",
                                       F.when(F.col("first") == "[", 1).otherwise(2).alias("level")), "range-states")
    # A file without a last "}" was read as if it had one: one byte and one closing bracket too many. (A byte
    # that is no UTF-8 was replaced by three.)
    ends = states.select("file", "first", "bytes", "end_depth", "end_string", "size").distinct()
    closed = (F.col("bytes") - F.col("size")) % 2 == 0
    broken = ends.filter((F.col("end_string") != 0) | (F.col("end_depth") != F.when(closed, 0).otherwise(-1))
                         | ~F.col("first").isin("[", "{")).select("file")
    # One row per range (128 MB of text): small beside the text, which keeps its order in a broadcast join.
    placed = slim.join(F.broadcast(states.select("file", "start", "in_string", "depth", "level")), ["file", "start"])
    pieces = materialize(placed.mapInArrow(
        _cut, "file string, start long, number long, wanted boolean, text string, last boolean"), "range-pieces")
    ranges = pieces.groupBy("file", "start").agg(
        F.max("number").alias("cuts"), F.max_by("wanted", F.when(F.col("wanted").isNotNull(), F.col("number"))).alias("now"))
    before = ranges.select("file", "start", F.coalesce(F.sum("cuts").over(earlier), F.lit(0)).alias("base"),
                           F.last("now", ignorenulls=True).over(earlier).alias("was"))
    numbered = pieces.join(before, ["file", "start"]).select(
        "file", "start", (F.col("base") + F.col("number")).alias("element"), "text",
        F.coalesce("wanted", "was", F.lit(False)).alias("wanted"), ((F.col("number") == 0) | F.col("last")).alias("edge"))
    whole = numbered.filter(~F.col("edge") & F.col("wanted")).select("file", "element", "text")
    joined = numbered.filter("edge").groupBy("file", "element").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda s: s["text"]), "").alias("text"),
        F.max_by("wanted", "start").alias("wanted")).filter("wanted").select("file", "element", "text")
    elements = whole.unionByName(joined).withColumn("text", F.trim(F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "")))
    elements = elements.filter(F.col("text") != "").withColumn(
        "record", F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), "array<string>"))
    elements = materialize(elements.select("file", "element", F.get("record", F.lit(0)).alias("text"),
                                           F.coalesce(F.size("record") != 1, F.lit(True)).alias("malformed")), "range-elements")
    bad = broken.union(elements.filter("malformed").select("file")).distinct()
    starts = elements.groupBy("file").agg(F.min("element").alias("begin"))
    good = elements.join(starts, "file").join(bad, "file", "left_anti")
    return good.select("file", (F.col("element") - F.col("begin")).alias("src_pos"), "text"), bad

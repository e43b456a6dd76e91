"""Best-fit packing by minimum bin slack over a histogram of piece lengths.

Method
------
Documents are encoded by a public byte-level BPE (``tokenizers``) and end with id 0;
those longer than a sequence are cut into full pieces, the first of which takes the rest.

Minimum bin slack fills one bin at a time with the fullest feasible combination of the
lengths still available, found by subset-sum dynamic programming on an integer used as a
bitset: bit s of ``reach[i]`` says whether the lengths tried so far can sum to s. Only the
number of pieces of each length matters, so the plan works on a histogram that has at most
as many rows as a sequence has tokens. A combination is repeated as often as its lengths
last, which keeps the plan as short as that histogram, whatever the number of documents.
Pieces then meet the plan by (length, rank among the pieces of that length); ranks come from
per-partition counts, so no length gathers its pieces in one task.

Edge cases
----------
Null text is empty: one token, the closing id 0. Null ids and repeated rows are pieces
like any other. An empty table gives an empty table. Memory: one document's ids at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailsift.llm.common import materialize, releasing

#: Letters of the texts that are split here: ASCII, Latin-1 and Latin Extended-A.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
#: Splits such a text as the byte-level BPE does before it merges.
_PIECES = re.compile(
    rf" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: A text with any other character goes to the tokenizer whole (²³¹¼½¾ count as numbers there).
_OTHER = re.compile("[^\x00-\x1b\x20-±´-¸º»¿-ſ]")
_CONTROLS = "\x1c\x1d\x1e\x1f"


def _byte_names() -> dict[int, str]:
    """The characters by which byte-level BPE files name bytes: printable ones name themselves,
    the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()
#: Pieces of text a Python worker remembers: two generations of this many (about 220 bytes each).
REMEMBERED = 400_000
#: Writers of n ids, for the usual small n.
_WRITE = [struct.Struct(f"<{n}I").pack for n in range(33)]


def _spelled(piece: str) -> str:
    """The piece as byte-level BPE files spell it. Printable ASCII but the space names itself."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", _BYTE_NAMES[0x20])
    return piece.encode().decode("latin-1").translate(_BYTE_NAMES)


class Encoder:
    """ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Word pieces repeat, so their ids are remembered (a bounded number of them, the least
    recently used ones go first); pieces not yet seen go to the tokenizer's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: How many pieces each generation holds; None: ``REMEMBERED``.
        self.remembered: int | None = None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _full(self, more: set[str]) -> bool:
        return len(self.known) + len(more) > (self.remembered or REMEMBERED)

    def _learn(self, pieces: set[str]) -> None:
        if self._full(pieces):
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for piece in pieces:
            code = older.get(piece)
            if code is None:
                new.append(piece)
            else:
                known[piece] = code
        # A piece is one word to the model already, so its merges are asked for directly.
        merge = self.tokenizer.model.tokenize
        for piece in new:
            ids = [t.id for t in merge(_spelled(piece))]
            known[piece] = (_WRITE[len(ids)](*ids) if len(ids) < len(_WRITE)
                            else struct.pack(f"<{len(ids)}I", *ids))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        split: list[list[str] | None] = []
        codes: list = []
        get = self.known.get
        missing: set[str] = set()
        late = []
        for i, text in enumerate(texts):
            odd = any(c in text for c in _CONTROLS) if text.isascii() else _OTHER.search(text)
            if odd or any(s in text for s in self.special):
                codes.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                split.append(None)
                continue
            pieces = _PIECES.findall(text)
            found = list(map(get, pieces))
            try:
                codes.append(b"".join(found))
                split.append(None)
            except TypeError:  # some piece is not known yet
                missing.update(p for p, code in zip(pieces, found) if code is None)
                codes.append(None)
                split.append(pieces)
                late.append(i)
        if late:
            # Known pieces may move to the older generation meanwhile, so all of these texts' pieces are asked for.
            if self._full(missing):
                missing = {p for i in late for p in split[i]}
            self._learn(missing)
            known = self.known
            for i in late:
                codes[i] = b"".join(map(known.__getitem__, split[i]))
        return codes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_blocks(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` characters."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _cutter(path: str, capacity: int, remembered: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        encode.remembered = remembered
        closing = np.zeros(1, "<u4").tobytes()
        for batch in batches:
            ids = batch.column("id")
            texts = batch.column("text").to_pylist()
            for a, b in text_blocks(texts):
                rows: list[list] = [[], [], [], [], []]
                for i, code in zip(range(a, b), encode([t or "" for t in texts[a:b]])):
                    code += closing
                    n = len(code) // 4
                    first = n % capacity or capacity
                    for piece, start in enumerate([0, *range(first, n, capacity)] if n > capacity else [0]):
                        end = n if n <= capacity else (first if piece == 0 else start + capacity)
                        for column, value in zip(rows, (i, piece, start, end - start,
                                                        zlib.crc32(code[4 * start:4 * end]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                     pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()),
                     pa.array(rows[4], pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def fullest(lengths: list[int], counts: list[int], capacity: int, first: int) -> list[int]:
    """How many of each length fill one bin best: ``first`` (an index) once, then the subset
    of the rest with the largest sum that fits. Lengths fall; longer ones are preferred."""
    take = [0] * len(lengths)
    take[first] = 1
    room = capacity - lengths[first]
    if room <= 0:
        return take
    mask = (1 << (room + 1)) - 1
    # reach: bit s is set when s can be made. Binary splitting: 1, 2, 4, ... pieces of a length.
    steps: list[tuple[int, int, int]] = []  # (length index, pieces, reach before the step)
    reach = 1
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left = min(count - take[i], room // length)
        size = 1
        while left > 0:
            n = min(size, left)
            steps.append((i, n, reach))
            reach |= (reach << (n * length)) & mask
            left -= n
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> total & 1:
            take[i] += n
            total -= n * lengths[i]
    return take


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for a histogram length -> pieces: (how often, [(length, pieces), ...]) entries.

    Each bin starts with the longest piece left, so that no long piece remains for the end.
    """
    lengths = sorted((x for x, n in histogram.items() if n), reverse=True)
    counts = [histogram[x] for x in lengths]
    plan = []
    while lengths:
        take = fullest(lengths, counts, capacity, 0)
        times = min(n // t for n, t in zip(counts, take) if t)
        plan.append((times, [(x, t) for x, t in zip(lengths, take) if t]))
        counts = [n - t * times for n, t in zip(counts, take)]
        lengths, counts = ([x for x, n in zip(lengths, counts) if n], [n for n in counts if n])
    return plan


def pack(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id",
         text_col: str = "text", release: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    ``release``: workers remember fewer pieces and forget their encoder after each task, for jobs whose other
    stages need the memory.
    """
    spark = docs.sparkSession
    cutter = _cutter(path, capacity, REMEMBERED // 4 if release else None)
    pieces = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(releasing(cutter, _encoders.clear) if release else cutter, _piece_schema(docs, id_col))
        .withColumn("part", F.spark_partition_id()), "packing-pieces")
    # At most one row per possible length reaches the driver.
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(spark, plan_bins(histogram, capacity))
    # Rank of a piece among those of its length: pieces of earlier partitions, then order inside its own.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = (pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = (pieces.withColumn("nth", F.row_number().over(inside) - 1)
              .join(shares, ["length", "part"])
              .withColumn("rank", F.col("before") + F.col("nth")))
    # A slot range serves `pieces` per bin over `times` bins, from rank `lo` of its length on.
    # Every length has an array of its ranges; the last one that starts at or below a rank holds it.
    placed = ranked.join(F.broadcast(slots), "length").withColumn(
        "slot", F.element_at(F.filter("ranges", lambda r: r["lo"] <= F.col("rank")), -1))
    at = F.col("rank") - F.col("slot.lo")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_bin") + F.floor(at / F.col("slot.pieces"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + (at % F.col("slot.pieces")) * F.col("length")).cast("long").alias("offset"))


def _piece_schema(docs: DataFrame, id_col: str) -> str:
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return f"id {kind}, piece int, start long, length long, ids_crc32 long"


def _slots(spark: SparkSession, plan: list[tuple[int, list[tuple[int, int]]]]) -> DataFrame:
    """The plan by length: which ranks go to which bins, at which offset.

    Bounded: a plan has at most about twice as many entries as there are lengths, each with
    at most log2(capacity) distinct lengths or so.
    """
    used: dict[int, int] = {}
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for times, combination in plan:
        offset = 0
        for length, n in combination:
            lo = used.get(length, 0)
            ranges.setdefault(length, []).append((lo, n, first_bin, offset))
            used[length] = lo + times * n
            offset += length * n
        first_bin += times
    schema = "length long, ranges array<struct<lo: long, pieces: long, first_bin: long, offset: long>>"
    return spark.createDataFrame(list(ranges.items()), schema)

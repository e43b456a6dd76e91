"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star candidates.

Method
------
A document's set holds the 64-bit fingerprints of its distinct word shingles. One
permutation: the top bits of a fingerprint name its bin, and a bin's minimum is the
sketch value. Empty bins borrow from a bin chosen by a hash of (bin, attempt) (optimal
densification), so two documents that share a set agree on all bins. Bands of
``ROWS`` bins make bucket keys.

Candidates are stars: each bucket links its members to one centre, never to each other,
and each edge is confirmed on both full sets. A bucket is settled when all its members lie
in one component. In the buckets that are not, members of different components are
compared by their smallest fingerprints, in pieces of bounded size, and only pairs that
may be links leave the bucket, to be confirmed on full sets too. No bucket is capped and
no pair of a bucket is dropped.

Documents with equal sets are one node, so thousands of exact copies cost one edge each.
A pair of Jaccard similarity 0.8 shares no bucket with probability below 3e-6
((1 - 0.8**6)**42).

Edge cases
----------
Null or blank text: an empty set, a component of its own. Fewer words than the shingle
length: the whole sequence is the one shingle. Null id: never linked, ``component_id``
null, kept. Rows that repeat an id are one document, linked through any of their texts.
An empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import lower_ascii, materialize, releasing, row_blocks, string_bytes, word_starts
from trailsift.operators.components import connected_components

BINS, ROWS, BANDS = 256, 6, 42
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
#: Smallest fingerprints of a set that stand for it where a bucket's members are compared;
#: sets of at most so many are compared exactly, larger ones must reach MARGIN less.
LOW, MARGIN = 256, 18
#: Members of a bucket that are compared in one piece; larger buckets are split into pairs of pieces.
CHUNK = 1024
#: More candidate ids than this are joined by shuffle instead of broadcast (16 bytes each).
BROADCAST_IDS = 2_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def _stream(n: int, salt: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    at = np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(salt)
    return mix64(at) | np.uint64(1)


_POSITION = _stream(4096, 11)
_WORD_PLACE = _stream(64, 23)


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit fingerprint of every word of the rows, and each row's number of words."""
    global _POSITION
    data = lower_ascii(data)
    starts, counts = word_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    ends = np.append(starts[1:], len(data))
    # A row's end also ends its last word.
    row_end = offsets[1:][np.searchsorted(offsets[1:], starts, side="right")]
    ends = np.minimum(ends, row_end)
    hashes = np.empty(len(starts), np.uint64)
    word = 0
    while word < len(starts):  # pieces that end between words keep memory flat for long rows
        last = max(int(np.searchsorted(ends, starts[word] + BLOCK, side="right")), word + 1)
        lo, hi = starts[word], ends[last - 1]
        lengths = (np.append(starts[word + 1:last], hi) - starts[word:last])
        if lengths.max() > len(_POSITION):
            _POSITION = _stream(int(lengths.max()) * 2, 11)
        piece = data[lo:hi]
        place = np.arange(hi - lo) - np.repeat(starts[word:last] - lo, lengths)
        value = _POSITION[place] * (piece.astype(np.uint64) + np.uint64(1))
        space = (piece == 0x20) | ((piece >= 0x09) & (piece <= 0x0D))
        # Bytes after a word's end that belong to the gap before the next one.
        value[space] = 0
        hashes[word:last] = np.add.reduceat(value, starts[word:last] - lo)
        word = last
    return mix64(hashes), counts


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of the ``size``-word shingles of one document."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    value = np.full(n - k + 1, (k * int(_GOLD)) & (1 << 64) - 1, np.uint64)
    for j in range(k):
        value += words[j:n - k + 1 + j] * _WORD_PLACE[j]
    return np.unique(mix64(value))


def _donors(attempts: int = 256) -> np.ndarray:
    """For each bin the bins it tries, in order, when it is empty."""
    bins, tries = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(attempts, dtype=np.uint64),
                              indexing="ij")
    return (mix64(bins * _GOLD + tries * _M2 + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)


_DONORS = _donors()
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
_BAND_PLACE = _stream(BANDS * ROWS, 41).reshape(BANDS, ROWS)
_BAND_SALT = _stream(BANDS, 59)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each bin of a sorted, non-empty set; empty bins densified."""
    at = np.searchsorted(shingles, _EDGES)
    found = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((found >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64))
    if full.all():
        return found
    if len(shingles) == 1:
        return np.repeat(shingles, BINS)
    empty = np.flatnonzero(~full)
    tried = full[_DONORS[empty]]
    first = tried.argmax(axis=1)
    donor = _DONORS[empty, first]
    missed = ~tried[np.arange(len(empty)), first]
    if missed.any():  # no full bin among all attempts: the next full one in a circle
        there = np.flatnonzero(full)
        donor[missed] = there[np.searchsorted(there, empty[missed]) % len(there)]
    value = found.copy()
    value[empty] = found[donor]
    return value


def band_keys(value: np.ndarray) -> np.ndarray:
    grid = value[:BANDS * ROWS].reshape(BANDS, ROWS)
    return mix64((grid * _BAND_PLACE).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        for a, b in row_blocks(offsets, BLOCK):
            words, counts = hash_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            ends = np.cumsum(counts)
            sets = [shingle_set(words[e - c:e], size) for c, e in zip(counts, ends)]
            yield batch.slice(a, b - a), sets


def _sketcher(size: int):
    def run(batches):
        for rows, sets in _sets(batches, size):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [band_keys(sketch(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "set_key", "bands"])
    return run


def _full_sets(size: int):
    def run(batches):
        for rows, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([(s[:LOW] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())],
                names=["id", "shingles", "low"])
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("left_set"), batch.column("right_set")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep))
    return run


class _Bucket:
    """Members of one bucket (or of two of its pieces) of which pairs are compared."""

    def __init__(self, own, node, n, comp, low):
        self.own, self.node, self.n, self.comp = own, node, n, comp.copy()
        values = [np.frombuffer(x, "<u4") for x in low]
        self.starts = np.cumsum([0, *map(len, values)])
        self.values = np.concatenate(values)
        # Up to here a member's fingerprints are all known.
        self.until = np.array([v[-1] if k > len(v) else 0xFFFFFFFF for v, k in zip(values, n)], np.uint32)

    def similar(self, c: int, rest: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``rest`` may reach ``percent`` with member c, judged by the fingerprints both know."""
        mine = self.values[self.starts[c]:self.starts[c + 1]]
        sizes = self.starts[rest + 1] - self.starts[rest]
        begin = np.cumsum(sizes) - sizes
        theirs = self.values[np.repeat(self.starts[rest] - begin, sizes) + np.arange(sizes.sum())]
        inside = theirs <= self.until[c]
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        both = np.add.reduceat((mine[at] == theirs) & inside, begin, dtype=np.int64)
        known_theirs = np.add.reduceat(inside, begin, dtype=np.int64)
        known_mine = np.searchsorted(mine, self.until[rest], side="right")
        whole = (self.until[rest] == 0xFFFFFFFF) & (self.until[c] == 0xFFFFFFFF)
        need = np.where(whole, percent, percent - MARGIN)
        return 100 * both >= need * (known_mine + known_theirs - both)

    def pairs(self, percent: int):
        """Pairs of different components that may be links."""
        across = len(np.unique(self.own)) > 1
        for c in range(len(self.node) - 1):
            rest = np.arange(c + 1, len(self.node))
            ok = (self.comp[rest] != self.comp[c]) & (
                100 * np.minimum(self.n[rest], self.n[c]) >= percent * np.maximum(self.n[rest], self.n[c]))
            if across:
                ok &= self.own[rest] != self.own[c]
            rest = rest[ok]
            if len(rest):
                for other in rest[self.similar(c, rest, percent)]:
                    yield self.node[c], self.node[other]


def _open_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            column = {c: rows.column(c).to_numpy() for c in ("band", "i", "j", "own", "node", "n", "comp")}
            low = rows.column("low").to_pylist()
            key = np.stack([column["band"], column["i"], column["j"]])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            out = []
            for a, b in zip([0, *cut], [*cut, rows.num_rows]):
                if b - a > 1:
                    out.extend(_Bucket(*(column[c][a:b] for c in ("own", "node", "n", "comp")),
                                       low[a:b]).pairs(percent))
            x, y = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y).astype(np.int64)),
                                               pa.array(np.maximum(x, y).astype(np.int64))], names=["x", "y"])

        for batch in batches:  # a bucket may go on in the next batch
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("band", "i", "j")]
            last = np.ones(batch.num_rows, bool)
            for k in key:
                last &= k == k[-1]
            begin = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if begin == 0 and waiting and any(waiting[-1].column(c)[0].as_py() != batch.column(c)[0].as_py()
                                              for c in ("band", "i", "j")):
                yield found(pa.Table.from_batches(waiting))
                waiting = []
            elif begin:
                yield found(pa.Table.from_batches([*waiting, batch.slice(0, begin)]))
                waiting = []
            waiting.append(batch.slice(begin))
        if waiting:
            yield found(pa.Table.from_batches(waiting))
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per input row.

    ``component_id`` is the smallest id reachable over links, where a link is a pair
    with 100 * intersection >= ``percent`` * union of their full shingle sets.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    meta = materialize(texts.mapInArrow(
        releasing(_sketcher(shingle)), "id long, n_shingles long, set_key binary, bands array<long>"), "minhash-meta")

    # One node per distinct set: the smallest id that has it. An id that repeats with another
    # text ties both sets together below.
    nodes = materialize(
        meta.filter(F.col("set_key").isNotNull() & F.col("id").isNotNull())
        .groupBy("set_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"),
                                F.first("bands").alias("bands")), "minhash-nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre"),
                                       F.min_by("n", "node").alias("centre_n")).filter("size > 1")
    members = materialize(rows.join(buckets, "band"), "minhash-members")

    wanted = materialize(members.select(F.col("node").alias("id")).distinct(), "minhash-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = materialize(texts.join(wanted, "id", "left_semi").mapInArrow(
        releasing(_full_sets(shingle)), "id long, shingles binary, low binary"), "minhash-sets")

    def confirmed(edges: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("x"), F.col("shingles").alias("left_set"))
        right = sets.select(F.col("id").alias("y"), F.col("shingles").alias("right_set"))
        return (edges.join(left, "x").join(right, "y").select("x", "y", "left_set", "right_set")
                .mapInArrow(releasing(_confirm(percent)), "x long, y long"))

    def comparable(a: str, b: str):
        return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)

    stars = members.filter((F.col("node") != F.col("centre")) & comparable("n", "centre_n")).select(
        F.col("node").alias("x"), F.col("centre").alias("y")).distinct()
    roots = materialize(connected_components(
        confirmed(stars).unionByName(_repeated_ids(meta, nodes))), "minhash-roots")
    # Buckets whose members still lie in several components: every pair between different
    # components that the stars did not try, compared inside the bucket.
    placed = members.filter("size > 2").filter(F.col("node") != F.col("centre")).join(
        roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(
        F.col("lo") != F.col("hi")).select("band")
    chunks = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    untried = (placed.join(split, "band", "left_semi")
               .withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int"))
               # A row meets every chunk of its bucket once: as (own, other) with the smaller first.
               .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
               .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       "own", "node", "n", "comp")
               .join(sets.select(F.col("id").alias("node"), "low"), "node"))
    pairs = materialize(untried.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
                        .mapInArrow(releasing(_open_pairs(percent)), "x long, y long").distinct(), "minhash-open")
    if not pairs.isEmpty():
        roots = materialize(connected_components(confirmed(pairs).unionByName(
            roots.select(F.col("node").alias("x"), F.col("root").alias("y")))), "minhash-roots")
    per_set = nodes.select("set_key", "node").join(roots, "node", "left").select(
        "set_key", F.coalesce("root", "node").alias("component_id"))
    return (meta.select("id", "n_shingles", "set_key").join(per_set, "set_key", "left")
            .select(F.col("id").alias(id_col), "n_shingles",
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def _repeated_ids(meta: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that tie together the sets of an id whose rows have different texts."""
    known = meta.filter(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    several = known.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter(
        F.col("lo") != F.col("hi")).select("id")
    return (known.select("id", "set_key").join(several, "id").join(nodes.select("set_key", "node"), "set_key")
            .filter(F.col("id") != F.col("node")).select(F.col("id").alias("x"), F.col("node").alias("y")))

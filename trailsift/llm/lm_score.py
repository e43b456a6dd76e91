"""Language-model scores of whole documents: corpus word counts and a self-attention model.

Method
------
One pass encodes every document: 64-bit fingerprints of its words, written as places in the
dictionary of its block of rows, and subword ids of a public BPE. Dictionaries are summed by
word over all training documents and the totals return to their blocks, so a word costs one
row per block however often it occurs. The attention model (``attention``) learns its
vocabulary and unigram from all training documents and its weights from all their windows,
dealt to shards in spans: one shard starts the model, then all shards train from there side by
side and their weights are averaged. Every document is then scored with overlapping windows.

No training window is left out: what is gathered grows with the corpus.

Edge cases
----------
Null or blank text: only the end token. Null ids: scored, not learned from. Repeated rows
count and are scored like any other. Without a training document the base score is 0 and
the model is uniform. An empty table gives an empty table. Two words with one 64-bit
fingerprint would share a count (below 1e-6 for ten million distinct words).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.llm import attention as att
from trailsift.llm.common import row_blocks, string_bytes
from trailsift.llm.minhash import hash_words
from trailsift.llm.packing import encoder
from trailsift.session import ensure_checkpoint_dir, table_path

#: Text bytes that share a dictionary, and rows of one piece of it.
BLOCK = 32 << 20
PIECE = 1 << 16
#: Subword ids the model knows by themselves; the others share one place.
VOCABULARY = 8192
#: A shard's tokens, and the windows of a document that go to one shard together.
SHARD_TOKENS, SPAN = 2_000_000, 1024
MAX_PASSES = 6


def _written(df: DataFrame, name: str) -> DataFrame:
    """Like ``materialize``, in a denser format: ids compress well."""
    import uuid
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = table_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


ENCODED = ("row long, block long, id {kind}, held_out boolean, learn boolean, codes binary, subs binary, "
           "piece int, words binary, counts binary, sub_ids binary, sub_counts binary")


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        block = TaskContext.get().partitionId() << 24  # with the place in it, a row's key
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for a, b in row_blocks(offsets, BLOCK):
                yield from _encode_block(encode, batch.slice(a, b - a), data[offsets[a]:offsets[b]],
                                         offsets[a:b + 1] - offsets[a], block)
                block += 1
    return run


def _encode_block(encode, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, block: int):
    hashes, n_words = hash_words(data, offsets)
    codes, words = pd.factorize(hashes)
    codes = codes.astype("<u4")
    learn = np.array(rows.column("learn").to_pylist(), bool)
    counts = np.bincount(codes, np.repeat(learn, n_words), len(words)).astype("<u4")
    ends = np.cumsum(n_words)
    texts = bytes(data).lower()  # A-Z only, being bytes
    sub_total = np.zeros(0, np.int64)
    nothing = pa.nulls
    for a, b in row_blocks(offsets, 1 << 20):
        ids = encode([texts[offsets[i]:offsets[i + 1]].decode("utf-8", "replace") for i in range(a, b)])
        subs = [np.frombuffer(x, "<u4") for x in ids]
        found = np.bincount(np.concatenate([x for i, x in zip(range(a, b), subs) if learn[i]] or [[]]).astype(np.int64))
        if len(found) > len(sub_total):
            sub_total = np.pad(sub_total, (0, len(found) - len(sub_total)))
        sub_total[:len(found)] += found
        n, part = b - a, rows.slice(a, b - a)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(a, b)), pa.array(np.full(n, block, np.int64)),
            part.column("id"), part.column("held_out"), part.column("learn"),
            pa.array([codes[ends[i] - n_words[i]:ends[i]].tobytes() for i in range(a, b)], pa.binary()),
            pa.array([x.astype("<u2").tobytes() for x in subs], pa.binary()),
            nothing(n, pa.int32()), *[nothing(n, pa.binary()) for _ in range(4)]],
            names=[c.split()[0] for c in ENCODED.split(", ")])
    kind = rows.schema.field("id").type
    seen = np.flatnonzero(sub_total)
    pieces = range(0, max(len(words), 1), PIECE)
    n = len(pieces)
    yield pa.RecordBatch.from_arrays([
        nothing(n, pa.int64()), pa.array(np.full(n, block, np.int64)), nothing(n, kind),
        nothing(n, pa.bool_()), nothing(n, pa.bool_()), nothing(n, pa.binary()), nothing(n, pa.binary()),
        pa.array(range(n), pa.int32()),
        pa.array([words[p:p + PIECE].astype("<u8").tobytes() for p in pieces], pa.binary()),
        pa.array([counts[p:p + PIECE].tobytes() for p in pieces], pa.binary()),
        pa.array([seen.astype("<u4").tobytes() if p == 0 else b"" for p in pieces], pa.binary()),
        pa.array([sub_total[seen].astype("<u8").tobytes() if p == 0 else b"" for p in pieces], pa.binary())],
        names=[c.split()[0] for c in ENCODED.split(", ")])


def _dictionary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, piece, words, counts in zip(*(batch.column(c).to_pylist() for c in
                                                 ("block", "piece", "words", "counts"))):
            words = np.frombuffer(words, "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(words), pa.array(np.full(len(words), block, np.int64)),
                pa.array(piece * PIECE + np.arange(len(words), dtype=np.int32)),
                pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], names=["word", "block", "place", "n"])


def _subword_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, counts in zip(batch.column("sub_ids").to_pylist(), batch.column("sub_counts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<u4").astype(np.int32)),
                                              pa.array(np.frombuffer(counts, "<u8").astype(np.int64))],
                                             names=["sub", "n"])


def _base_scores(total: int, distinct: int, end_count: int):
    """Scores of one block's documents from the corpus counts of its dictionary."""
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        counts = np.zeros(int(found.num_rows), np.int64)
        counts[found.column("place").to_numpy()] = found.column("total").to_numpy()
        below = np.log10(total + 0.5 * (distinct + 1))
        logs = np.log10(counts + 0.5) - below
        rows = docs.num_rows
        n_tokens, n_known, base = np.ones(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
        end = float(np.log10(end_count + 0.5) - below)
        for i, codes in enumerate(docs.column("codes").to_pylist()):
            at = np.frombuffer(codes, "<u4")
            n_tokens[i] += len(at)
            n_known[i] = int((counts[at] > 0).sum()) + (end_count > 0)
            base[i] = float(logs[at].sum()) + end
        return pa.table({"row": docs.column("row"), "block": docs.column("block"), "n_tokens": n_tokens, "n_known": n_known, "base_score": base})
    return run


class Scorer:
    """The model with its vocabulary: what a task needs to score subword ids."""

    def __init__(self, counts: np.ndarray, texts: int, size: int = VOCABULARY):
        """counts: of each subword id in the training documents; texts: how many these are."""
        order = np.argsort(-counts, kind="stable")[:size - 2]
        self.closing, self.other = len(order) + 1, len(order)
        self.place = np.full(65536, self.other, np.int64)
        self.place[order] = np.arange(len(order))
        # Ids without a place of their own share one, by their own counts.
        rest = counts.astype(float) + 0.5
        rest[order] = 0
        self.inside = np.zeros(65536)
        self.inside[order] = 1.0
        if rest.sum():
            self.inside[:len(rest)] += rest / rest.sum()
        unigram = np.append(counts[order] + 0.5, [rest.sum() + 0.5, texts + 0.5])
        self.model = att.Attention(unigram / unigram.sum())
        self.tables: tuple | None = None  # the trained model's, made when it scores

    def windows(self, subs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return att.text_windows(self.place[subs], self.closing)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        if self.tables is None:
            self.tables = self.model.table(), self.model.components()
        places = [self.place[x] for x in texts]
        runs, real, scored, starts = att.span_runs([att.text_line(x, self.closing, self.other + 2) for x in places],
                                                   self.other + 2)
        p = self.model.run_probabilities(runs, real, *self.tables)
        logs = np.where(scored, np.log10(np.maximum(p, 1e-30)), 0).astype(float)
        out = np.add.reduceat(logs.ravel(), starts)
        for i, (x, place) in enumerate(zip(texts, places)):
            if (place == self.other).any():
                out[i] += np.log10(self.inside[x]).sum()
        return out


def _score_rows(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = pickle.loads(model)
        for batch in batches:
            data, offsets = string_bytes(batch.column("subs"))
            for a, b in row_blocks(offsets, 1 << 18):
                subs = [data[offsets[i]:offsets[i + 1]].view("<u2") if offsets[i + 1] > offsets[i]
                        else np.zeros(0, np.int64) for i in range(a, b)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "block", "id", "held_out")), pa.array(scorer.score(subs))],
                    names=["row", "block", "id", "held_out", "score"])
    return run


def _dealer(model: bytes, shards: int, only: int | None = None):
    """All training windows, dealt to shards by spans of a document (those of shard ``only``, if given).

    A span is the line its windows are cut from: 2 bytes a token, where the windows overlap. The shard follows
    from the document's id and text alone, not from where it is stored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = pickle.loads(model)
        for batch in batches:
            found, spans = [], []
            for doc, subs in zip(batch.column("id").to_pylist(), batch.column("subs").to_pylist()):
                seed = crc32(str(doc).encode()), crc32(subs)
                subs = np.frombuffer(subs, "<u2")
                n = att.window_count(len(subs))
                to = np.random.default_rng(seed).integers(shards, size=-(-n // SPAN))
                if only is not None and not (to == only).any():
                    continue
                line = att.text_line(scorer.place[subs], scorer.closing, scorer.other + 2).astype("<u2")
                for k, shard in enumerate(to.tolist()):
                    if only is None or shard == only:
                        found.append(shard)
                        spans.append(att.line_span(line, k * SPAN, min((k + 1) * SPAN, n)).tobytes())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(spans, pa.binary())],
                                                 names=["shard", "span"])
    return run


def _trainer(model: bytes, passes: int, rate: float, floor: float):
    """Trains on one shard from the given start and returns the weights by row, for averaging."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        scorer = pickle.loads(model)
        ids = np.concatenate([att.span_windows(np.frombuffer(s, "<u2")) for s in sorted(rows["span"])]).astype(np.int64)
        real = ids != scorer.other + 2
        net = scorer.model.train(np.where(real, ids, 0), real, passes, rate, floor)
        table = np.concatenate([getattr(net, n) for n in net.NAMES], axis=1)
        values = [*table.astype("<f4"), np.pad(net.distance, (0, table.shape[1] - att.WINDOW)).astype("<f4")]
        return pd.DataFrame({"place": np.arange(len(values)), "weight": float(len(ids)),
                             "values": [v.tobytes() for v in values]})
    return run


def _task_means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weighted means of one task's shards: a task sends one model however many shards it trained."""
    sums: dict[int, np.ndarray] = {}
    weights: dict[int, float] = {}
    for rows in frames:
        for place, weight, values in zip(rows["place"], rows["weight"], rows["values"]):
            part = np.frombuffer(values, "<f4") * weight
            sums[place] = sums[place] + part if place in sums else part
            weights[place] = weights.get(place, 0.0) + weight
    if sums:
        places = sorted(sums)
        yield pd.DataFrame({"place": places, "weight": [weights[p] for p in places],
                            "values": [(sums[p] / weights[p]).astype("<f4").tobytes() for p in places]})


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    """Means of the tasks' rows for one range of places, weighted by their windows."""
    out = []
    for place, group in rows.groupby("place"):
        values = np.stack([np.frombuffer(v, "<f4") for v in group["values"]]).astype(float)
        out.append((place, np.average(values, axis=0, weights=group["weight"]).astype("<f4").tobytes()))
    return pd.DataFrame(out, columns=["place", "values"])


def _trained(scorer: Scorer, spans: DataFrame, passes: int, rate: float, floor: float) -> Scorer:
    """One round: all shards of ``spans`` train from ``scorer``; the means replace its weights.

    The model's rows (their number is fixed by VOCABULARY) are collected.
    """
    kind = "place int, weight double, values binary"
    rows = (spans.groupBy("shard").applyInPandas(_trainer(pickle.dumps(scorer), passes, rate, floor), kind)
        .mapInPandas(_task_means, kind)
        .withColumn("range", F.floor(F.col("place") / 64))
        .groupBy("range").applyInPandas(_average, "place int, values binary").collect())
    if not rows:
        return scorer
    values = [np.frombuffer(r["values"], "<f4") for r in sorted(rows, key=lambda r: r["place"])]
    net = scorer.model
    net.distance = values[-1][:att.WINDOW].copy()
    table, at = np.stack(values[:-1]), 0
    for name in net.NAMES:
        width = getattr(net, name).shape[1]
        setattr(net, name, table[:, at:at + width].copy())
        at += width
    return scorer


def fit(docs: DataFrame, counts: np.ndarray, texts: int) -> Scorer:
    """The model from all encoded documents; ``counts`` are those of the training documents."""
    scorer = Scorer(counts, texts)
    tokens = int(counts.sum())
    if not tokens:
        return scorer
    shards = max(1, round(tokens / SHARD_TOKENS))
    passes = int(min(MAX_PASSES, max(1, round(2 * SHARD_TOKENS * shards / tokens))))
    learned, start = docs.filter("learn").select("id", "subs"), pickle.dumps(scorer)
    first = learned.mapInArrow(_dealer(start, shards, 0), "shard int, span binary")
    scorer = _trained(scorer, first, passes, 0.012, 0.004)
    return _trained(scorer, learned.mapInArrow(_dealer(start, shards), "shard int, span binary"), 1, 0.004, 0.0005)


def score_documents(docs: DataFrame, path: str, held_out: Column, learn: Column, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    encoded = _written(rows.mapInArrow(_encoder(path), ENCODED.format(kind=kind)), "lm-encoded")
    texts = encoded.filter(F.col("row").isNotNull())
    pieces = encoded.filter(F.col("piece").isNotNull())
    places = pieces.select("block", "piece", "words", "counts").mapInArrow(
        _dictionary_rows, "word long, block long, place int, n long")
    # A frequent word has a row in every block: its rows are combined before they meet, and joined back.
    totals = places.groupBy("word").agg(F.sum("n").alias("total"), F.min("block").alias("first"))
    dictionary = _written(places.join(totals, "word").select(
        "block", "place", "total", ((F.col("block") == F.col("first")) & (F.col("total") > 0)).alias("new"), "n"),
        "lm-counts")
    learned = texts.filter("learn").count()
    sums = dictionary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                          F.count_if("new").alias("distinct")).collect()[0]
    total, distinct = sums["n"] + learned, sums["distinct"] + (learned > 0)
    base = (texts.select("row", "block", "codes").groupBy("block")
            .cogroup(dictionary.select("block", "place", "total").groupBy("block"))
            .applyInArrow(_base_scores(total, distinct, learned),
                          "row long, block long, n_tokens long, n_known long, base_score double"))
    # At most one row per subword id of the vocabulary file.
    sub_rows = pieces.select("sub_ids", "sub_counts").mapInArrow(_subword_rows, "sub int, n long").groupBy("sub").agg(
        F.sum("n").alias("n")).collect()
    counts = np.zeros(65536, np.int64)
    for r in sub_rows:
        counts[r["sub"]] = r["n"]
    scorer = fit(texts, counts, learned)
    scored = texts.select("row", "block", "id", "held_out", "subs").mapInArrow(
        _score_rows(pickle.dumps(scorer)), f"row long, block long, id {kind}, held_out boolean, score double")
    return scored.join(base, ["block", "row"]).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score")

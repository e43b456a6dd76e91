"""Language identification by a bidirectional gated recurrent network over bytes.

Method
------
Texts are cut into blocks of ``STEPS`` bytes. A gated recurrent network reads each block
in both directions; every position gets a distribution over the languages from the two
states around it, and a document's probabilities are the mean over all its positions. The
network is trained in numpy by backpropagation through time on a bounded sample of
labelled rows, in one task. Gates use the soft sign x / (1 + |x|), which is cheaper than
tanh and has a plain derivative. All blocks of a batch of rows run side by side, so a very
long text is many independent blocks and memory stays flat.

Edge cases
----------
Null text and text without a letter get ``und`` and score 0. Rows without a label or an
id are never learned from. With no labelled row at all, every document is ``und``. Null ids
and repeated rows are labelled like any other; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from trailsift.llm.common import releasing, row_blocks, string_bytes

#: Bytes of a block; units of a state in one direction; blocks that run side by side.
STEPS, UNITS, WIDTH = 64, 8, 2048
#: The training sample: rows of each language, and blocks of each of these rows.
SAMPLE_ROWS, SAMPLE_BLOCKS = 400, 6
#: Rows of the whole sample: with very many languages each has an equal share of them, but a row at least.
SAMPLE_TOTAL = 80_000
UNKNOWN = "und"
_PAD = 256


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Gru:
    """One direction. Shapes: table (257, 3H) per byte, U (H, 3H); gate order z, r, candidate."""

    def __init__(self, rng: np.random.Generator):
        h = UNITS
        self.table = (rng.standard_normal((_PAD + 1, 3 * h)) * 0.5).astype(np.float32)
        self.u = (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)

    def forward(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """codes (T, B) -> states (T, B, H). ``keep`` collects what backward() needs."""
        h = UNITS
        steps, width = codes.shape
        out = np.empty((steps, width, h), np.float32)
        state = np.zeros((width, h), np.float32)
        for t in range(steps):
            x = self.table[codes[t]]
            gates = x[:, :2 * h] + state @ self.u[:, :2 * h]
            soft = gates / (1 + np.abs(gates))
            soft *= 0.5
            soft += 0.5
            z, r = soft[:, :h], soft[:, h:]
            reset = r * state
            raw = x[:, 2 * h:] + reset @ self.u[:, 2 * h:]
            cand = raw / (1 + np.abs(raw))
            new = state + z * (cand - state)
            if keep is not None:
                keep.append((state, gates, z, r, reset, raw, cand))
            out[t] = state = new
        return out

    def backward(self, codes: np.ndarray, keep: list, grad_out: np.ndarray):
        """Gradients of table and U for dLoss/dstates (T, B, H)."""
        h = UNITS
        g_table, g_u = np.zeros_like(self.table), np.zeros_like(self.u)
        carry = np.zeros_like(grad_out[0])
        for t in range(len(keep) - 1, -1, -1):
            state, gates, z, r, reset, raw, cand = keep[t]
            g = grad_out[t] + carry
            g_cand = g * z
            g_z = g * (cand - state)
            g_raw = g_cand / np.square(1 + np.abs(raw))
            g_reset = g_raw @ self.u[:, 2 * h:].T
            g_gates = np.concatenate([g_z, g_reset * state], axis=1) * 0.5 / np.square(1 + np.abs(gates))
            carry = g * (1 - z) + g_reset * r + g_gates @ self.u[:, :2 * h].T
            g_u[:, :2 * h] += state.T @ g_gates
            g_u[:, 2 * h:] += reset.T @ g_raw
            np.add.at(g_table, codes[t], np.concatenate([g_gates, g_raw], axis=1))
        return g_table, g_u


class Network:
    """Two directions and a softmax over languages at every position."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng), Gru(rng)
        self.w = (rng.standard_normal((2 * UNITS, len(languages))) * 0.3).astype(np.float32)
        self.b = np.zeros(len(languages), np.float32)

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """codes (T, B) -> probabilities (T, B, languages)."""
        states = np.concatenate([self.ahead.forward(codes), self.back.forward(codes[::-1])[::-1]], axis=2)
        return _softmax(states @ self.w + self.b)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all positions that are no padding."""
        ka, kb = [], []
        sa, sb = self.ahead.forward(codes, ka), self.back.forward(codes[::-1], kb)
        states = np.concatenate([sa, sb[::-1]], axis=2)
        p = _softmax(states @ self.w + self.b)
        p[:, np.arange(codes.shape[1]), labels] -= 1
        real = codes != _PAD
        p *= (real / max(int(real.sum()), 1))[:, :, None]
        g_w = np.einsum("tbh,tbk->hk", states, p)
        g_states = p @ self.w.T
        ga = self.ahead.backward(codes, ka, g_states[:, :, :UNITS])
        gb = self.back.backward(codes[::-1], kb, g_states[::-1, :, UNITS:])
        return [*ga, *gb, g_w, p.sum(axis=(0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.u, self.back.table, self.back.u, self.w, self.b]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def train(blocks: list[bytes], labels: list[str], epochs: int = 4, batch: int = 128, rate: float = 0.02,
          seed: int = 1) -> Network:
    """Adam over shuffled blocks; languages weigh the same whatever their number of blocks."""
    languages = sorted(set(labels))
    network = Network(languages, seed)
    codes = np.full((len(blocks), STEPS), _PAD, np.int64)
    for i, block in enumerate(blocks):
        codes[i, :len(block)] = np.frombuffer(block, np.uint8)
    target = np.searchsorted(np.array(languages, object), np.array(labels, object))
    rng = np.random.default_rng(seed)
    share = 1.0 / np.bincount(target, minlength=len(languages))[target]
    share /= share.sum()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    steps = max(60, epochs * len(blocks) // batch)
    for step in range(1, steps + 1):
        pick = rng.choice(len(blocks), batch, p=share)
        lr = rate * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(network.parameters(), network.gradients(codes[pick].T, target[pick]), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return network


def _blocks_of(text: str, key: int) -> list[bytes]:
    """A few blocks of one sampled text, from all over it."""
    data = text.encode()
    starts = np.arange(0, max(len(data), 1), STEPS)
    if len(starts) > SAMPLE_BLOCKS:
        starts = np.random.default_rng(key & 0x7FFFFFFF).choice(starts, SAMPLE_BLOCKS, replace=False)
    return [data[s:s + STEPS] for s in starts if data[s:s + STEPS]]


def fit(labelled: DataFrame, text_col: str, lang_col: str, order: Column) -> bytes | None:
    """A pickled Network, or None without a labelled row.

    Every label is learned. At most SAMPLE_ROWS rows of each language (SAMPLE_TOTAL of all) are learned
    from: those with the smallest ``order`` (a hash), found among the share of rows that is
    expected to hold twice as many. Their blocks are cut where the rows are, so that the task that
    learns receives a few hundred bytes of each, whatever the lengths of the texts.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                           order.alias("at")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("at").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each label
    if not sizes:
        return None
    most = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // len(sizes)))
    place = F.col("at").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    below = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (
        r["lang"], min(1.0, (2 * most + 50) / r["n"]))]), F.col("lang"))
    first = Window.partitionBy("lang").orderBy("at", "tie")
    cut = rows.filter(place < below).withColumn("tie", F.xxhash64("text")).mapInPandas(
        releasing(_cut_blocks), "lang string, at long, tie long, blocks array<binary>")
    sample = (cut.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most)
              .groupBy(F.lit(1).alias("one")).applyInPandas(_train_on, "model binary"))
    models = sample.collect()
    return bytes(models[0]["model"]) if models else None


def _cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        rows["blocks"] = [_blocks_of(text, int(key)) for text, key in zip(rows["text"], rows["at"])]
        yield rows[["lang", "at", "tie", "blocks"]]


def _train_on(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["lang", "at", "tie"])
    blocks, labels = [], []
    for lang, some in zip(rows["lang"], rows["blocks"]):
        for block in some:
            blocks.append(bytes(block))
            labels.append(lang)
    network = train(blocks, labels) if blocks else None
    return pd.DataFrame({"model": [pickle.dumps(network)]})


def _document_scores(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability of every language over each row's positions; zeros for empty rows."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = -(-sizes // STEPS)
    owner = np.repeat(np.arange(rows), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][owner] + nth * STEPS
    lengths = np.minimum(offsets[1:][owner] - starts, STEPS)
    totals = np.zeros((rows, len(network.languages)))
    span = np.arange(STEPS)[:, None]
    for a in range(0, len(owner), WIDTH):
        at, n = starts[a:a + WIDTH], lengths[a:a + WIDTH]
        real = span < n[None, :]
        codes = np.where(real, data[np.minimum(at[None, :] + span, len(data) - 1)], _PAD)
        p = network.positions(codes)
        p *= real[:, :, None]
        np.add.at(totals, owner[a:a + WIDTH], p.sum(axis=0))
    return totals / np.maximum(sizes, 1)[:, None]


def _labeller(model: bytes, text: str):
    """Labels the column ``text``; all columns but ``__text`` go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = pickle.loads(model)
        names = np.array(network.languages, object)
        for batch in batches:
            data, offsets = string_bytes(batch.column(text))
            names_on = [c for c in batch.schema.names if c != "__text"]
            for a, b in row_blocks(offsets, 1 << 20):
                scores = _document_scores(network, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                best = scores.argmax(axis=1)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names_on), pa.array(names[best], pa.string()),
                     pa.array(np.clip(scores.max(axis=1), 0, 1))],
                    names=[*names_on, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: bytes | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (none named lang_pred or score) with ``lang_pred`` and ``score``, for every row."""
    lettered = F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    # A text that is kept anyway travels once.
    text = text_col if text_col in keep and docs.schema[text_col].dataType == StringType() else "__text"
    slim = docs.select(*keep, F.coalesce(lettered, F.lit(False)).alias("__lettered"),
                       *([F.col(text_col).cast("string").alias("__text")] if text == "__text" else []))
    if model is None or pickle.loads(model) is None:
        return slim.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = StructType([*slim.drop("__text").schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    found = slim.mapInArrow(releasing(_labeller(model, text)), schema)
    return found.select(*keep, F.when(F.col("__lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                        F.when(F.col("__lettered"), F.col("score")).otherwise(0.0).alias("score"))

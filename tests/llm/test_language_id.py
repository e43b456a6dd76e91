import pickle

import numpy as np

from pyspark.sql import functions as F

from trailsift.llm import language_id as li
from trailsift.llm.queries import QUERIES


def test_backpropagation_against_differences():
    rng = np.random.default_rng(0)
    network = li.Network(["a", "b", "c"], 2)
    codes = rng.integers(0, 257, (5, 4))
    labels = np.array([0, 2, 1, 1])
    grads = network.gradients(codes, labels)

    def loss():
        p = network.positions(codes)[:, np.arange(4), labels].astype(float)
        return -np.log(p)[codes != 256].mean()

    for p, g in zip(network.parameters(), grads):
        flat = np.argsort(-np.abs(g.ravel()))[:4]
        for k in flat:
            at = np.unravel_index(k, p.shape)
            before = p[at]
            p[at] = before + 1e-2
            up = loss()
            p[at] = before - 1e-2
            down = loss()
            p[at] = before
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_blocks_cover_whole_documents():
    network = li.Network(["a", "b"], 3)
    text = bytes(range(32, 127)) * 7
    data = np.frombuffer(text + b"x", np.uint8)
    scores = li._document_scores(network, data, np.array([0, len(text), len(text), len(text) + 1]))
    parts = [li._document_scores(network, data, np.array([i, min(i + li.STEPS, len(text))]))[0]
             * (min(i + li.STEPS, len(text)) - i) for i in range(0, len(text), li.STEPS)]
    assert np.allclose(scores[0], sum(parts) / len(text), atol=1e-6)
    assert not scores[1].any() and np.isclose(scores[2].sum(), 1, atol=1e-5)


def test_held_out_accuracy(spark, sf_small):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op1_language_id"](spark, sf_small).collect() if r["held_out"]]
    assert rows and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows]) >= 0.95


def test_every_label_is_learned(spark):
    rows = [(i, f"text of {i}", f"l{i % 250:03d}") for i in range(500)] + [(900, "no label", None), (901, None, "l000")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = pickle.loads(li.fit(df, "text", "lang", F.xxhash64("doc_id")))
    assert network.languages == [f"l{i:03d}" for i in range(250)]


def test_long_texts_reach_the_learning_task_as_blocks(spark):
    df = spark.createDataFrame([(i, "ab " * 100_000, "a") for i in range(8)], "doc_id long, text string, lang string")
    rows = df.select("text", "lang", F.xxhash64("doc_id").alias("at"), F.lit(0).cast("long").alias("tie"))
    cut = rows.mapInPandas(li._cut_blocks, "lang string, at long, tie long, blocks array<binary>").collect()
    assert all(sum(map(len, r["blocks"])) <= li.SAMPLE_BLOCKS * li.STEPS for r in cut) and len(cut) == 8

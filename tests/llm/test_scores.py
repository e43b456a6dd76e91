import math
from collections import Counter

import numpy as np

from tests.llm.helpers import WORD, awkward, awkward_frame, fold, lower
from trailsift.llm import attention as att
from trailsift.llm import lm_score
from trailsift.llm.common import fold as fold_column
from trailsift.llm.queries import QUERIES, byte_bpe


def base_scores(rows):
    tokens = [(i, [*WORD.findall(lower(t)), "\0"]) for i, t, *_ in rows]
    counts = Counter(w for i, ws in tokens if i is not None and fold(i) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(
        math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)


def test_base_scores_against_plain_counts(spark, monkeypatch):
    from pyspark.sql import functions as F
    part = fold_column(F.col("doc_id"))
    rows = lm_score.score_documents(awkward_frame(spark), byte_bpe(), part == 1, part != 1).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                 for r in rows)
    assert got == base_scores(awkward())
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"]) == 1) for r in rows)


def test_windows_score_each_token_once():
    for n in (0, 1, att.FRESH - 1, att.FRESH, 3 * att.WINDOW + 5):
        tokens = np.arange(n)
        ids, real = att.text_windows(tokens, 999)
        first = att.WINDOW - att.FRESH
        scored = real[:, first + 1:] & real[:, first:-1]
        assert list(ids[:, first + 1:][scored]) == [*tokens, 999]


def test_probabilities_sum_to_one_and_look_back_only():
    rng = np.random.default_rng(0)
    model = att.Attention(rng.dirichlet(np.ones(12)), seed=4)
    components = model.components()
    ids, real = att.text_windows(rng.integers(0, 11, 40), 11)
    total = sum(model.probabilities(ids[:, :-1], real[:, :-1], np.full((len(ids), att.FRESH), k), components)
                for k in range(12))
    assert np.allclose(total, 1, atol=1e-5)
    changed = ids.copy()
    changed[:, -2:] = 0  # later inputs don't change earlier probabilities
    target = np.zeros((len(ids), att.FRESH), int)
    a = model.probabilities(ids[:, :-1], real[:, :-1], target, components)
    b = model.probabilities(changed[:, :-1], real[:, :-1], target, components)
    assert np.allclose(a[:, :-1], b[:, :-1], atol=1e-6)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    model = att.Attention(rng.dirichlet(np.ones(9)), seed=2)
    ids, real = att.text_windows(rng.integers(0, 8, 30), 8)
    components = model.components()
    grads, _, used = model._gradients(ids, real, components)
    first = att.WINDOW - att.FRESH
    scored = real[:, first + 1:] & real[:, first:-1]

    def loss():
        p = model.probabilities(ids[:, :-1], real[:, :-1], ids[:, first + 1:], components)
        return -np.log(p[scored].astype(float)).sum() / used

    for name, g in grads.items():
        p = getattr(model, name)
        for k in np.argsort(-np.abs(g.ravel()))[:3]:
            at = np.unravel_index(k, p.shape)
            before = p[at]
            p[at] = before + 2e-2
            up = loss()
            p[at] = before - 2e-2
            down = loss()
            p[at] = before
            assert abs((up - down) / 4e-2 - g[at]) < 1e-3 + 0.05 * abs(g[at]), name


def test_training_beats_the_unigram():
    rng = np.random.default_rng(3)
    line = np.tile([0, 1, 2, 3, 4], 400)
    line[rng.random(len(line)) < 0.05] = 5
    unigram = np.bincount(line, minlength=7) + 0.5
    model = att.Attention(unigram / unigram.sum())
    ids, real = att.text_windows(line, 6)
    first = att.WINDOW - att.FRESH
    scored = real[:, first + 1:] & real[:, first:-1]

    def mean():
        p = model.probabilities(ids[:, :-1], real[:, :-1], ids[:, first + 1:], model.components())
        return np.log(p[scored]).mean()

    before = mean()
    model.train(np.tile(ids, (30, 1)), np.tile(real, (30, 1)), passes=25)
    assert mean() > before + 0.8


def test_query_scores_whole_documents(spark, sf_small):
    rows = QUERIES["op9_attention_lm"](spark, sf_small).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in rows) == base_scores(docs)


def test_spans_hold_the_windows_of_a_text():
    for n in (0, 1, att.FRESH - 1, att.FRESH, 3 * att.WINDOW + 5, 500):
        tokens = np.arange(n) % 50
        ids, real = att.text_windows(tokens, 99)
        line = att.text_line(tokens, 99, 100)
        for size in (1, 3, 1000):
            spans = [att.line_span(line, a, min(a + size, len(ids))) for a in range(0, len(ids), size)]
            got = np.concatenate([att.span_windows(s) for s in spans])
            assert (got == np.where(real, ids, 100)).all()


def test_the_model_learns_from_every_training_window(spark, monkeypatch):
    """However large the corpus: here its counts say 200 million tokens."""
    monkeypatch.setattr(lm_score, "SPAN", 7)
    texts = [np.random.default_rng(i).integers(0, 40, 37 * i).astype("<u2") for i in range(12)]
    docs = spark.createDataFrame([(i, i != 3, bytearray(t.tobytes())) for i, t in enumerate(texts)],
                                 "id long, learn boolean, subs binary").repartition(3)
    rounds = []
    monkeypatch.setattr(lm_score, "_trained", lambda scorer, spans, *_: rounds.append(spans.collect()) or scorer)
    scorer = lm_score.fit(docs, np.full(40, 5_000_000), 12)
    first, every = rounds
    got = sorted(w.tobytes() for r in every for w in att.span_windows(np.frombuffer(r["span"], "<u2")))
    want = []
    for t in [*texts[:3], *texts[4:]]:
        ids, real = scorer.windows(t)
        want.extend(w.astype("<u2").tobytes() for w in np.where(real, ids, scorer.other + 2))
    assert got == sorted(want)
    assert len({r["shard"] for r in every}) > 10 and sorted(first) == sorted(r for r in every if r["shard"] == 0)


def test_row_keys_of_many_partitions(monkeypatch):
    """A row's key is its block and the place in it: positive and distinct whatever the number of partitions."""
    import pyarrow as pa
    from types import SimpleNamespace
    batch = pa.RecordBatch.from_pydict({"id": pa.array([5, 6], pa.int64()), "held_out": [False, True],
                                        "learn": [True, False], "text": ["a b", "c"]})
    keys = []
    for number in (0, 40_000, 70_000, 70_000 - 65_536, 2 ** 31 - 1):
        monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: number)))
        found = [r for part in lm_score._encoder(byte_bpe())(iter([batch, batch])) for r in part.to_pylist()]
        keys += [(r["block"], r["row"]) for r in found if r["row"] is not None]
    assert len(keys) == len(set(keys)) == 20 and all(block >= 0 and row >= 0 for block, row in keys)


def test_shards_do_not_follow_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SPAN", 7)
    texts = [np.random.default_rng(i).integers(0, 40, 90 * i).astype("<u2") for i in range(9)]
    docs = spark.createDataFrame([(None if i == 4 else i, bytearray(t.tobytes())) for i, t in enumerate(texts)],
                                 "id long, subs binary")
    import pickle
    deal = lm_score._dealer(pickle.dumps(lm_score.Scorer(np.full(40, 9), 9)), 5)
    dealt = [sorted((r["shard"], bytes(r["span"])) for r in part.mapInArrow(deal, "shard int, span binary").collect())
             for part in (docs.coalesce(1), docs.repartition(7))]
    assert dealt[0] == dealt[1] and len({s for s, _ in dealt[0]}) == 5


def _every_row_adam(model, windows, rate, floor, seed=5):
    """One pass of ``train`` in plain steps that move all rows of all tables."""
    names = ("query", "key", "value", "direct", "distance")
    moments = {n: (np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))) for n in names}
    order = np.random.default_rng(seed).permutation(len(windows))
    steps = -(-len(windows) // att.BATCH)
    for step in range(1, steps + 1):
        ids = windows[order[(step - 1) * att.BATCH:step * att.BATCH]]
        grads, _, _ = model._gradients(ids, np.ones(ids.shape, bool), model.components())
        first = att.WINDOW - att.FRESH
        gate = np.stack([model.probabilities(ids[:, :-1], np.ones((len(ids), att.WINDOW), bool), ids[:, first + 1:],
                                             np.tile(np.eye(att.COMPONENTS, dtype="f4")[k], (len(model.unigram), 1)))
                         for k in range(att.COMPONENTS)], axis=2)
        joint = gate * model.components()[ids[:, first + 1:]]
        joint /= joint.sum(axis=2, keepdims=True)
        speed = max(0.02, 1 / (step + 2) ** 0.6)
        model.counts *= 1 - speed
        np.add.at(model.counts, ids[:, first + 1:], speed / (len(ids) * att.FRESH) * joint)
        lr = floor + (rate - floor) * (1 - step / steps)
        for n in names:
            m, v = moments[n]
            m += 0.1 * (grads[n] - m)
            v += 0.02 * (grads[n] ** 2 - v)
            setattr(model, n, (getattr(model, n) - lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.98 ** step)) + 1e-8)).astype("f4"))
    return model


def test_steps_on_a_batch_s_own_rows_do_what_steps_on_all_rows_do(monkeypatch):
    """Rows come back after gaps; rates hardly change, so making up for the gaps is nearly exact."""
    monkeypatch.setattr(att, "BATCH", 8)
    rng = np.random.default_rng(2)
    windows = np.minimum(rng.zipf(1.4, (200, att.WINDOW + 1)), 60)
    unigram = np.bincount(windows.ravel(), minlength=62) + 0.5
    unigram = unigram / unigram.sum()
    plain = _every_row_adam(att.Attention(unigram), windows, 0.003, 0.0029)
    start = att.Attention(unigram)
    model = att.Attention(unigram).train(windows, np.ones(windows.shape, bool), 1, 0.003, 0.0029)
    for name in ("query", "key", "value", "direct"):
        moved = getattr(plain, name) - getattr(start, name)
        apart = getattr(model, name) - getattr(plain, name)
        assert np.sqrt((apart ** 2).mean()) < 0.1 * np.sqrt((moved ** 2).mean()), name
    assert np.allclose(model.components(), plain.components(), rtol=0.02, atol=1e-5)
    assert np.allclose(model.distance, plain.distance, atol=2e-3)


def test_the_last_windows_of_a_shard_are_learned_from_too():
    """Each window has a token of its own; none of their rows stays as it was, also beyond the last full batch."""
    n = att.BATCH + 50
    windows = np.tile(np.arange(n)[:, None], (1, att.WINDOW + 1))
    unigram = np.full(n + 1, 1 / (n + 1))
    before = att.Attention(unigram).direct
    after = att.Attention(unigram).train(windows, np.ones(windows.shape, bool)).direct
    assert (before[:n] != after[:n]).any(axis=1).all()


def test_a_step_costs_its_own_tokens_rows():
    """A hundred times the vocabulary, the same windows."""
    from time import process_time
    windows = np.random.default_rng(0).integers(0, 500, (2400, att.WINDOW + 1))
    took = []
    for size in (1_000, 100_000):
        model = att.Attention(np.full(size, 1 / size))
        best = []
        for _ in range(2):
            start = process_time()
            model.train(windows, np.ones(windows.shape, bool), passes=4)
            best.append(process_time() - start)
        took.append(min(best))
    assert took[1] < 5 * took[0]


def test_runs_of_windows_are_the_windows():
    """Spans end to end in runs: every window's targets once, with the same probabilities."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 30, n) for n in (0, 1, att.FRESH - 1, att.FRESH, 3 * att.WINDOW + 5, 700)]
    model = att.Attention(rng.dirichlet(np.ones(31)), seed=1)
    components, first = model.components(), att.WINDOW - att.FRESH
    want = []
    for text in texts:
        ids, real = att.text_windows(text, 30)
        p = model.probabilities(ids[:, :-1], real[:, :-1], ids[:, first + 1:], components)
        want.append(p[real[:, first + 1:] & real[:, first:-1]])
    for size in (1, 3, 1000):
        spans = [att.line_span(att.text_line(t, 30, 99), a, min(a + size, att.window_count(len(t))))
                 for t in texts for a in range(0, att.window_count(len(t)), size)]
        runs, real, scored, starts = att.span_runs(spans, 99)
        p = model.run_probabilities(runs, real, model.table(), components)
        assert np.allclose(p[scored], np.concatenate(want), atol=1e-6)
        assert len(starts) == len(spans) and scored.sum() == sum(len(t) + 1 for t in texts)

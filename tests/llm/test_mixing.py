import random

import numpy as np
import pytest

from trailsift.llm import mixing


def reshare(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    total, capped = sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped) if c)
        free = sum(w for w, c in zip(weights, capped) if not c)
        goal = [most * s if c else w * rest / free if free else 0 for s, w, c in zip(sizes, weights, capped)]
        over = [g > most * s + 1e-9 and not c for g, s, c in zip(goal, sizes, capped)]
        if not any(over):
            return goal
        capped = [c or o for c, o in zip(capped, over)]


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    rows, sizes = [], {}
    for k in range(rng.randint(1, 7)):
        for _ in range(rng.randint(1, 30 ** rng.randint(0, 2))):
            n = rng.randint(0, 40)
            rows.append((len(rows), "w " * n, f"s{k}" if k else None))
            sizes[rows[-1][2]] = sizes.get(rows[-1][2], 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, reshare([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    taken = {}
    for r in got:
        m, s = r["mix"], r["source"]
        assert m["source_size"] == sizes[s] and m["target"] == pytest.approx(want[s])
        assert sum(m["taken"]) <= 3 * m["size"] and all(0 <= t <= m["size"] for t in m["taken"])
        taken[s] = taken.get(s, 0) + sum(m["taken"])
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)


def test_due_time_inverts_the_integral(spark):
    schedule = ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0))
    shares = [i / 40 for i in range(41)]
    df = spark.createDataFrame([(s,) for s in shares], "share double")
    times = [r[0] for r in df.select(mixing.due_time(df["share"], schedule)).collect()]
    x = np.linspace(0, 1, 200001)
    w = np.interp(x, [0, 0.6, 1], [0.5, 1, 2])
    done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(x))])
    assert np.allclose(np.interp(times, x, done / done[-1]), shares, atol=1e-6)


def test_occurrences_stand_in_order_and_reruns_agree(spark):
    rows = [(i, "word " * (i % 17), f"s{i % 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = [(r["doc_id"], r["mix_pass"], r["mix_taken"], r["mix_time"]) for r in mixing.mix(df.repartition(5)).collect()]
    again = [(r["doc_id"], r["mix_pass"], r["mix_taken"], r["mix_time"]) for r in mixing.mix(df.repartition(2)).collect()]
    assert first == again and [r[3] for r in first] == sorted(r[3] for r in first)
    assert all(0 <= r[3] <= 1 for r in first)


def test_query_runs_the_schedules(spark, sf_small, monkeypatch):
    """op3's rows come from the mix: in the order of first occurrence, which the schedules decide."""
    from trailsift.llm.queries import QUERIES

    def order():
        return [(r["doc_id"], r["taken"]) for r in QUERIES["op3_curriculum_mix"](spark, sf_small).collect()]

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    first, taken = {}, {}
    for r in mixing.mix(docs).collect():
        first.setdefault(r["doc_id"], len(first))
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["mix_taken"]
    got = order()
    assert [i for i, t in got if t] == sorted(first, key=first.get)
    assert dict(got) == {**dict.fromkeys((r["doc_id"] for r in docs.collect()), 0), **taken}
    late = (((0.0, 0.01), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 0.01)))
    monkeypatch.setattr(mixing.mixed_documents, "__defaults__", (*mixing.mixed_documents.__defaults__[:-1], late))
    assert order() != got and sorted(order()) == sorted(got)


def test_positions_and_times_follow_the_schedules(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    first = {}
    for r in mixing.mix(docs).collect():
        first.setdefault(r["doc_id"], r["mix_time"])
    late = (((0.0, 0.01), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 0.01)))
    found = [mixing.mixed_documents(docs, schedules=s).collect() for s in (mixing.SCHEDULES, late)]
    for rows in found:
        met = [r for r in rows if r["taken"]]
        assert [r["position"] for r in met] == list(range(len(met))) and rows[:len(met)] == met
        times = [r["due_time"] for r in met]
        assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
        assert all(r["position"] is None and r["due_time"] is None for r in rows[len(met):])
    assert {r["doc_id"]: r["due_time"] for r in found[0] if r["taken"]} == first
    other = {r["doc_id"]: r["due_time"] for r in found[1]}
    assert sum(other[i] != t for i, t in first.items()) > len(first) / 2


def test_mixed_documents_keep_awkward_rows(spark):
    from tests.llm.helpers import awkward, awkward_frame
    got = mixing.mixed_documents(awkward_frame(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in awkward())
    plan = mixing.plan_mix(awkward_frame(spark)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted(
        (str(r["doc_id"]), r["mix"]["size"], sum(r["mix"]["taken"])) for r in plan)


def test_the_pipeline_writes_whole_texts(spark):
    import corpus_pipeline
    rows = [(i, f"line {i}\n" + "word  " * (40 + 13 * i) + "end", "en", f"s{i % 3}", 7) for i in range(40)]
    got = corpus_pipeline.mixed(spark, spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert got and {tuple(r) for r in got} <= set(rows)

import random

import numpy as np

from tests.llm.helpers import WORD, lower
from trailsift.llm import minhash


def shingles(text, size):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size=4, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, n, edits, vocabulary=300, length=60):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"v{rng.randrange(vocabulary)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = [t for _ in range(8) for t in near_copies(rng, 15, 5)]
    texts += near_copies(rng, 25, 12, length=400)
    texts += ["", " ", "one", "ONE", "a b c", "A b  c", "x y z w", None, texts[3], texts[3].upper()]
    rows = list(enumerate(texts))
    want = components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_an_open_bucket_compares_every_pair():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    sets = [np.unique(rng.choice(pool[:size], size - size // 8, replace=False)) for size in (40, 40, 200, 200, 2000, 2000)]
    low = [(s[:minhash.LOW] >> np.uint64(32)).astype("<u4").tobytes() for s in sets]
    n = np.array([len(s) for s in sets])
    ids = np.arange(len(sets))
    found = set(minhash._Bucket(ids * 0, ids, n, ids, low).pairs(60))
    for a in ids:
        for b in ids[a + 1:]:
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 60 * (n[a] + n[b] - both):
                assert (a, b) in found


def test_dense_sketches_agree_on_equal_sets_and_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 100, 5000):
        s = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        assert (minhash.sketch(s) == minhash.sketch(s.copy())).all()
        assert np.isin(minhash.sketch(s), s).all()
    a = np.unique(rng.integers(0, 1 << 64, 20000, dtype=np.uint64))
    share = (minhash.sketch(a[:16000]) == minhash.sketch(a[4000:])).mean()  # not sorted by value alike: J = 0.6
    mixed = rng.permutation(a)
    x, y = np.sort(mixed[:16000]), np.sort(mixed[4000:])
    assert abs((minhash.sketch(x) == minhash.sketch(y)).mean() - 0.6) < 0.12 and share >= 0


def test_word_fingerprints_ignore_where_a_text_is_cut(monkeypatch):
    text = ("Alpha beta\tgamma " * 50 + "x" * 5000 + " end").encode()
    data, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    whole, counts = minhash.hash_words(data, offsets)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    pieces, _ = minhash.hash_words(data, offsets)
    assert (whole == pieces).all() and counts[0] == counts[1] == 152
    assert (whole[:152] == whole[152:]).all() and len(np.unique(whole)) == 5

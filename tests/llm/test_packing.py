import itertools
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, awkward_frame
from trailsift.llm import packing
from trailsift.llm.queries import byte_bpe


def test_encoder_equals_the_tokenizer(monkeypatch):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x200)] + list("日本ελ\u2028\u00a0 \n\t'") + [" the", "'s", "<|endoftext|>", "²"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab c'st1 \n.é") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(byte_bpe())
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    encode = packing.Encoder(byte_bpe())
    assert [x for a in range(0, len(texts), 70) for x in encode(texts[a:a + 70])] == want


def test_a_releasing_job_remembers_fewer_pieces():
    import pyarrow as pa
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)) for _ in range(60)]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 5)), "text": texts[a:a + 5]}) for a in range(0, 60, 5)]

    def cut(remembered):
        packing._encoders.clear()
        rows = [r for out in packing._cutter(byte_bpe(), 2048, remembered)(iter(batches)) for r in out.to_pylist()]
        found = packing.encoder(byte_bpe())
        packing._encoders.clear()
        return rows, len(found.known), len(found.older)
    rows, known, older = cut(None)
    few, known_few, older_few = cut(500)
    assert few == rows and known + older > 2000 and max(known_few, older_few) <= 500


def test_the_pipeline_bounds_its_batches(spark):
    import corpus_pipeline
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        corpus_pipeline.prepare(spark)
        assert 0 < int(spark.conf.get(key).rstrip("b")) <= 4 << 20
    finally:
        spark.conf.set(key, before)


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), rng.randint(1, 6)), reverse=True)
        counts = [rng.randint(1, 4) for _ in lengths]
        capacity = rng.randint(lengths[0], 60)
        take = packing.fullest(lengths, counts, capacity, 0)
        assert take[0] >= 1 and all(t <= n for t, n in zip(take, counts))
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts))
                   if c[0] and (s := sum(x * y for x, y in zip(c, lengths))) <= capacity)
        assert sum(t * x for t, x in zip(take, lengths)) == best


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    histogram = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(300)}
    plan = packing.plan_bins(dict(histogram), 2048)
    used = {}
    for times, combination in plan:
        assert sum(x * n for x, n in combination) <= 2048
        for x, n in combination:
            used[x] = used.get(x, 0) + n * times
    assert used == histogram
    total = sum(x * n for x, n in histogram.items())
    assert sum(t for t, _ in plan) <= 1.03 * total / 2048 and len(plan) <= 2 * len(histogram)


def test_round_trip(spark):
    rows = packing.pack(awkward_frame(spark), byte_bpe(), 512).collect()
    tokenizer = Tokenizer.from_file(byte_bpe())
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert 1 <= r["length"] <= 512
    for places in bins.values():  # gapless from 0, nothing beyond the capacity
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 512) + 1
    texts = {i: t for i, t, *_ in awkward() if i is not None}
    for doc_id in set(texts) - {0}:  # 0 is repeated
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id)
        at = 0
        for k, (piece, start, length, crc) in enumerate(mine):
            assert (piece, start) == (k, at) and crc == zlib.crc32(ids[at:at + length].tobytes())
            assert k == 0 or length == 512
            at += length
        assert at == len(ids)
    assert sum(r["doc_id"] == 0 for r in rows) % 3 == 0

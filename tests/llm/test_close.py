"""The comparison of wide fingerprints against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfwork.llm import neardup


def _apart(prints):
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    return (bits[:, None] != bits[None]).sum(2)


@pytest.mark.parametrize("radius", [0, 3, 80, 110, 255, 256])
def test_components_of_near_fingerprints(radius):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 64, (150, neardup.BITS // 64), np.uint64)
    prints[100:] = prints[:50]
    prints[100:, 1] ^= (np.uint64(1) << rng.integers(1, 60, 50).astype(np.uint64)) - np.uint64(1)
    prints[130:, 2] = ~prints[130:, 2]
    near, want = _apart(prints) <= radius, np.arange(150)
    for _ in range(150):
        want = np.array([want[row].min() for row in near])
    assert neardup.close(prints, radius).tolist() == want.tolist()


def test_sets_of_similarity_0_8_are_within_the_radius():
    rng = np.random.default_rng(5)
    for size, shared in ((9, 8), (45, 40), (900, 800)):
        for _ in range(200):
            x = rng.integers(0, 1 << 64, 2 * size - shared, np.uint64)
            assert _apart(np.stack([neardup.fingerprint(x[:size]), neardup.fingerprint(x[-size:])]))[0, 1] <= neardup.RADIUS


def test_only_near_fingerprints_reach_the_exact_check(spark, monkeypatch):
    """All sets share a bucket here, so the fingerprints alone tell them apart."""
    words = lambda seed: [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, 60)]
    rows = [(i, " ".join(words(i // 2) + ["more"] * (i % 2))) for i in range(6)]
    docs = spark.createDataFrame([*rows, (6, " ".join(words(99)))], "doc_id long, text string")
    seen, one = [], neardup.verified

    def watched(members):
        seen.extend(members.select("root", "sig").collect())
        return one(members)

    monkeypatch.setattr(neardup, "verified", watched)
    monkeypatch.setattr(neardup, "candidates", lambda reps: reps.select(reps["sig"].alias("b")).crossJoin(F.broadcast(reps.groupBy().agg(F.min("sig").alias("a")))).where("a <> b"))
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [0, 2, 4, 6]
    assert len(seen) == 6 and len({r.root for r in seen}) == 3

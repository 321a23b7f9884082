"""Distances of many pairs at once, against brute force."""

import itertools
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from murmuration.functions import distances
from murmuration.operators import pairs


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_many_distances_at_once():
    rng = random.Random(11)
    left = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(70)]
    right = ["".join(rng.choice("abcdeé中😀") for _ in range(rng.randint(1, 70))) for _ in range(66)] + left[:4] + ["ab" * 300]
    got = np.concatenate([d for _, d in distances.edit_distances(left, right)])
    assert got.tolist() == [[lev(a, b) for b in right] for a in left]


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_many_sequences_are_measured_at_once(spark, monkeypatch, threshold):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    # Rare lengths, an empty and a missing sequence, copies, one sequence in several rows, and a key that is there twice.
    rows = [(k, rng.choice(texts)) for k in range(120)] + [(k, "abc" * k) for k in (200, 201)] + [(300, ""), (301, None), (302, "a"), (5, texts[0])]

    for name, x in (("MANY", 20), ("CROWD", 5), ("KEYS", 3), ("SENT", 7)):
        monkeypatch.setattr(pairs, name, x, raising=False)
    df = spark.createDataFrame(rows, "id long, seq string")
    want = sorted((min(a, b), max(a, b), d) for (a, x), (b, y) in itertools.combinations(rows, 2) if a != b for d in [np.float32(lev(x or "", y or "") / max(len(x or ""), len(y or "")) if x or y else 1.0)] if threshold is None or d < np.float32(threshold))
    got = pairs.all_pairs_ned(df, "id", "seq", threshold)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == want
    six = pairs.all_pairs_ned(df, "id", "seq", threshold, digits=6).collect()
    assert sorted(map(tuple, six)) == sorted((a, b, float(Decimal(repr(float(d))).quantize(Decimal("0.000001"), ROUND_HALF_UP))) for a, b, d in want)

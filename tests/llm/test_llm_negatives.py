"""Hard negatives against a brute-force version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, _vector string, length string"


def exact(vector):
    return [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in vector]


def brute(rows, every, k=5):
    """Rows as they take part: (id, vector, label), ids unique."""
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    found = []
    values = {i: (exact(v), label) for i, v, label in rows}
    for anchor, (own, label) in values.items():
        if anchor % every:
            continue
        scores = [
            (-clamp(sum(x * y for x, y in zip(own, v))), i, other)
            for i, (v, other) in values.items() if i != anchor and len(v) == len(own)
        ]
        scores.sort()
        for high, positive, _ in [s for s in scores if s[2] == label][:k]:
            inside = [s for s in scores if s[2] != label and 80 * -high <= 100 * -s[0] <= 100 * -high][:k]
            found += [(anchor, positive, r, i, -high, -s) for r, (s, i, _) in enumerate(inside, 1)]
    return sorted(found)


def mined(spark, rows, path, every):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    out = negatives.mine(spark, df, str(path), F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_clusters_ties_and_several_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(400):
        near = rng.choice(centres)
        spread = rng.choice([0, 0.02, 0.3])
        rows.append((i - 50, [round(x + rng.gauss(0, spread), 3) for x in near], rng.randrange(3)))
    rows[10] = (rows[10][0], [0.0] * 6, 1)
    monkeypatch.setattr(negatives, "BLOCK", 64)
    found = mined(spark, rows, tmp_path / "a", 7)
    assert found == brute(rows, 7) and len(found) > 500


def test_odd_rows(spark, tmp_path):
    good = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.95, 0.4], 2), (3, [0.9, 0.41], 2), (10, [1e300, -1e300], 1), (11, [9e299, -1e300], 1),
            (12, [9e299, -9e299], 2), (20, [3e7, 1.0, 1.0], 1), (21, [3e7, 0.0, 1.0], 1), (22, [2.9e7, 0.0, 1.0], 3), (30, [], 1), (31, [], 1), (32, [], 2)]
    bad = [(40, None, 1), (50, [1.0, None], 1), (60, [float("nan"), 1.0], 1), (70, [float("inf"), 1.0], 2), (80, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    repeats = [good[0], (2, [0.95, 0.4], 3), (3, [7.0, 7.0], 1)]
    assert mined(spark, good + bad + repeats, tmp_path / "a", 10) == brute(good, 10)
    assert mined(spark, [], tmp_path / "b", 10) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], tmp_path / "c", 10) == []


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_bounds_hold_and_sift(scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    vectors = np.floor(256 * scale * (centres[rng.integers(0, 5, 300)] + rng.normal(0, 0.05, (300, 16))))
    vectors[:5] = vectors[5]
    norms, units = negatives.directions(vectors)
    _, references = negatives.directions(centres)
    angles = np.arccos(np.clip(units @ references.T, -1, 1)).astype("<f4")
    inside = 0
    for at in range(0, 300, 7):
        low, high = negatives.score_bounds(angles, norms, angles[at], norms[at])
        scores = vectors @ vectors[at]
        assert (low <= scores).all() and (scores <= high).all()
        inside += (high >= 0.8 * scores.max()).mean() / 43
    assert scale < 1 or inside < 0.5

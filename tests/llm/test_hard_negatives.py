"""Hard-negative mining against brute force over Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import hard_negatives as H


def brute(rows, anchor, low=50, high=95):
    kept = {}
    for i, label, q in rows:
        if i is not None and label is not None and q is not None and (i not in kept or (label, q) < kept[i]):
            kept[i] = (label, q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a in filter(anchor, kept):
        ranked = sorted((-dot(kept[a][1], q), i, label == kept[a][0]) for i, (label, q) in kept.items() if i != a)
        for ps, p, _ in [x for x in ranked if x[2]][:5]:
            fits = [x for x in ranked if not x[2] and low * -ps <= 100 * -x[0] <= high * -ps][:3]
            out |= {(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fits)}
    return out


@pytest.mark.parametrize("settings", [{}, {"LIST_ROWS": 12, "PART": 5, "PORTION": 4, "FIRST": 1, "GROW": 2}, {"LIST_ROWS": 20, "MOST_RADII": 0}])
def test_same_as_brute_force(spark, monkeypatch, settings):
    """Clustered vectors, many copies, repeated and contradicting ids, ties, several lists, parts, portions and rounds."""
    for k, v in settings.items():
        monkeypatch.setattr(H, k, v)
    rng = random.Random(5)
    rows = []
    for i in range(240):
        centre = i % 6
        q = [3, 1, 2] if i % 3 == 0 else [(40 if j == centre else 0) + rng.randint(-6, 6) for j in range(6)]
        rows.append((i, rng.randint(0, 3), q))
    rows += [rows[7], (8, 9, [1, 2]), (None, 1, [1]), (900, None, [1]), (901, 1, None), (902, 77, [1, 1]), (910, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<long>")
    got = {tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()}
    assert got == brute(rows, lambda i: i % 5 == 0)


def test_large_scores_and_empty(spark):
    big = 2**40
    rows = [(0, 0, [big, 1]), (1, 0, [big, 0]), (2, 1, [big // 100 * 70, 0]), (3, 1, [2**30, 5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<long>")
    got = H.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert all(r.positive_score == 2**63 - 1 for r in got)  # held at the end of long
    assert H.products(np.array([[big, 3]]), np.array([[2**20, 5]]))[0, 0] == big * 2**20 + 15
    assert H.hard_negatives(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_odd_rows(spark):
    rows = [(1, [0.5, None], 1), (2, [math.nan], 1), (3, [math.inf], 1), (4, None, 1), (5, [-0.001, 0.999], 1), (6, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kept = df.where(H.usable(F.col("embedding"))).select("vec_id", H.whole_components(F.col("embedding")).alias("q")).collect()
    assert [(r.vec_id, r.q) for r in kept] == [(5, [-1, 255]), (6, [])]

"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import hard_negatives


def slow(rows, positives=5, negatives=10):
    fit = [(i, n, [math.floor(256 * x) for x in v]) for i, n, v in rows
           if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, n, v in fit:
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in fit if i != a)
        for p, pid in [(-s, i) for s, i, m in scored if m == n][:positives]:
            hard = [(-s, i) for s, i, m in scored if m != n and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(a, pid, rank, i, p, s) for rank, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def vectors(dims, n=400):
    rnd = np.random.default_rng(dims)
    rows = []
    for i in range(n):
        v = rnd.normal(i % 3 / 4, 0.3, dims)
        rows.append((i, int(rnd.integers(0, 4)), [float(np.float32(x)) for x in (v if i % 5 else np.full(dims, 0.25))]))  # a fifth is one vector
    return rows


ODD = [(None, 1, [1.0]), (1000, None, [1.0]), (1010, 1, None), (1020, 1, [1.0, None]), (1030, 1, [float("nan")]), (1040, 1, [float("inf")]),
       (1050, 1, []), (1060, 2, [0.5]), (20, 1, [0.1] * 40), (20, 1, [0.1] * 40), (1070, 3, [-2.0] * 3), (-10, 0, [1.0] * 12)]


@pytest.mark.parametrize("dims, odd, chunk", [(1, False, 1 << 18), (7, True, 64), (40, True, 1 << 18), (64, False, 128)])
def test_against_all_pairs(spark, monkeypatch, dims, odd, chunk):
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rows = vectors(dims) + (ODD if odd else [])
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, row string, chunk int")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    expected = slow([(i, n, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, n, v in rows])
    assert sorted(map(tuple, got.collect())) == expected and expected


def test_bounds_hold_and_refine():
    rnd = np.random.default_rng(0)
    vectors = rnd.integers(-300, 300, (200, 60)) + rnd.integers(-200, 200, (200, 1))
    count, length = hard_negatives.segments(60)
    padded = np.zeros((200, count * length), "<i4")
    padded[:, :60] = vectors
    means, deviations = hard_negatives.summary(padded, count)
    table = pa.table({"id": range(200), "label": [0] * 200, **{k: [r.tobytes() for r in m] for k, m in (
        ("vector", padded), ("means", means), ("deviations", deviations))}})
    block, rows, before = hard_negatives.Block(table, length), np.arange(200), np.inf
    assert len(block.levels) == count.bit_length()
    for level in range(len(block.levels)):
        widths = []
        for a in range(50):
            low, high = block.bounds(level, rows, block, a)
            exact = vectors @ vectors[a]
            assert (low <= exact).all() and (exact <= high).all() and (block.scores(rows, block, a) == exact).all()
            widths.append((high - low).mean())
        assert np.mean(widths) < before
        before = np.mean(widths)


def test_scores_beyond_doubles_stay_exact():
    count, length = hard_negatives.segments(1024)
    vectors = np.full((3, 1024), hard_negatives.LARGEST, "<i4")
    vectors[1, ::2], vectors[2, 0] = -hard_negatives.LARGEST, 1
    means, deviations = hard_negatives.summary(vectors, count)
    table = pa.table({"id": range(3), "label": [0] * 3, **{k: [r.tobytes() for r in m] for k, m in (
        ("vector", vectors), ("means", means), ("deviations", deviations))}})
    block = hard_negatives.Block(table, length)
    assert block.scores(np.arange(3), block, 0).tolist() == [1 << 56, 0, (1 << 56) - (1 << 46) + (1 << 23)]


def test_ties_go_to_smaller_ids():
    assert hard_negatives.first(np.array([5, 3, 4]), np.array([7, 7, 9]), 2).tolist() == [2, 1]


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0

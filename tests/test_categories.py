"""Category trees against a plain walk over the graph."""

import random

import pytest

from helpers import month
from seriesforge.operators import categories


def slow_closure(edges):
    nodes = {n for n, _ in edges if n is not None}
    up = {n: {p for m, p in edges if m == n and p in nodes} for n in nodes}
    out = {}
    for node in nodes:
        level, distance, seen = up[node], 1, set()
        while level - seen:
            for a in level - seen:
                out[node, a] = distance
            seen |= level
            level, distance = {b for a in level for b in up[a]}, distance + 1
    return out


def graph(seed):
    rnd = random.Random(seed)
    edges = [(f"n{i}", f"n{i // rnd.choice([2, 3])}" if i else None) for i in range(60)]
    edges += [(f"chain{i}", f"chain{i + 1}") for i in range(37)] + [("chain37", "n5"), ("lost", "no record"), (None, "n1"), ("n7", "n3"), ("n7", "n3")]
    edges += [(f"loop{i}", f"loop{(i + 1) % 5}") for i in range(5)] + [("below", "loop2"), ("self", "self"), ("loop3", "n2")]
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_closure(spark, seed):
    edges = graph(seed)
    got = categories.ancestors(spark.createDataFrame(edges, "node string, parent string"))
    assert {(r.node, r.ancestor): r.distance for r in got.collect()} == slow_closure(edges) and got.count() == len(slow_closure(edges))
    assert {(r.node, r.length) for r in categories.cycles(got).collect()} == {(f"loop{i}", 5) for i in range(5)} | {("self", 1)} | ({("n0", 1)} if ("n0", "n0") in slow_closure(edges) else set())


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_roll_up(spark, hot_rows):
    edges, rnd = graph(3), random.Random(4)
    listed = [(f"s{i}", f"n{rnd.choice([59, 59, 59, i % 60])}") for i in range(80)] + [("s1", "n1"), ("s1", "chain0"), ("s2", "loop1"), ("s3", "unknown")]
    facts = [(f"s{i}", month(m), float(i + m)) for i in range(80) for m in range(3) if (i + m) % 7]
    closure = categories.ancestors(spark.createDataFrame(edges, "node string, parent string"))
    out = categories.roll_up(spark.createDataFrame(facts, "series_id string, date date, value double"),
                             spark.createDataFrame(listed, "series_id string, category string").distinct(), closure, hot_rows)
    above = slow_closure(edges)
    expected = {}
    for s, d, v in facts:
        for c in {a for t, c in listed if t == s for a in [c, *[a for n, a in above if n == c]]}:
            total, n = expected.get((c, d), (0.0, 0))
            expected[c, d] = (total + v, n + 1)
    assert {(r.category, r.date): (r.total, r.n_series) for r in out.collect()} == expected


def test_records_of_a_bulk_file(spark):
    raw = spark.createDataFrame([("1", None, ["a", "b", None]), ("2", "1", []), ("2", "1", None), (None, "1", ["c"]), ("3", "2", ["a"])],
                                "category_id string, parent_category_id string, childseries array<string>")
    assert {tuple(r) for r in categories.parents(raw).collect()} == {("1", None), ("2", "1"), ("3", "2")}
    assert sorted(tuple(r) for r in categories.members(raw).collect()) == [("a", "1"), ("a", "3"), ("b", "1")]


def test_nothing(spark):
    none = categories.ancestors(spark.createDataFrame([], "node string, parent string"))
    assert none.count() == 0 and categories.cycles(none).count() == 0

"""k-means and exchange networks against plain Python."""

import datetime
import random

import pytest

from seriesforge.operators import cluster, network
from workload import catalogs, networks


def slow_lloyd(rows, centres, rounds):
    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for x in rows.values():
            own.setdefault(near(x)[1], []).append(x)
        centres = [[sum(v) / len(v) for v in zip(*own[i])] if i in own else c for i, c in enumerate(centres)]
    return {k: near(x)[::-1] for k, x in rows.items()}, centres


def points(spread):
    rnd = random.Random(2)
    middles = [(0, 0), (20, 0), (0, 20), (20, 20), (50, 50)]
    return {i: [rnd.gauss(m, spread) for m in middles[i % 5]] for i in range(300)}


def test_rounds(spark):
    rows = points(6)
    df = cluster.usable(spark.createDataFrame([*rows.items(), (None, [1.0, 1.0]), (900, None), (901, [1.0, None]), (902, [float("nan"), 1.0])], "id int, features array<double>"))
    start = [[0.0, 0.0], [1.0, 1.0], [1000.0, 1000.0]]
    centres = cluster.lloyd(df, start, 4)
    expected, middles = slow_lloyd(rows, start, 4)
    assert all(c == pytest.approx(m) for c, m in zip(centres, middles)) and centres[2] == [1000.0, 1000.0]
    got = {r.id: (r.cluster, r.distance) for r in cluster.assigned(df, centres).collect()}
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in expected.items()}
    assert all(got[k][1] == pytest.approx(expected[k][1]) for k in got)


def test_seeds_find_the_groups(spark):
    rows = points(1)
    df = spark.createDataFrame(list(rows.items()), "id int, features array<double>").repartition(5)
    found, centres = cluster.kmeans(df, 5)
    assert len(centres) == 5
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster, set()).add(r.id % 5)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2], [3], [4]]
    assert cluster.seeds(cluster.usable(df), 5) == cluster.seeds(cluster.usable(df.repartition(2)), 5)


def test_scaled_and_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 7.0]), (2, [3.0, 7.0]), (3, None)], "id int, features array<double>")
    assert {r.id: r.features for r in cluster.scaled(df).collect()} == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    same = spark.createDataFrame([(i, [1.0]) for i in range(9)], "id int, features array<double>")
    found, centres = cluster.kmeans(same, 3)
    assert centres == [[1.0]] and {r.cluster for r in found.collect()} == {0}
    found, centres = cluster.kmeans(same.limit(0), 3)
    assert found.count() == 0 and centres == [] and cluster.scaled(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cluster.nearest([[0.0] * 1000] * 101)


def test_shares(spark):
    rnd = random.Random(5)
    rows = [(f"n{rnd.randrange(20)}", f"n{rnd.randrange(30)}", rnd.randint(-1, 9)) for _ in range(150)] + [(None, "n1", 3), ("n1", None, 3), ("n2", "n3", None)]
    net = network.flows(spark.createDataFrame(rows, "source string, target string, amount long"))
    edges = {}
    for s, t, a in rows:
        if s and t and a and a > 0:
            edges[s, t] = edges.get((s, t), 0) + a
    assert {(r.source, r.target): r.amount for r in net.collect()} == edges
    nodes = sorted({n for e in edges for n in e})
    sent = {n: sum(a for (s, _), a in edges.items() if s == n) for n in nodes}
    share = {n: 1 / len(nodes) for n in nodes}
    for _ in range(9):
        idle = sum(share[n] for n in nodes if not sent[n])
        share = {n: 0.15 / len(nodes) + 0.85 * (idle / len(nodes) + sum(share[s] * a / sent[s] for (s, t), a in edges.items() if t == n)) for n in nodes}
    got = {r.node: r.share for r in network.shares(net, 9).collect()}
    assert got == pytest.approx(share) and sum(got.values()) == pytest.approx(1)
    assert {r.node: (r.sent, r.received, r.balance) for r in network.balances(net).collect()} == {
        n: (sent[n], b := sum(a for (_, t), a in edges.items() if t == n), b - sent[n]) for n in nodes}


def test_no_flows(spark):
    net = network.flows(spark.createDataFrame([], "source string, target string, amount long"))
    assert network.shares(net).count() == 0 == network.balances(net).count()


def test_a_round_moves_no_flows(spark, monkeypatch):
    """Flows stay in their blocks: the join of a round shuffles the nodes that send, not the flows; hot targets are dealt over blocks."""
    monkeypatch.setattr(network, "BLOCK_FLOWS", 100)
    monkeypatch.setattr(network, "HOT_FLOWS", 20)
    rows = [(f"a{i}", f"b{i * j % 7}" if j % 3 else "hub", 1 + (i + j) % 5) for i in range(60) for j in range(12)] + [("hub", "a1", 3)]
    net = network.flows(spark.createDataFrame(rows, "source string, target string, amount long"))
    plans, join = [], type(net).join

    def joined(self, other, on, *how):
        out = join(self, other, on, *how)
        if on == ["block", "source"]:
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(net), "join", joined)
    got = {r.node: r.share for r in network.shares(net, 3).collect()}
    monkeypatch.undo()
    assert len(plans) == 3 and all(plan.count("Exchange hashpartitioning(block") <= 1 for plan in plans)
    assert got == pytest.approx({r.node: r.share for r in network.shares(net, 3).collect()}) and sum(got.values()) == pytest.approx(1)


def test_every_customer_passes_goods_on(spark, tmp_path):
    """Customers in nations of odd numbers too, one without a nation and one that is in two."""
    tables = {"customer": ([(1, "a", 3, 0.0, "x"), (2, "b", 4, 0.0, "x"), (3, "c", None, 0.0, "x"), (4, "d", 5, 0.0, "x"), (4, "d", 6, 0.0, "x")], catalogs.SCHEMAS["customer"]),
              "orders": ([(10 * i, i, "O", 1.0, datetime.datetime(2000, 1, 1), "1-URGENT") for i in range(1, 5)], catalogs.SCHEMAS["orders"]),
              "lineitem": ([(10 * i, 1, 1 + i % 2, 1, float(q), 1.0, 0.0, 0.0, "N", "O", datetime.datetime(2000, 2, 1)) for i, q in ((1, 5), (1, 2), (2, 3), (3, 4), (4, 6))], catalogs.SCHEMAS["lineitem"])}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    edges = {("S2", "C1"): 7, ("S1", "C2"): 3, ("S2", "C3"): 4, ("S1", "C4"): 6, ("C1", "N3"): 7, ("C2", "N4"): 3, ("C4", "N5"): 6, ("C4", "N6"): 6}
    assert {(r.source, r.target): r.amount for r in networks.trade(spark, str(tmp_path)).collect()} == edges
    nodes = sorted({n for e in edges for n in e})
    sent = {n: sum(a for (s, _), a in edges.items() if s == n) for n in nodes}
    share = {n: 1 / len(nodes) for n in nodes}
    for _ in range(6):
        idle = sum(share[n] for n in nodes if not sent[n])
        share = {n: 0.15 / len(nodes) + 0.85 * (idle / len(nodes) + sum(share[s] * a / sent[s] for (s, t), a in edges.items() if t == n)) for n in nodes}
    assert {r.node: r.share for r in networks.trade_shares(spark, str(tmp_path)).collect()} == pytest.approx(share, abs=1e-9)

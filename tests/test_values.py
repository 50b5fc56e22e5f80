"""Operators without SQL against plain loops on small fixtures."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tracewright.operators import clusters, coordination, graph, linking
from tracewright.plans import registry

NODES = [f"n{k:02}" for k in range(14)]


@pytest.fixture(scope="module")
def links():
    pick = random.Random(3)
    return {(a, b): float(pick.randrange(1, 9)) for a, b in (pick.sample(NODES, 2) for _ in range(45))}


@pytest.fixture(scope="module")
def edges(spark, links):
    return spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src string, dst string, weight double")


def test_hits_agrees_with_a_plain_iteration(edges, links):
    hub = dict.fromkeys({n for e in links for n in e}, 1.0)
    for _ in range(20):
        auth, new = defaultdict(float), defaultdict(float)
        for (a, b), w in links.items():
            auth[b] += w * hub.get(a, 0.0)
        auth = {n: x / sum(auth.values()) for n, x in auth.items()}
        for (a, b), w in links.items():
            new[a] += w * auth.get(b, 0.0)
        hub = {n: x / sum(new.values()) for n, x in new.items()}
    got = {r["node"]: r for r in graph.hits(edges).collect()}
    assert set(got) == {n for e in links for n in e}
    for n, r in got.items():
        assert r["hub_score"] == pytest.approx(hub.get(n, 0.0)) and r["authority_score"] == pytest.approx(auth.get(n, 0.0))


def test_betweenness_of_all_pivots_agrees_with_counting_shortest_paths(edges, links):
    names, out = sorted({n for e in links for n in e}), defaultdict(set)
    for a, b in links:
        out[a].add(b)

    def reach(s):
        far, ways, queue = {s: 0}, defaultdict(float, {s: 1.0}), deque([s])
        while queue:
            a = queue.popleft()
            for b in out[a]:
                if b not in far:
                    far[b] = far[a] + 1
                    queue.append(b)
                if far[b] == far[a] + 1:
                    ways[b] += ways[a]
        return far, ways

    found = {s: reach(s) for s in names}
    n = len(names)
    got = {r["node"]: r["betweenness_centrality"] for r in graph.betweenness(edges).collect()}
    for v in names:
        through = 0.0
        for s in names:
            far, ways = found[s]
            for t in far:
                if v not in (s, t) and v in far and t in found[v][0] and far[v] + found[v][0][t] == far[t]:
                    through += ways[v] * found[v][1][t] / ways[t]
        assert got[v] == pytest.approx(through / ((n - 1) * (n - 2)))


def test_consensus_agrees_with_a_plain_loop(spark):
    rows = [("a", "x", "1", 0.9), ("b", "x", "1", 0.7), ("c", "x", "2", 0.6), ("d", "x", "2", 0.8), ("b", "y", "7", 0.3), ("c", "y", "7", 0.2), ("e", "y", "9", 0.5)]
    groups = defaultdict(list)
    for a, kind, cluster, weight in rows:
        groups[kind, cluster].append((a, weight))
    pairs = defaultdict(float)
    for members in groups.values():
        members.sort()
        for i, (a, _) in enumerate(members):
            for b, _ in members[i + 1 :]:
                pairs[a, b] = max(pairs[a, b], members[0][1])
    names = sorted({r[0] for r in rows})
    label = {n: n for n in names}
    top = {n: max((w for p, w in pairs.items() if n in p), default=None) for n in names}
    for _ in range(10):
        new = {}
        for n in names:
            votes = defaultdict(float)
            for (a, b), w in pairs.items():
                if n in (a, b):
                    votes[label[b if n == a else a]] += w
            if top[n] is not None:
                votes[label[n]] += top[n]
            new[n] = min(votes, key=lambda x: (-round(votes[x], 9), x)) if votes else label[n]
        if new == label:
            break
        label = new
    df = spark.createDataFrame(rows, "address string, cluster_type string, cluster_id string, confidence double")
    got = {r["address"]: (r["cluster_id"], r["confidence"]) for r in linking.consensus(df).collect()}
    assert got == {n: (label[n], 0.1 if top[n] is None else top[n]) for n in names}


def test_coordination_graph_of_two_components(spark):
    pairs = spark.createDataFrame([("a", "b", 0.8), ("b", "a", 0.9), ("b", "c", 0.7), ("x", "y", 1.0)], "a string, b string, coactivity double")
    got = sorted((r["cluster"], r["size"], r["links"], round(r["mean_score"], 6), round(r["density"], 6)) for r in coordination.coordination_graph(pairs).collect())
    assert got == [("a", 3, 2, 0.8, round(2 / 3, 6)), ("x", 2, 1, 1.0, 1.0)]


def test_a_sample_has_its_share_of_every_cluster(spark):
    a = spark.range(4000).select(F.col("id").cast("string").alias("address"), F.when(F.col("id") < 3, "small").otherwise((F.col("id") % 2).cast("string")).alias("cluster_id"))
    counts = {r["cluster_id"]: r["count"] for r in clusters.stratified_sample(a, 0.2).groupBy("cluster_id").count().collect()}
    assert 1 <= counts["small"] <= 3 and all(330 <= counts[k] <= 470 for k in "01")


def test_validation_sees_all_features(spark):
    (row,) = registry.queries()["f10_feature_validation"](spark, "/root/testdata/sf0.001").collect()
    assert row["n_features"] == 111 and row["complete"]

"""Clusters, windows, fingerprints, learned operators and reports on small frames."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import clusters, evolution, fingerprints, learning, privacy, reports, risk
from tracewright.sources.ledger import enriched


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def assigned(spark, data):
    return frame(spark, [(a, c, 0.9) for a, c in data], "address string, cluster_id string, confidence double")


def test_life_spans_meet_once_in_any_bucket(spark):
    rng = random.Random(1)
    lives = [(f"c{i:02}", s, s + rng.randrange(0, 900)) for i, s in enumerate(rng.choices(range(2000), k=40))]
    got = rows(clusters.overlapping(frame(spark, lives, "cluster_id string, first_seen long, last_seen long"), least=10, width=100), "a", "b", "overlap")
    want = [(x[0], y[0], min(x[2], y[2]) - max(x[1], y[1])) for x, y in combinations(sorted(lives), 2)]
    assert got == [w for w in want if w[2] > 10]


def test_agreement_is_one_for_equal_partitions_and_near_zero_for_unrelated_ones(spark):
    a = assigned(spark, [(f"x{i}", f"c{i % 3}") for i in range(90)])
    same = a.withColumn("cluster_id", F.concat(F.lit("z"), "cluster_id"))
    other = assigned(spark, [(f"x{i}", f"d{i // 3 % 3}") for i in range(90)])
    (one,), (none,) = clusters.agreement(a, same).collect(), clusters.agreement(a, other).collect()
    assert [round(one[c], 9) for c in ("ari", "nmi", "count_similarity", "overall")] == [1.0] * 4
    assert abs(none["ari"]) < 0.05 and abs(none["nmi"]) < 0.01


def test_every_cluster_is_sampled(spark):
    a = assigned(spark, [(f"x{i}", f"c{i % 7}") for i in range(70)])
    got = clusters.stratified_sample(a, 0.1)
    assert {c for (c,) in rows(got, "cluster_id")} == {f"c{i}" for i in range(7)} and got.count() < 30


def test_cluster_operators_on_empty_tables(spark):
    none = assigned(spark, [])
    edges = frame(spark, [], "src string, dst string, weight double, n_tx long")
    assert clusters.connectivity(edges, none).count() == 0 and clusters.internal_topology(edges, none).count() == 0
    assert clusters.inter_cluster_flows(edges, none).count() == 0 and clusters.size_profile(none).first()["clusters"] == 0
    assert clusters.agreement(none, none).first()["count_similarity"] is None and clusters.quality(edges, none, none).count() == 1


@pytest.fixture(scope="module")
def ledger(spark):
    data = [(f"0x{i:03}", i * 3000, f"a{i % 5}", f"a{(i * 7 + 1) % 5}", float(i % 4), 21000, 1_000_000_000, "deposit" if i % 3 else "") for i in range(100)]
    return enriched(frame(spark, data, "hash string, timestamp long, from_addr string, to_addr string, value_eth double, gas long, gas_price long, method_name string"))


def test_windows_are_complete_and_half_open(spark, ledger):
    got = rows(evolution.windows(ledger, 86400, 30000).groupBy("k").count(), "k", "count")
    times = [i * 3000 for i in range(100)]
    want = [(k, sum(k * 30000 <= t < k * 30000 + 86400 for t in times)) for k in range(20) if k * 30000 + 86400 <= times[-1]]
    assert got == [w for w in want if w[1]]


def test_sudden_growth_stands_out(spark):
    m = frame(spark, [(k, 10, 100 if k == 9 else 10, 0.1) for k in range(12)], "k long, nodes long, edges long, density double")
    assert rows(evolution.evolution(m).where("growth_spike"), "k") == [(8,)]


def test_waking_clusters(spark):
    activity = frame(spark, [(0, "a"), (1, "a"), (1, "b"), (3, "a"), (3, "b"), (3, "c"), (3, "d")], "k long, cluster_id string")
    assert rows(evolution.activations(activity), "k", "activated") == [(1, 1), (3, 4)]
    assert rows(evolution.synchronised(activity, 0.5), "k") == [(3,)]


def brute_density_clusters(values, eps, least):
    core = sorted(v for v in values if sum(abs(v - w) <= eps for w in values) >= least)
    return len(core), sum(i == 0 or v - core[i - 1] > eps for i, v in enumerate(core))


@pytest.mark.parametrize("seed", range(4))
def test_value_clusters_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    values = [round(rng.uniform(0, 12), 2) for _ in range(300)] + [5.0] * 6 + [-0.3, -0.2, 100.0]
    got = privacy.value_clusters(frame(spark, [(v,) for v in values] + [(None,)], "value_eth double")).agg(F.sum("n"), F.count_if("begins")).first()
    assert tuple(got) == brute_density_clusters(values, 0.1, 5)


def test_pairing_is_that_of_the_greedy_loop(spark):
    rng = random.Random(3)
    links = [(f"n{i:02}", f"n{j:02}", rng.choice([0.81, 0.9, 0.95, 0.99])) for i, j in combinations(range(24), 2) if rng.random() < 0.4]
    used, want = set(), []
    for a, b, s in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b, s))
    df = frame(spark, links, "a string, b string, similarity double")
    assert rows(fingerprints.disjoint_pairs(df), "a", "b", "similarity") == sorted(want)
    assert fingerprints.disjoint_pairs(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    x[:, 2] = x[:, 0] + 0.1 * x[:, 2]
    data = [(f"p{i:03}", *map(float, r)) for i, r in enumerate(x)] + [("far", 9.0, -9.0, 9.0), ("odd", 2.0, 0.0, -2.0), ("none", None, float("nan"), float("inf"))]
    return frame(spark, data, "address string, x double, y double, z double")


def test_forest_and_distance_find_what_is_far(spark, points):
    forest, distance = (f(points, ["x", "y", "z"], share=0.01) for f in (learning.isolation_forest, learning.covariance_distance))
    assert ("far",) in rows(forest, "address") and forest.count() <= 5
    assert {("far",), ("odd",)} <= set(rows(distance, "address")) and distance.count() <= 5
    assert rows(forest, "address", "score") == rows(learning.isolation_forest(points, ["x", "y", "z"], share=0.01), "address", "score")
    both = learning.combine(forest, distance)
    assert ("far", 2) in rows(both, "address", "method_count")


def test_learned_operators_on_empty_tables(spark, points):
    none = points.limit(0)
    assert learning.isolation_forest(none, ["x"]).count() == 0 and learning.covariance_distance(none, ["x"]).count() == 0
    assert learning.pattern_clusters(none, ["x"]).count() == 0 and learning.dependence_graph(none, ["x", "y"]).count() == 0


def test_clusters_of_patterns_and_their_outliers(spark):
    data = [(f"a{i}", float(i % 2 * 50 + i % 5), 1.0) for i in range(60)] + [("out", 12.0, 1.0)]
    got = learning.pattern_clusters(frame(spark, data, "address string, x double, constant double"), ["x", "constant"])
    low = {r["cluster"] for r in got.where("x < 5").collect()}
    assert len(low) == 1 and not low & {r["cluster"] for r in got.where("x >= 50").collect()}
    same = got.where("x < 20").withColumn("cluster", F.lit(0))
    assert rows(learning.outliers_in_clusters(same, ["x", "constant"]), "address", "feature") == [("out", "x")]


def test_effect_is_that_of_least_squares(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(500, 2))
    t = c[:, 0] + rng.normal(size=500)
    y = 3 * t - 2 * c[:, 0] + c[:, 1] + 0.1 * rng.normal(size=500)
    df = frame(spark, [tuple(map(float, r)) for r in np.column_stack([t, y, c])], "t double, y double, c1 double, c2 double")
    x = np.column_stack([np.ones(500), t, c])
    beta, residual, *_ = np.linalg.lstsq(x, y, rcond=None)
    got = learning.average_effect(df, "t", "y", ["c1", "c2"]).first()
    assert abs(got["effect"] - beta[1]) < 1e-9
    assert abs(got["std_error"] - np.sqrt(residual[0] / 496 * np.linalg.inv(x.T @ x)[1, 1])) < 1e-9


def test_a_chain_has_no_edge_between_its_ends(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    y = x + rng.normal(size=2000)
    z = y + rng.normal(size=2000)
    df = frame(spark, [(*map(float, r), 1.0) for r in np.column_stack([x, y, z])], "x double, y double, z double, constant double")
    assert rows(learning.dependence_graph(df, ["x", "y", "z", "constant"], alpha=0.001), "a", "b") == [("x", "y"), ("y", "z")]


def test_nearest_centroid_in_any_blocks(spark):
    rng = np.random.default_rng(3)
    data = [(i, i % 6, rng.normal(size=4).tolist()) for i in range(80)] + [(100, 1, None), (101, None, [0.0] * 4)]
    df = frame(spark, data, "id long, label int, v array<double>")
    means = learning.centroids(df, "label", "v")
    whole, cut = (rows(learning.nearest_centroid(df, "id", "v", means, b), "id", "cluster") for b in (4096, 1))
    assert whole == cut and len(whole) == 80
    c = {r["cluster"]: np.array(r["centroid"]) for r in means.collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert whole == [(i, max(sorted(c), key=lambda k: cos(np.array(v), c[k]))) for i, _, v in data[:80]]
    assert learning.nearest_centroid(df, "id", "v", means.limit(0)).count() == 0


def test_neighbour_means(spark):
    e = frame(spark, [("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "src string, dst string")
    f = frame(spark, [("a", 1.0), ("b", 2.0), ("c", 4.0), ("d", 8.0)], "address string, x double")
    assert rows(learning.neighbour_features(e, f, ["x"]), "address", "near_x") == [("a", 3.0), ("b", 1.0), ("c", 1.0), ("d", 0.0)]


def test_report_orders_evidence_and_reads_links(spark, tmp_path):
    e = frame(spark, [("a", "gnn_risk", 0.2, 1.0), ("a", "other", 0.9, 1.0), ("a", "b_tie", 0.9, 1.0)], "address string, component_type string, risk_score double, confidence double")
    r = reports.address_report(risk.final_scores(e), e, assigned(spark, [])).first()
    assert (r["evidence"], r["strongest"], r["n_evidence"], r["cluster_id"]) == ("b_tie, other, gnn_risk", "b_tie", 3, None)
    assert abs(sum(s for (s,) in rows(reports.contributions(e), "share")) - 1) < 1e-12
    links = frame(spark, [("a", '{"linked_addresses": ["b", "a", "b"]}'), ("c", "not json"), ("d", None)], "address string, evidence_json string")
    assert rows(reports.linked_addresses(links), "address", "linked") == [("a", "b")]
    reports.write_csv(e.withColumn("tags", F.array(F.lit("x"))), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3

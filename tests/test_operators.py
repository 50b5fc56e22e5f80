"""Operators on small frames with values worked out by hand."""

from pyspark.sql import functions as F

from tracewright.functions import stats
from tracewright.operators import flow, graph, incidence, risk
from tracewright.sources import ingest


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def ledger(spark, data):
    return spark.createDataFrame([(f"0x{i}", t, a, b, v) for i, (t, a, b, v) in enumerate(data)], "hash string, timestamp long, from_addr string, to_addr string, value_eth double")


def test_self_transfer_has_one_row(spark):
    inc = incidence.incidence(ledger(spark, [(1, "a", "a", 1.0), (2, "a", None, 1.0), (3, "a", "b", 2.0)]))
    assert rows(inc, "address", "hash") == [("a", "0x0"), ("a", "0x1"), ("a", "0x2"), ("b", "0x2")]


def test_near_in_time_is_inclusive(spark):
    left = spark.createDataFrame([("k", 0), ("k", 3600)], "k string, a long")
    right = spark.createDataFrame([("k", 3600), ("k", 7201)], "k string, b long")
    assert rows(incidence.near_in_time(left, right, ["k"], "a", "b", 3600), "a", "b") == [(0, 3600), (3600, 3600)]


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), ("c", 0.0), ("c", 0.0)], "k string, x double")
    assert [round(v, 4) for (v,) in rows(df.where("k = 'a'").agg(stats.sample_skewness(F.col("x")).alias("s")), "s")] == [1.6523]
    assert [(k, round(g, 4)) for k, g in rows(stats.gini(df, ["k"], "x", "g"), "k", "g")] == [("a", 0.4615), ("b", 0.0), ("c", 0.0)]
    assert [(k, round(h, 4)) for k, h in rows(stats.entropy(df, ["k"], "x", "h"), "k", "h")] == [("a", 1.585), ("b", 0.0), ("c", 0.0)]


def test_components_of_a_long_path_and_a_star(spark):
    pairs = [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(20)]
    found = dict(rows(graph.components(spark.createDataFrame(pairs, "u string, v string")), "node", "component"))
    assert {v for k, v in found.items() if k[0] == "p"} == {"p000"} and {v for k, v in found.items() if k[0] != "p"} == {"hub"}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_triangles_and_cycles(spark):
    e = graph.edges(ledger(spark, [(1, "a", "b", 1.0), (2, "b", "c", 1.0), (3, "c", "a", 1.0), (4, "c", "d", 1.0)]))
    assert rows(graph.clustering(graph.undirected(e)), "node", "triangles") == [("a", 1), ("b", 1), ("c", 1), ("d", 0)]
    assert rows(graph.cycles(e, 4), "path") == [(["a", "b", "c"],)]
    assert rows(graph.strong_components(e), "node", "scc") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]


def test_layers_take_the_first_open_sequence(spark):
    tx = ledger(spark, [(1, "a", "b", 1.0), (2, "x", "b", 1.0), (3, "b", "c", 2.0), (4, "c", "d", 3.0)]).withColumn("cluster_id", F.lit("1"))
    assert rows(flow.layers(tx), "sequence", "layers", "total_value", "duration") == [(0, 3, 6.0, 3)]


def test_risk_floor_weights_and_latest_evidence(spark):
    e = spark.createDataFrame([("a", "gnn_risk", 0.0, 1.0, 1), ("b", "other", 1.0, 1.0, 1), ("b", "other", 0.0, 1.0, 2)], "address string, component_type string, risk_score double, confidence double, created_at long")
    got = {r["address"]: r for r in risk.final_scores(risk.active(e)).collect()}
    assert round(got["a"]["final_score"], 4) == round(got["b"]["final_score"], 4) == 0.0759 and got["a"]["risk_category"] == "MINIMAL"


def test_upsert_replaces_by_key(spark):
    old, new = (spark.createDataFrame(d, "k string, v int") for d in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert rows(risk.upsert(old, new, ["k"]), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]


def test_ingest(spark, tmp_path):
    (tmp_path / "deposit").mkdir()
    head = "blockNumber,timeStamp,hash,from,to,value,gas,gasPrice,functionName,isError\n"
    body = "5,1500000000,0xa,0x1,0x2,78000000000000000000000,21000,1000000000,f(),0\n5,1500000000,0xa,0x1,0x9,1,21000,1,,0\n7,99,0xb,0x1,0x2,1,1,1,,0\n7,1500000060,bad,0x1,0x2,1,1,1,,0\n8,1500000120,0xc,0x1,,x,1,1,,1\n"
    (tmp_path / "deposit" / "t.csv").write_text(head + body)
    raw = ingest.read_files(spark, str(tmp_path))
    assert ingest.table_type(raw.columns) == "transactions"
    got = ingest.clean_transactions(raw)
    assert rows(got, "hash", "to_addr", "value_eth", "transaction_type") == [("0xa", "0x2", 78000.0, "deposit"), ("0xc", None, 0.0, "deposit")]
    files = ingest.fingerprints(spark, str(tmp_path))
    assert rows(ingest.load_status(files, files.limit(0)), "load_status") == [("new",)]
    assert rows(ingest.load_status(files, files), "load_status") == [("unchanged",)]
    assert ingest.insert_if_absent(got.limit(1), got).count() == 2

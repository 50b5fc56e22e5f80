"""Registered queries: graph operators on both ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, graph
from ..sources.ledger import INCIDENCE, ORDERS, TX, event_ledger, order_ledger
from .catalog import outer, query, rounded

EDGES = "e AS (SELECT from_addr AS src, to_addr AS dst, sum(value_eth) AS weight, count(*) AS n_tx, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM {0} WHERE from_addr IS NOT NULL AND to_addr IS NOT NULL GROUP BY ALL)"
EV, OR = f"WITH RECURSIVE {TX}, {EDGES.format('tx')}", f"WITH RECURSIVE {ORDERS}, {EDGES.format('ox')}"
PAIRS = "p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst)"
BOTH = "b AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p)"


def _edges(spark, sf_dir):
    return graph.edges(event_ledger(spark, sf_dir))


@query(f"{EV} " + outer("SELECT * FROM e", "src dst ~weight #n_tx #first_ts #last_ts"))
def p1_flow_edges(spark, sf_dir):
    return rounded(_edges(spark, sf_dir))


@query(f"{EV} " + outer("SELECT node, sum(i) AS in_degree, sum(o) AS out_degree, count(DISTINCT x) AS unique_counterparties FROM (SELECT src AS node, 0 AS i, 1 AS o, dst AS x FROM e UNION ALL SELECT dst, 1, 0, src FROM e) GROUP BY node", "node #in_degree #out_degree #unique_counterparties"))
def f3_degrees(spark, sf_dir):
    return rounded(graph.degrees(_edges(spark, sf_dir)))


@query(f"{EV}, {PAIRS}, {BOTH}, t AS (SELECT a.u AS node, count(*) / 2 AS triangles FROM b a JOIN b c ON a.u = c.u AND a.v <> c.v JOIN b d ON d.u = a.v AND d.v = c.v GROUP BY 1), d AS (SELECT u AS node, count(*) AS d FROM b GROUP BY 1) "
       + outer("SELECT node, d, coalesce(triangles, 0) AS triangles, CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(triangles, 0) / (d * (d - 1)) END AS clustering_coefficient FROM d LEFT JOIN t USING (node)", "node #d #triangles ~clustering_coefficient"))
def f3_clustering_coefficient(spark, sf_dir):
    return rounded(graph.clustering(graph.undirected(_edges(spark, sf_dir))))


#: Ranks after so many rounds; a round leaves at most 0.85 of the error.
PAGERANK = """ps AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e WHERE weight > 0), pn AS (SELECT src AS node FROM ps UNION SELECT dst FROM ps), pk AS (SELECT count(*) AS n FROM pn),
pr(k, node, r) AS (SELECT 0, node, 1.0::DOUBLE / n FROM pn, pk UNION ALL SELECT j.k + 1, pn.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(s, 0) + lost / n) FROM pn CROSS JOIN pk
 CROSS JOIN (SELECT max(k) AS k FROM pr) j LEFT JOIN (SELECT dst AS node, sum(p * r) AS s FROM pr JOIN ps ON src = node GROUP BY dst) q ON q.node = pn.node
 CROSS JOIN (SELECT 1 - sum(p * r) AS lost FROM pr JOIN ps ON src = node) l WHERE j.k < 120)"""


@query(f"{EV}, {PAGERANK} SELECT node, round(r, 6) + 0.0 AS pagerank_score FROM pr WHERE k = 120")
def f3_pagerank(spark, sf_dir):
    return rounded(graph.pagerank(_edges(spark, sf_dir)))


@query()
def f3_hits(spark, sf_dir):
    return rounded(graph.hits(_edges(spark, sf_dir)))


@query()
def f3_betweenness(spark, sf_dir):
    return rounded(graph.betweenness(_edges(spark, sf_dir)))


@query(f"{EV}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), d(source, node, k) AS (SELECT node, node, 0 FROM n UNION SELECT d.source, e.src, k + 1 FROM d JOIN e ON e.dst = d.node AND e.src <> e.dst WHERE k < 10), m AS (SELECT source, node, min(k) AS k FROM d GROUP BY ALL) "
       + outer("SELECT source AS node, CASE WHEN sum(k) > 0 THEN (count(*) - 1) / sum(k) * (count(*) - 1) / ((SELECT count(*) FROM n) - 1) ELSE 0 END AS closeness_centrality FROM m GROUP BY source", "node ~closeness_centrality"))
def f3_closeness(spark, sf_dir):
    return rounded(graph.closeness(_edges(spark, sf_dir)))


@query(f"{EV}, d AS (SELECT DISTINCT src, dst FROM e) SELECT src AS node, count(DISTINCT dst)::BIGINT AS reach_2hop FROM (SELECT src, dst FROM d UNION SELECT a.src, b.dst FROM d a JOIN d b ON a.dst = b.src) WHERE src <> dst GROUP BY src")
def f3_reach_two_hops(spark, sf_dir):
    return rounded(graph.reach_two(_edges(spark, sf_dir)))


@query(f"{OR}, {PAIRS}, {BOTH}, cc(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION (SELECT b.v, min(cc.component) FROM cc JOIN b ON b.u = cc.node JOIN recurring.cc AS r ON r.node = b.v WHERE cc.component < r.component GROUP BY b.v)) SELECT node, component FROM cc")
def l3_connected_components(spark, sf_dir):
    e = graph.edges(order_ledger(spark, sf_dir))
    return graph.components(graph.undirected(e))


@query(f"{EV}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m(source, node) AS (SELECT node, node FROM n UNION SELECT m.source, e.dst FROM m JOIN e ON e.src = m.node) "
       "SELECT a.source AS node, min(a.node) AS scc, count(*)::BIGINT AS size FROM m a JOIN m b ON a.source = b.node AND a.node = b.source GROUP BY a.source")
def p5_strong_components(spark, sf_dir):
    return rounded(graph.strong_components(_edges(spark, sf_dir)))


@query(f"{EV}, t AS (SELECT count(*) AS n_edges, sum(weight) AS volume, max(weight) AS max_edge, avg(weight) AS avg_edge, median(weight) AS median_edge FROM e), n AS (SELECT count(*) AS n_nodes FROM (SELECT src FROM e UNION SELECT dst FROM e)) "
       + outer("SELECT *, n_edges / (n_nodes * (n_nodes - 1)) AS density FROM n, t", "#n_nodes #n_edges ~volume ~max_edge ~avg_edge ~median_edge ~density"))
def l12_topology(spark, sf_dir):
    return rounded(graph.topology(_edges(spark, sf_dir)))


@query(f"{EV}, s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst) SELECT a.src AS a, b.src AS b, c.src AS c FROM s a JOIN s b ON a.dst = b.src JOIN s c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src")
def l12_cycles(spark, sf_dir):
    p = F.col("path")
    return graph.cycles(_edges(spark, sf_dir)).select(p[0].alias("a"), p[1].alias("b"), p[2].alias("c"))


for _way, _hub in (("out", "src"), ("in", "dst")):

    def _fan(spark, sf_dir, way=_way):
        return rounded(flow.fans(_edges(spark, sf_dir), way == "out"))

    _fan.__name__ = f"p{3 if _way == 'out' else 4}_fan_{_way}"
    query(f"{EV} " + outer(f"SELECT {_hub} AS address, count(*) AS degree, sum(weight) AS total_value, 1 - stddev_pop(weight) / greatest(avg(weight), 0.001) AS consistency FROM e GROUP BY 1 HAVING count(*) >= 5", "address #degree ~total_value ~consistency"))(_fan)


CHAIN = """k AS (SELECT *, sum(brk) OVER (ORDER BY timestamp, hash) AS chain FROM (SELECT *, CASE WHEN lag(to_addr) OVER w IS NOT NULL AND timestamp - lag(timestamp) OVER w < 3600 AND lag(to_addr) OVER w = from_addr THEN 0 ELSE 1 END AS brk FROM tx WINDOW w AS (ORDER BY timestamp, hash)))"""


@query(f"WITH {TX}, k AS (SELECT *, sum(brk) OVER (PARTITION BY method_name ORDER BY timestamp, hash) AS chain FROM (SELECT *, CASE WHEN lag(to_addr) OVER w IS NOT NULL AND timestamp - lag(timestamp) OVER w < 3600 AND lag(to_addr) OVER w = from_addr THEN 0 ELSE 1 END AS brk FROM tx WINDOW w AS (PARTITION BY method_name ORDER BY timestamp, hash))) "
       + outer("SELECT method_name, count(*) AS length, max(timestamp) - min(timestamp) AS duration, sum(value_eth) AS total_value, avg(value_eth) AS avg_value, arg_min(hash, (timestamp, hash)) AS first_hash, arg_max(hash, (timestamp, hash)) AS last_hash FROM k GROUP BY method_name, chain HAVING count(*) >= 2", "method_name #length #duration ~total_value ~avg_value first_hash last_hash"))
def p2_rapid_chains(spark, sf_dir):
    return rounded(flow.rapid_chains(event_ledger(spark, sf_dir), ["method_name"], least=2).drop("addresses"))


@query()
def p6_layered_sequences(spark, sf_dir):
    tx = event_ledger(spark, sf_dir).withColumn("cluster_id", F.concat(F.lit("h"), (F.col("hour_of_day") % 4).cast("string")))
    return rounded(flow.layers(tx).drop("addresses"))


@query(f"WITH {TX}, c AS (SELECT timestamp // 3600 AS hour, count(*) AS n FROM tx GROUP BY 1), s AS (SELECT unnest(range((SELECT min(hour) FROM c), (SELECT max(hour) FROM c) + 1)) AS hour), h AS (SELECT hour, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (hour)), m AS (SELECT count(*) AS hours, avg(n) AS mean_per_hour, stddev_samp(n) AS std_per_hour FROM h) "
       + outer("SELECT hours, mean_per_hour, std_per_hour, (SELECT count(*) FROM h WHERE n > mean_per_hour + 2 * std_per_hour) AS burst_hours FROM m", "#hours ~mean_per_hour ~std_per_hour #burst_hours"))
def p7_temporal_flow(spark, sf_dir):
    return rounded(flow.temporal_flow(event_ledger(spark, sf_dir)))


PATHS = "g AS (SELECT from_addr AS src, to_addr AS dst, sum(value_eth) AS w, min(timestamp) AS lo, max(timestamp) AS hi FROM ox GROUP BY ALL), two AS (SELECT a.src AS a, a.dst AS b, z.dst AS c, a.w + z.w AS volume, greatest(a.hi, z.hi) - least(a.lo, z.lo) AS span FROM g a JOIN g z ON a.dst = z.src)"


@query(f"WITH {ORDERS}, {PATHS} " + outer("SELECT sha256(a || '>' || b || '>' || c) AS path_id, 2 AS hops, volume, span, 'linear_path' AS path_type, least(1, 0.05 + CASE WHEN volume > 50 AND span < 21600 THEN 0.4 * least(volume, 500) / 500 WHEN volume > 100 THEN 0.2 ELSE 0 END) AS score FROM two", "path_id #hops ~volume #span path_type ~score"))
def h1_multihop_paths(spark, sf_dir):
    p = graph.paths(graph.edges(order_ledger(spark, sf_dir)))
    return rounded(p.drop("path").withColumn("path_type", flow.path_type(F.col("hops"))).withColumn("score", flow.path_score(F.col("hops"), F.col("volume"), F.col("span"))))


@query(f"WITH {ORDERS}, {PATHS} " + outer("SELECT count(*) AS paths, min(2) AS min_hops, max(2) AS max_hops, avg(volume) AS avg_volume, count(*) FILTER (volume > 100) AS high_volume_paths, count(*) FILTER (span < 3600) AS rapid_paths FROM two", "#paths #min_hops #max_hops ~avg_volume #high_volume_paths #rapid_paths"))
def h5_path_summary(spark, sf_dir):
    p = graph.paths(graph.edges(order_ledger(spark, sf_dir)))
    return rounded(p.agg(F.count("*").alias("paths"), F.min("hops").alias("min_hops"), F.max("hops").alias("max_hops"), F.avg("volume").alias("avg_volume"), F.count_if(F.col("volume") > 100).alias("high_volume_paths"), F.count_if(F.col("span") < 3600).alias("rapid_paths")))


@query(f"WITH {ORDERS}, {PATHS}, s AS (SELECT *, least(1, 0.05 + CASE WHEN volume > 50 AND span < 21600 THEN 0.4 * least(volume, 500) / 500 WHEN volume > 100 THEN 0.2 ELSE 0 END) AS score FROM two) " + outer("SELECT x AS address, 'multihop_risk' AS component_type, max(score) AS risk_score, 0.85::DOUBLE AS confidence FROM (SELECT unnest([a, b, c]) AS x, score FROM s) GROUP BY 1 HAVING max(score) > 0.1", "address component_type ~risk_score ~confidence"))
def h6_multihop_component(spark, sf_dir):
    from ..operators.risk import component

    p = graph.paths(graph.edges(order_ledger(spark, sf_dir))).withColumn("score", flow.path_score(F.col("hops"), F.col("volume"), F.col("span")))
    top = p.select(F.explode("path").alias("address"), "score").groupBy("address").agg(F.max("score").alias("score")).where("score > 0.1")
    return rounded(component(top, "multihop_risk", F.col("score"), 0.85))


@query(f"WITH {TX}, r AS (SELECT from_addr AS address, value_eth AS v, timestamp AS t, 1 AS o FROM tx UNION ALL SELECT to_addr, value_eth, timestamp, 0 FROM tx), q AS (SELECT *, lag(o) OVER w AS po, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM (SELECT address, t, o, sum(v) AS v FROM r GROUP BY ALL) WINDOW w AS (PARTITION BY address ORDER BY t, o)) "
       + outer("SELECT address, count(*) AS peels, sum(v) AS peeled_value FROM q WHERE o = 1 AND po = 0 AND v < pv AND v >= 0.8 * pv AND t - pt <= 86400 GROUP BY address HAVING count(*) >= 3", "address #peels ~peeled_value"))
def o10_peeling_chains(spark, sf_dir):
    return rounded(flow.peeling(event_ledger(spark, sf_dir)))

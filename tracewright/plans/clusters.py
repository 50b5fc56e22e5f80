"""Registered queries: clusters, their quality, and the graph over sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import evolution as V
from ..operators import graph
from ..operators.incidence import incidence
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import outer, query, rounded
from .graph import EDGES

#: The test assignment: users by the last digit of their address, those with a 9 left out.
ASSIGNED = """asg AS (SELECT DISTINCT address, 'c' || right(address, 1) AS cluster_id, (right(address, 1)::INT + 1) / 10 AS confidence FROM inc WHERE address LIKE '0x000%' AND right(address, 1) <> '9')"""
CLUSTERED = "ci AS (SELECT DISTINCT cluster_id, hash, timestamp, value_eth FROM inc JOIN asg USING (address))"
STATS = """st AS (SELECT cluster_id, node_count, n_tx, volume, first_seen, last_seen FROM (SELECT cluster_id, count(*) AS node_count FROM asg GROUP BY 1)
 JOIN (SELECT cluster_id, count(*) AS n_tx, sum(value_eth) AS volume, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ci GROUP BY 1) USING (cluster_id))"""
WITH = f"WITH {TX}, {INCIDENCE}, {ASSIGNED}, {CLUSTERED}, {EDGES.format('tx')}, {STATS}"
SIDES = "sd AS (SELECT e.*, x.cluster_id AS a, y.cluster_id AS b FROM e JOIN asg x ON x.address = src JOIN asg y ON y.address = dst)"
PAIRS = "pr AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst), ps AS (SELECT x.cluster_id AS a, y.cluster_id AS b FROM pr JOIN asg x ON x.address = u JOIN asg y ON y.address = v)"
LINKS = "cn AS (SELECT cluster_id, node_count, count(*) FILTER (a = b) AS inner_pairs, count(*) FILTER (a <> b) AS outer_pairs, CASE WHEN node_count > 1 THEN 2 * inner_pairs / (node_count * (node_count - 1)) ELSE 0 END AS density FROM st LEFT JOIN ps ON cluster_id IN (a, b) GROUP BY cluster_id, node_count)"


def _assignment(tx):
    digit = F.right("address", F.lit(1))
    rows = incidence(tx).where("address like '0x000%'").select("address").distinct().where(digit != "9")
    return rows.select("address", F.concat(F.lit("c"), digit).alias("cluster_id"), ((digit.cast("int") + 1) / 10).alias("confidence"))


def _ledger(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    return tx, _assignment(tx)


@query(f"{WITH} " + outer("SELECT *, (last_seen - first_seen) / 3600 AS duration_hours, n_tx / greatest((last_seen - first_seen) / 3600, 1) AS tx_per_hour, duration_hours < 24 AND node_count > 10 AS coordinated_burst, tx_per_hour > 100 AS high_frequency FROM st", "cluster_id #node_count #n_tx ~volume #first_seen #last_seen ~duration_hours ~tx_per_hour coordinated_burst high_frequency"))
def l5_cluster_stats(spark, sf_dir):
    return rounded(C.cluster_stats(*_ledger(spark, sf_dir)))


@query(f"{WITH} SELECT x.cluster_id AS a, y.cluster_id AS b, (least(x.last_seen, y.last_seen) - greatest(x.first_seen, y.first_seen))::BIGINT AS overlap FROM st x JOIN st y ON x.cluster_id < y.cluster_id WHERE overlap > 3600")
def j15_cluster_overlaps(spark, sf_dir):
    # a short bucket, so that lives span many of them
    return rounded(C.overlapping(C.cluster_stats(*_ledger(spark, sf_dir)), width=86400 * 7))


@query(f"{WITH}, {SIDES} " + outer("SELECT a AS src_cluster, b AS dst_cluster, sum(weight) AS volume, sum(n_tx) AS n_tx FROM sd WHERE a <> b GROUP BY ALL", "src_cluster dst_cluster ~volume #n_tx"))
def j3_inter_cluster_flows(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(C.inter_cluster_flows(graph.edges(tx), a))


@query(f"{WITH}, {SIDES} " + outer("SELECT a AS src_cluster, b AS dst_cluster, sum(weight) AS volume, sum(n_tx) AS n_tx FROM sd WHERE a <> b GROUP BY ALL ORDER BY round(sum(weight), 6) DESC, 1, 2 LIMIT 25", "src_cluster dst_cluster ~volume #n_tx"))
def k3a_top_cluster_flows(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    flows = rounded(C.inter_cluster_flows(graph.edges(tx), a))
    return flows.orderBy(F.col("volume").desc(), "src_cluster", "dst_cluster").limit(25)


@query(f"{WITH}, {PAIRS}, {LINKS} " + outer("SELECT * FROM cn", "cluster_id #node_count #inner_pairs #outer_pairs ~density"))
def l8b_cluster_connectivity(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(C.connectivity(graph.edges(tx), a))


TOPOLOGY = """tp AS (SELECT cluster_id, node_count, n_edges, s AS volume, max_edge, CASE WHEN n_edges <= 1 OR s = 0 THEN 0 ELSE 2 * g / (n_edges * s) - (n_edges + 1) / n_edges END AS flow_gini, CASE WHEN node_count > 1 THEN n_edges / (node_count * (node_count - 1)) ELSE 0 END AS density
 FROM (SELECT st.cluster_id, node_count, count(weight) AS n_edges, coalesce(sum(weight), 0) AS s, coalesce(max(weight), 0) AS max_edge, sum(i * weight) AS g FROM st LEFT JOIN (SELECT a AS cluster_id, weight, row_number() OVER (PARTITION BY a ORDER BY weight) AS i FROM sd WHERE a = b) r ON r.cluster_id = st.cluster_id GROUP BY ALL))"""


@query(f"{WITH}, {SIDES}, {TOPOLOGY} " + outer("SELECT * FROM tp", "cluster_id #node_count #n_edges ~volume ~max_edge ~flow_gini ~density"))
def o7_internal_topology(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(C.internal_topology(graph.edges(tx), a))


@query(f"{WITH}, {SIDES}, {TOPOLOGY} " + outer("SELECT cluster_id, least(1, 0.2 * ((density > 0.5 AND node_count > 10)::INT + (flow_gini > 0.8)::INT + (volume > 1000)::INT)) AS risk_score FROM tp", "cluster_id ~risk_score"))
def l13_topology_risk(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(C.topology_risk(C.internal_topology(graph.edges(tx), a)).select("cluster_id", "risk_score"))


MOMENTS = "mo AS (SELECT avg(node_count) AS m, stddev_pop(node_count) AS s FROM st)"
PROFILE = """sp AS (SELECT count(*) AS clusters, sum(node_count) AS members, min(node_count) AS min_size, max(node_count) AS max_size, avg(node_count) AS mean_size, median(node_count) AS median_size, quantile_cont(node_count, 0.25) AS p25, quantile_cont(node_count, 0.75) AS p75, quantile_cont(node_count, 0.95) AS p95,
 stddev_pop(node_count) AS std_size, CASE WHEN any_value(s) > 0 THEN avg(((node_count - m) / s) ** 3) END AS size_skewness, CASE WHEN any_value(s) > 0 THEN avg(((node_count - m) / s) ** 4) - 3 END AS size_kurtosis,
 count(*) FILTER (node_count = 1) AS singletons, stddev_pop(node_count) / avg(node_count) AS size_variation, singletons / clusters AS singleton_ratio, max_size > 0.1 * members AS giant FROM st, mo)"""


@query(f"{WITH}, {MOMENTS}, {PROFILE} " + outer("SELECT * FROM sp", "#clusters #members #min_size #max_size ~mean_size ~median_size ~p25 ~p75 ~p95 ~std_size ~size_skewness ~size_kurtosis #singletons ~size_variation ~singleton_ratio giant"))
def l8c_size_profile(spark, sf_dir):
    return rounded(C.size_profile(_ledger(spark, sf_dir)[1]).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("size_skewness", "size_kurtosis")}))


KNOWN = "kn AS (SELECT avg((cluster_id IS NULL)::INT) AS unassigned FROM (SELECT DISTINCT address FROM inc) LEFT JOIN asg USING (address))"


@query(f"{WITH}, {KNOWN} " + outer("SELECT unassigned AS unassigned_ratio, max(n) / avg(n) AS max_over_mean, avg((c < 0.5)::INT) AS weak_ratio, (unassigned_ratio > 0.5)::INT + (max_over_mean > 10)::INT + (weak_ratio > 0.3)::INT AS issues FROM (SELECT count(*) AS n, avg(confidence) AS c FROM asg GROUP BY cluster_id), kn GROUP BY unassigned", "~unassigned_ratio ~max_over_mean ~weak_ratio #issues"))
def y85_cluster_checks(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(C.checks(a, incidence(tx)))


QUALITY = """ql AS (SELECT (1 - unassigned) * 0.5 + (1 - least(singleton_ratio, 0.8)) * 0.3 + greatest(0, 1 - least(size_variation, 2) / 2) * 0.2 AS basic_stats, inner_ratio * 0.4 + density * 0.4 + (1 - isolated) * 0.2 AS connectivity,
 confidence * 0.5 + strong * 0.3 + greatest(0, 1 - abs(coalesce(size_skewness, 0)) / 3) * 0.2 AS distribution FROM sp, kn,
 (SELECT sum(inner_pairs) / (sum(inner_pairs) + sum(outer_pairs) / 2) AS inner_ratio, avg(density) AS density, avg((inner_pairs + outer_pairs = 0)::INT) AS isolated FROM cn), (SELECT avg(confidence) AS confidence, avg((confidence > 0.7)::INT) AS strong FROM asg))"""


@query(f"{WITH}, {MOMENTS}, {PROFILE}, {KNOWN}, {PAIRS}, {LINKS}, {QUALITY} " + outer("SELECT *, (basic_stats * 0.3 + connectivity * 0.3 + distribution * 0.2) / 0.8 AS overall FROM ql", "~basic_stats ~connectivity ~distribution ~overall"))
def l8f_cluster_quality(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(C.quality(graph.edges(tx), a, incidence(tx)))


@query(f"""{WITH}, o AS (SELECT cluster_id AS x, 'd' || (right(address, 3)::INT % 4) AS y FROM asg), ce AS (SELECT x, y, count(*)::DOUBLE AS n FROM o GROUP BY ALL), cx AS (SELECT x, sum(n) AS n FROM ce GROUP BY 1), cy AS (SELECT y, sum(n) AS n FROM ce GROUP BY 1),
 t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ce) AS p, (SELECT sum(n * (n - 1) / 2) FROM cx) AS px, (SELECT sum(n * (n - 1) / 2) FROM cy) AS py, (SELECT sum(n) FROM ce) AS z, (SELECT count(*) FROM cx) AS kx, (SELECT count(*) FROM cy) AS ky,
  (SELECT -sum(n / s * ln(n / s)) FROM cx, (SELECT sum(n) AS s FROM ce)) AS hx, (SELECT -sum(n / s * ln(n / s)) FROM cy, (SELECT sum(n) AS s FROM ce)) AS hy, (SELECT -sum(n / s * ln(n / s)) FROM ce, (SELECT sum(n) AS s FROM ce)) AS hxy) """
       + outer("SELECT (p - px * py / (z * (z - 1) / 2)) / ((px + py) / 2 - px * py / (z * (z - 1) / 2)) AS ari, 2 * (hx + hy - hxy) / (hx + hy) AS nmi, least(kx, ky) / greatest(kx, ky) AS count_similarity, 0.4 * ari + 0.4 * nmi + 0.2 * count_similarity AS overall FROM t", "~ari ~nmi ~count_similarity ~overall"))
def l8e_cluster_agreement(spark, sf_dir):
    a = _ledger(spark, sf_dir)[1]
    other = a.select("address", F.concat(F.lit("d"), F.right("address", F.lit(3)).cast("int") % 4).alias("cluster_id"))
    return rounded(C.agreement(a, other))


@query(f"{WITH} " + outer("SELECT cluster_id, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day, count(*) AS n_tx, sum(value_eth) AS volume FROM ci GROUP BY 1, 2", "cluster_id day #n_tx ~volume"))
def k3g_cluster_timeline(spark, sf_dir):
    return rounded(C.timeline(*_ledger(spark, sf_dir)))


@query(f"""WITH {TX}, {INCIDENCE}, {ASSIGNED}, s AS (SELECT address, 'cluster' AS kind FROM asg UNION SELECT address, 'mixer' FROM inc WHERE method_name IN ('deposit', 'withdraw') UNION SELECT address, 'zero_value' FROM inc WHERE is_zero_value)
 SELECT address, count(*)::BIGINT AS n_sources, round(count(*) / 3, 6) + 0.0 AS confidence, string_agg(kind, ',' ORDER BY kind) AS sources FROM s GROUP BY 1""")
def l11_consensus(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    inc = incidence(tx)
    out = C.consensus({"cluster": a, "mixer": inc.where("method_name in ('deposit', 'withdraw')"), "zero_value": inc.where("is_zero_value")})
    return rounded(out.withColumn("sources", F.array_join("sources", ",")))


@query()
def t5_stratified_sample(spark, sf_dir):
    return C.stratified_sample(_ledger(spark, sf_dir)[1], 0.2)


WINDOWS = """sn AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM tx), wn AS (SELECT unnest(range(0, (SELECT (hi - lo - 86400) // 43200 + 1 FROM sn))) AS k), wr AS (SELECT k, lo + k * 43200 AS start, tx.* FROM wn, sn JOIN tx ON timestamp >= lo + k * 43200 AND timestamp < lo + k * 43200 + 86400),
 wg AS (SELECT k, from_addr AS src, to_addr AS dst FROM wr WHERE from_addr <> to_addr GROUP BY ALL), wd AS (SELECT k, node, count(*) AS degree FROM (SELECT k, src AS node FROM wg UNION ALL SELECT k, dst FROM wg) GROUP BY ALL),
 wm AS (SELECT *, CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1)) ELSE 0 END AS density, CASE WHEN nodes > 0 THEN 2 * edges / nodes ELSE 0 END AS avg_degree FROM
  (SELECT k, start, count(*) AS n_tx, sum(value_eth) AS volume, avg((method_name IN ('deposit', 'withdraw') OR value_eth IN (0.1, 1, 10, 100))::INT) AS mixer_share, count(*) FILTER (method_name = 'deposit') / greatest(count(*) FILTER (method_name = 'withdraw'), 1) AS deposit_ratio FROM wr GROUP BY 1, 2)
  LEFT JOIN (SELECT k, count(*) AS nodes FROM wd GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS edges FROM wg GROUP BY 1) USING (k))"""
OVER = f"WITH {TX}, {INCIDENCE}, {ASSIGNED}, {WINDOWS}"


def _windows(spark, sf_dir):
    return V.windows(event_ledger(spark, sf_dir))


@query(f"{OVER} " + outer("SELECT * FROM wm", "#k #start #n_tx ~volume ~mixer_share ~deposit_ratio #nodes #edges ~density ~avg_degree"))
def v2_window_metrics(spark, sf_dir):
    return rounded(V.window_metrics(_windows(spark, sf_dir)))


@query(f"""{OVER}, ev AS (SELECT a.k AS k, b.nodes - a.nodes AS node_growth, b.edges - a.edges AS edge_growth, (b.edges - a.edges) / greatest(a.edges, 1) AS growth_rate, b.density - a.density AS density_change FROM wm a JOIN wm b ON b.k = a.k + 1),
 en AS (SELECT avg(growth_rate) AS m1, stddev_pop(growth_rate) AS s1, avg(abs(density_change)) AS m2, stddev_pop(abs(density_change)) AS s2, 1 / (1 + stddev_pop(density_change)) AS stability FROM ev) """
       + outer("SELECT ev.*, stability, growth_rate > m1 + 2 * s1 AS growth_spike, abs(density_change) > m2 + 2 * s2 AS density_shift FROM ev, en", "#k #node_growth #edge_growth ~growth_rate ~density_change ~stability growth_spike density_shift"))
def v3_window_evolution(spark, sf_dir):
    return rounded(V.evolution(V.window_metrics(_windows(spark, sf_dir))))


@query(f"{OVER} " + outer("SELECT k, n_tx, threshold FROM wm, (SELECT avg(n_tx) + 2 * stddev_pop(n_tx) AS threshold FROM wm) WHERE n_tx > threshold", "#k #n_tx ~threshold"))
def v5_activity_spikes(spark, sf_dir):
    return rounded(V.activity_spikes(V.window_metrics(_windows(spark, sf_dir))))


ACTIVE = "ac AS (SELECT k, cluster_id, count(*) AS n_tx, count(DISTINCT from_addr) AS members, max(timestamp) - min(timestamp) AS span FROM wr JOIN asg ON address = from_addr GROUP BY 1, 2)"


@query(f"{OVER}, {ACTIVE} " + outer("SELECT *, n_tx / greatest(span / 3600, 1) AS tx_per_hour FROM ac", "#k cluster_id #n_tx #members #span ~tx_per_hour"))
def y39_cluster_activity(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(V.cluster_activity(V.windows(tx), a))


@query(f"{OVER}, {ACTIVE} SELECT a.k::BIGINT AS k, count(*)::BIGINT AS activated FROM ac a LEFT JOIN ac b ON b.k = a.k - 1 AND b.cluster_id = a.cluster_id WHERE a.k > 0 AND b.k IS NULL GROUP BY 1")
def o5_activated_clusters(spark, sf_dir):
    tx, a = _ledger(spark, sf_dir)
    return rounded(V.activations(V.cluster_activity(V.windows(tx), a)))


@query(f"{OVER} SELECT k::BIGINT AS k, node, degree::BIGINT AS degree FROM wd JOIN (SELECT k, quantile_cont(degree, 0.95) AS bound FROM wd GROUP BY 1) USING (k) WHERE degree > bound AND degree > 10")
def v2b_busy_nodes(spark, sf_dir):
    return rounded(V.busy_nodes(_windows(spark, sf_dir)))


@query(f"WITH {TX}, sn AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM tx) " + outer("SELECT least((timestamp - lo) * 50 // (hi - lo), 49) AS bin, count(*) AS n_tx, count(DISTINCT from_addr) AS senders, sum(value_eth) AS volume FROM tx, sn GROUP BY 1", "#bin #n_tx #senders ~volume"))
def v7_snapshots(spark, sf_dir):
    return rounded(V.snapshots(event_ledger(spark, sf_dir)))


@query(f"WITH {TX}, {INCIDENCE}, s AS (SELECT *, sum(brk) OVER (PARTITION BY address ORDER BY timestamp, hash) AS run FROM (SELECT *, (timestamp - coalesce(lag(timestamp) OVER (PARTITION BY address ORDER BY timestamp, hash), 0) > 3600)::INT AS brk FROM inc)) "
       + outer("SELECT address, count(*) AS n_tx, sum(value_eth) AS volume, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM s GROUP BY address, run", "address #n_tx ~volume #first_ts #last_ts"))
def v20_activity_sessions(spark, sf_dir):
    return rounded(V.sessions(incidence(event_ledger(spark, sf_dir))))

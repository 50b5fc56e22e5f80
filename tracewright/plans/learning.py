"""Registered queries: learned anomalies, pattern clusters, centroids, effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as O
from ..operators import graph
from ..operators import learning as L
from ..operators import mixers as M
from ..operators import sequences as S
from ..operators.incidence import incidence
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import outer, query, rounded
from .features import F5, GAPS
from .typology import _known

RISK = ["unusual_timing_score", "gas_price_anomaly_score", "volume_spike_indicator", "mixing_behavior_score", "privacy_seeking_score", "high_frequency_burst_score", "round_amount_preference"]
DEPOSITS = "deposit_count withdrawal_count total_deposits total_withdrawals interleaving_score uses_round_amounts time_consistency_score pattern_complexity".split()


def _risk(spark, sf_dir):
    return O.risk(incidence(event_ledger(spark, sf_dir)))


@query()
def a2_isolation_forest(spark, sf_dir):
    return rounded(L.isolation_forest(_risk(spark, sf_dir), RISK))


@query()
def a3_covariance_distance(spark, sf_dir):
    return rounded(L.covariance_distance(_risk(spark, sf_dir), RISK))


@query()
def a5_combined_anomalies(spark, sf_dir):
    f = _risk(spark, sf_dir)
    z = S.anomalies(f.select("address", *RISK)).withColumn("method", F.lit("statistical"))
    return rounded(L.combine(L.isolation_forest(f, RISK), L.covariance_distance(f, RISK), z))


def _clusters(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    return L.pattern_clusters(M.deposit_features(tx, _known(tx)), DEPOSITS)


@query()
def b4_pattern_profiles(spark, sf_dir):
    return rounded(L.pattern_profiles(_clusters(spark, sf_dir)))


@query()
def b5_pattern_outliers(spark, sf_dir):
    return rounded(L.outliers_in_clusters(_clusters(spark, sf_dir), DEPOSITS))


@query()
def n1_neighbour_risk(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    inc = incidence(tx)
    label = O.risk(inc).select("address", (F.col("composite_risk_score") > 0.3).alias("label"))
    columns = ["tx_frequency_daily", "active_days_count", "active_hours_count", "night_activity_ratio", "avg_time_gap_hours", "burst_activity_count"]
    return rounded(L.neighbour_risk(graph.edges(tx), O.temporal(inc), columns, label))


CENTROIDS = "ce AS (SELECT cluster, list(m ORDER BY i) AS centroid FROM (SELECT label AS cluster, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {CENTROIDS}, s AS (SELECT vec_id, cluster, list_cosine_similarity(embedding::DOUBLE[], centroid) AS similarity FROM embeddings, ce) " + outer("SELECT vec_id, arg_max(cluster, similarity) AS cluster, max(similarity) AS similarity FROM s GROUP BY 1", "#vec_id #cluster ~similarity"))
def n6_nearest_centroid(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(L.nearest_centroid(e, "vec_id", "embedding", L.centroids(e, "label", "embedding")))


T, A, B, Y = "high_frequency_burst_score", "mixing_behavior_score", "unusual_timing_score", "composite_risk_score"
_cov = lambda x, y: f"covar_samp({x}, {y})"


def _det(m: list[list[str]]) -> str:
    minor = lambda i, j: f"({m[1][i]} * {m[2][j]} - {m[1][j]} * {m[2][i]})"
    return f"({m[0][0]} * {minor(1, 2)} - {m[0][1]} * {minor(0, 2)} + {m[0][2]} * {minor(0, 1)})"


_X = [[_cov(x, y) for y in (T, A, B)] for x in (T, A, B)]
EFFECT = f"{_det([[_cov(x, Y), *row[1:]] for x, row in zip((T, A, B), _X)])} / {_det(_X)}"


@query(f"WITH {TX}, {INCIDENCE}, {GAPS}, f5 AS ({F5}) " + outer(f"SELECT '{T}' AS treatment, '{Y}' AS outcome, {EFFECT} AS effect, count(*) AS n FROM f5", "treatment outcome ~effect #n", 5))
def z2_average_effect(spark, sf_dir):
    return rounded(L.average_effect(_risk(spark, sf_dir), T, Y, [A, B]).drop("std_error"), 5)


@query()
def z1_dependence_graph(spark, sf_dir):
    return rounded(L.dependence_graph(_risk(spark, sf_dir), RISK))

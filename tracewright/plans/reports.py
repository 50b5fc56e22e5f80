"""Registered queries: scores from several kinds of evidence, reports and charts' data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as O
from ..operators import mixers as M
from ..operators import reports as R
from ..operators import risk
from ..operators.incidence import incidence
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import outer, query, rounded
from .clusters import ASSIGNED, _assignment
from .features import COMPONENT, F5, GAPS
from .typology import KNOWN, M4, ROWS, _known

EVIDENCE = f"""{GAPS}, f5 AS ({F5}), {KNOWN}, {ROWS}, {ASSIGNED}, ev AS ({COMPONENT} UNION ALL SELECT address, 'TORNADO_CASH_INTERACTION', risk_score, 0.9::DOUBLE FROM ({M4})),
 wv AS (SELECT *, CASE component_type WHEN 'foundation_risk' THEN 0.2 ELSE 0.8 END::DOUBLE AS w FROM ev),
 fs AS (SELECT address, 1 / (1 + exp(-5 * (sum(risk_score * w * confidence) - 0.5))) AS final_score, sum(w * confidence) / sum(w) AS confidence FROM wv GROUP BY 1),
 fc AS (SELECT *, CASE WHEN final_score >= 0.8 THEN 'CRITICAL' WHEN final_score >= 0.6 THEN 'HIGH' WHEN final_score >= 0.4 THEN 'MEDIUM' WHEN final_score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS risk_category FROM fs)"""
WITH = f"WITH {TX}, {INCIDENCE}, {EVIDENCE}"


def _evidence(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    base = risk.component(O.risk(incidence(tx)), "foundation_risk", F.col("composite_risk_score"), 0.85)
    mixer = risk.component(M.mixer_profiles(tx, _known(tx)), "TORNADO_CASH_INTERACTION", F.col("risk_score"), 0.9)
    return base.unionByName(mixer)


@query(f"{WITH} " + outer("SELECT * FROM fc", "address ~final_score ~confidence risk_category"))
def r4_fused_scores(spark, sf_dir):
    return rounded(risk.final_scores(_evidence(spark, sf_dir)))


@query(f"{WITH} " + outer("SELECT fc.address AS address, final_score, risk_category, cluster_id, evidence, strongest, n_evidence FROM fc LEFT JOIN asg USING (address) LEFT JOIN (SELECT address, string_agg(component_type, ', ' ORDER BY risk_score DESC, component_type) AS evidence, first(component_type ORDER BY risk_score DESC, component_type) AS strongest, count(*) AS n_evidence FROM ev GROUP BY 1) USING (address)", "address ~final_score risk_category cluster_id evidence strongest #n_evidence"))
def k1b_address_report(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    out = R.address_report(risk.final_scores(e), e, _assignment(event_ledger(spark, sf_dir)))
    return rounded(out.drop("confidence"))


@query(f"{WITH} " + outer("SELECT address, component_type, c AS contribution, CASE WHEN t <> 0 THEN c / t ELSE 0 END AS share FROM (SELECT *, risk_score * w * confidence AS c, sum(risk_score * w * confidence) OVER (PARTITION BY address) AS t FROM wv)", "address component_type ~contribution ~share"))
def k3e_contributions(spark, sf_dir):
    return rounded(R.contributions(_evidence(spark, sf_dir)))


@query(f"{WITH} SELECT least(floor(round(final_score, 6) * 50), 49)::BIGINT AS bin, count(*)::BIGINT AS n FROM fc GROUP BY 1")
def k3c_score_histogram(spark, sf_dir):
    return rounded(R.score_histogram(rounded(risk.final_scores(_evidence(spark, sf_dir)))))


@query(f"{WITH} " + outer("SELECT address, final_score, confidence, risk_category FROM fc WHERE final_score > 0.8", "address ~final_score ~confidence risk_category"))
def k1e_attribution(spark, sf_dir):
    return rounded(R.attribution(risk.final_scores(_evidence(spark, sf_dir))))


@query(f"{WITH} " + outer("SELECT address, final_score, cluster_id, CASE WHEN cluster_id IS NULL THEN final_score ELSE max(final_score) OVER (PARTITION BY cluster_id) END AS cluster_score FROM fc LEFT JOIN asg USING (address)", "address ~final_score cluster_id ~cluster_score"))
def r5_cluster_scores(spark, sf_dir):
    scores = risk.final_scores(_evidence(spark, sf_dir)).select("address", "final_score")
    return rounded(risk.propagate(scores, _assignment(event_ledger(spark, sf_dir))))


@query(f"{WITH} SELECT address, 'evidence' AS kind, component_type AS subject FROM ev UNION ALL SELECT address, 'cluster', cluster_id FROM asg UNION ALL SELECT address, 'final', risk_category FROM fc")
def k1c_evidence_log(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return R.evidence_log(e, _assignment(event_ledger(spark, sf_dir)), risk.final_scores(e)).drop("detail")


@query(f"WITH {TX} SELECT day_of_week::BIGINT AS day_of_week, {', '.join(f'count(*) FILTER (hour_of_day = {h})::BIGINT AS h{h}' for h in range(24))} FROM tx GROUP BY 1")
def g22_day_hour_pivot(spark, sf_dir):
    return rounded(R.heat_map(event_ledger(spark, sf_dir)))

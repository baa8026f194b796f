"""Rule, decision and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import decide, monitor, rules
from txnrisk.queries.features import WIDE_SQL, wide_events
from txnrisk.queries.inputs import card_events, decision_log, over_decisions, over_events

_WIDE = WIDE_SQL.replace("wide AS (", "wide AS MATERIALIZED (")


def _stats_sql() -> str:
    """One row per rule, spelled as a union of per-rule counts."""
    parts = [
        f"SELECT {i} AS position, '{name}' AS rule, count(*) FILTER (WHERE {p}) AS flagged, "
        f"count(*) FILTER (WHERE ({p}) AND is_fraud = 1) AS tp, count(*) FILTER (WHERE ({p}) AND is_fraud = 0) AS fp FROM wide"
        for i, (name, p) in enumerate(rules.RULES.items())
    ]
    return (
        "counts AS (" + " UNION ALL ".join(parts) + "), "
        "base AS (SELECT count(*) FILTER (WHERE is_fraud = 1) AS nf, count(*) FILTER (WHERE is_fraud = 0) AS nl, avg(is_fraud) AS baseline FROM wide), "
        "ratio AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN nf > 0 THEN tp / nf ELSE 0 END AS r, "
        "CASE WHEN nl > 0 THEN fp / nl ELSE 0 END AS q FROM counts, base), "
        "stats AS (SELECT position, rule, flagged, tp, round(p, 4) AS precision, round(r, 4) AS recall, "
        "round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, round(p / baseline, 2) AS lift, round(q, 4) AS fpr, baseline FROM ratio)"
    ).replace("base AS", "overall AS").replace("FROM counts, base", "FROM counts, overall")


_STATS = _WIDE + ", " + _stats_sql()
_TIERS = rules.DECLINE_RULES + rules.REVIEW_RULES + rules.MONITOR_RULES


def _in(labels):
    return "(" + ", ".join(f"'{r}'" for r in labels) + ")"


def _any(labels):
    return "coalesce(" + " OR ".join(f"({rules.RULES[r]})" for r in labels) + ", false)"


def _stats(spark, sf_dir):
    return rules.rule_stats(wide_events(spark, sf_dir))


POLICY_THRESHOLD = 0.5

QUERIES = {
    "rule_statistics": lambda s, d: _stats(s, d).drop("position", "baseline"),
    "rule_ranking": lambda s, d: rules.rank_rules(_stats(s, d)).select("rank", "rule", "lift"),
    "rule_points": lambda s, d: rules.rule_points(_stats(s, d)).withColumn("baseline", F.round("baseline", 6)),
    "rule_summary": lambda s, d: rules.rule_summary(_stats(s, d)),
    "tier_coverage": lambda s, d: rules.tier_coverage(wide_events(s, d)),
    "decision_policies": lambda s, d: card_events(s, d).select(
        "trans_num",
        decide.decide("fraud_score").alias("serving"),
        decide.decide_cut("fraud_score", POLICY_THRESHOLD).alias("batch"),
        decide.decide_share("fraud_score", POLICY_THRESHOLD).alias("evaluation"),
    ),
    "decision_records": lambda s, d: decide.decision_record(
        card_events(s, d), scored_at=F.timestamp_seconds("unix_time")
    ).withColumn("scored_at", F.unix_seconds("scored_at")),
    "latest_decisions": lambda s, d: monitor.latest_decisions(decision_log(s, d), 500).withColumn("scored_at", F.unix_micros("scored_at")),
    "decision_display": lambda s, d: decide.format_decisions(monitor.latest_decisions(decision_log(s, d), 500)),
    "decision_kpis": lambda s, d: monitor.kpis(decision_log(s, d)).withColumns(
        {c: F.round(c, 4) for c in ("avg_score", "blocked_amount", "fraud_rate_pct", "decline_rate_pct")}
    ),
    "hourly_rollup": lambda s, d: decide.hour_label(monitor.hourly_rollup(decision_log(s, d))),
    "decision_counts": lambda s, d: monitor.decision_counts(decision_log(s, d)),
    "decision_summary": lambda s, d: monitor.decision_summary(
        card_events(s, d).withColumn("decision", decide.decide_share("fraud_score", POLICY_THRESHOLD))
    ).withColumns({c: F.round(c, 6) for c in ("fraud_rate", "pct_of_total")}),
}

ORACLE = {
    "rule_statistics": over_events("SELECT * EXCLUDE (position, baseline) FROM stats", _STATS),
    "rule_ranking": over_events(
        "SELECT CAST(row_number() OVER (ORDER BY lift DESC, position) AS INT) AS rank, rule, lift FROM stats", _STATS
    ),
    "rule_points": over_events("SELECT rule, recall, precision, lift, fpr, round(baseline, 6) AS baseline FROM stats", _STATS),
    "rule_summary": over_events(
        f"SELECT CASE WHEN rule IN {_in(rules.DECLINE_RULES)} THEN 'DECLINE' WHEN rule IN {_in(rules.REVIEW_RULES)} THEN 'REVIEW' "
        "ELSE 'MONITOR' END AS action, rule, flagged, tp, round(precision * 100, 2) AS precision_pct, round(recall * 100, 2) AS recall_pct, "
        f"lift, round(fpr * 100, 3) AS fpr_pct, f1 FROM stats WHERE rule IN {_in(_TIERS)}",
        _STATS,
    ),
    "tier_coverage": over_events(
        "SELECT *, round(decline_fraud / total_fraud, 6) AS decline_recall, round(decline_legit / total_legit, 6) AS decline_fpr, "
        "round(review_fraud / total_fraud, 6) AS review_recall, round(review_legit / total_legit, 6) AS review_share_legit, "
        "round(missed_fraud / total_fraud, 6) AS missed_share, round((decline_fraud + review_fraud) / total_fraud, 6) AS combined_recall "
        "FROM (SELECT *, total_fraud - decline_fraud - review_fraud AS missed_fraud FROM (SELECT "
        "count(*) FILTER (WHERE is_fraud = 1) AS total_fraud, count(*) FILTER (WHERE is_fraud = 0) AS total_legit, "
        "count(*) FILTER (WHERE d AND is_fraud = 1) AS decline_fraud, count(*) FILTER (WHERE d AND is_fraud = 0) AS decline_legit, "
        "count(*) FILTER (WHERE r AND NOT d AND is_fraud = 1) AS review_fraud, count(*) FILTER (WHERE r AND NOT d AND is_fraud = 0) AS review_legit "
        f"FROM (SELECT is_fraud, {_any(rules.DECLINE_RULES)} AS d, {_any(rules.REVIEW_RULES)} AS r FROM wide)))",
        _WIDE,
    ),
    "decision_policies": over_events(
        "SELECT trans_num, CASE WHEN fraud_score >= 0.8895 THEN 'DECLINE' WHEN fraud_score >= 0.3 THEN 'REVIEW' ELSE 'APPROVE' END AS serving, "
        "CASE WHEN fraud_score <= 0.3 THEN 'approve' WHEN fraud_score <= 0.5 THEN 'review' ELSE 'decline' END AS batch, "
        "CASE WHEN fraud_score >= 0.5 THEN 'decline' WHEN fraud_score >= 0.3 THEN 'review' ELSE 'approve' END AS evaluation FROM txn"
    ),
    "decision_records": over_events(
        "SELECT trans_num, cc_num, merchant, unix_time, amt, round(fraud_score, 6) AS fraud_score, "
        "CASE WHEN fraud_score >= 0.8895 THEN 'DECLINE' WHEN fraud_score >= 0.3 THEN 'REVIEW' ELSE 'APPROVE' END AS decision, "
        "is_fraud AS is_fraud_actual, unix_time AS scored_at FROM txn"
    ),
    "latest_decisions": over_decisions(
        "SELECT * REPLACE (epoch_us(scored_at) AS scored_at) FROM decisions ORDER BY decisions.scored_at DESC, trans_num DESC LIMIT 500"
    ),
    "decision_display": over_decisions(
        "SELECT strftime(scored_at, '%H:%M:%S') AS time, trans_num, merchant, format('${:,.2f}', amt) AS amt, "
        "printf('%.6f', fraud_score) AS fraud_score, decision, is_fraud_actual AS actual_fraud "
        "FROM decisions ORDER BY scored_at DESC, trans_num DESC LIMIT 500"
    ),
    "decision_kpis": over_decisions(
        "SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'DECLINE') AS declined, count(*) FILTER (WHERE decision = 'REVIEW') AS review, "
        "count(*) FILTER (WHERE decision = 'APPROVE') AS approved, count(*) FILTER (WHERE is_fraud_actual = 1) AS actual_fraud, "
        "round(avg(fraud_score), 4) AS avg_score, round(sum(amt) FILTER (WHERE decision = 'DECLINE'), 4) AS blocked_amount, "
        "round(count(*) FILTER (WHERE is_fraud_actual = 1) / count(*) * 100, 4) AS fraud_rate_pct, "
        "round(count(*) FILTER (WHERE decision = 'DECLINE') / count(*) * 100, 4) AS decline_rate_pct FROM decisions"
    ),
    "hourly_rollup": over_decisions(
        "SELECT *, strftime(decision_date, '%Y-%m-%d') || ' ' || lpad(CAST(decision_hour AS VARCHAR), 2, '0') || ':00' AS hour_label FROM ("
        "SELECT CAST(scored_at AS DATE) AS decision_date, CAST(hour(scored_at) AS INT) AS decision_hour, "
        "count(*) FILTER (WHERE decision = 'APPROVE') AS approved, count(*) FILTER (WHERE decision = 'REVIEW') AS reviewed, "
        "count(*) FILTER (WHERE decision = 'DECLINE') AS declined FROM decisions GROUP BY 1, 2)"
    ),
    "decision_counts": over_decisions("SELECT decision, count(*) AS n FROM decisions GROUP BY decision"),
    "decision_summary": over_events(
        "SELECT decision, count(is_fraud) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud, round(sum(is_fraud) / count(is_fraud), 6) AS fraud_rate, "
        "round(count(is_fraud) / any_value(total), 6) AS pct_of_total FROM (SELECT *, count(*) OVER () AS total, "
        "CASE WHEN fraud_score >= 0.5 THEN 'decline' WHEN fraud_score >= 0.3 THEN 'review' ELSE 'approve' END AS decision FROM txn) GROUP BY decision"
    ),
}

"""Model preparation and evaluation queries over the deterministic score, and jobs around a trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.model import curves, encode, evaluate, split
from txnrisk.model.bundle import Bundle
from txnrisk.operators import decide, quality
from txnrisk.queries.features import WIDE_SQL, wide_events
from txnrisk.queries.inputs import CARD_EVENT_NUMBERS, ORDERS_CUTOFF, card_events, order_txns, over_events, over_orders
from txnrisk.schema import CALENDAR_CATEGORIES, GEO_COLUMNS, KEY_COLUMNS, NULL_CATEGORY, TEXT_CATEGORIES
from txnrisk.session import materialise
from txnrisk.sources.files import split_period

SEED = 42
THRESHOLD = 0.5
MIN_RECALL = 0.8
ORDER_CATEGORIES = ["MerchantCategory", "merchant", "nation", "cc_num"]
SERVING_CATEGORIES = ["MerchantCategory", "TransactionHour"]
SERVING_FEATURES = ["amt", "EmailRiskScore", "MerchantCategory", "TransactionHour", "ScoreOfTomorrow"]
CATEGORIES = [*TEXT_CATEGORIES, *CALENDAR_CATEGORIES]
CLASS_ROWS = 5_000
FILLED = ["EmailRiskScore", "AddressConsistencyScore"]


def _r(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _coded(s, d, columns=ORDER_CATEGORIES, first=False):
    """Codes of the train period's orders on the later ones; some cards appear only later."""
    early, late = split_period(order_txns(s, d), "2000-01-01")
    null_as = "nan" if first else NULL_CATEGORY
    encoders = materialise(encode.fit_encoders(early, columns, null_as), "encoders")
    apply = encode.apply_encoders_first if first else encode.apply_encoders
    return apply(late, encoders, columns).select("trans_num", *columns)


def _serving(s, d):
    """Model inputs of serving rows: amounts as text, unknown scores, one feature the rows do not have."""
    rows = card_events(s, d).withColumn("amt", F.col("amt").cast("string"))
    encoders = materialise(encode.fit_encoders(rows, SERVING_CATEGORIES), "encoders")
    bundle = Bundle(None, encoders, SERVING_FEATURES, SERVING_CATEGORIES, THRESHOLD, None, None, None)
    return bundle.vector(rows).select("trans_num", *SERVING_FEATURES)


def _levels(s, d):
    return curves.score_levels(card_events(s, d), "fraud_score")


def _scored(s, d, rows=None):
    df = (rows or card_events(s, d)).withColumnRenamed("fraud_score", "score")
    return df.withColumn("decision", decide.decide_share("score", THRESHOLD))


def _inputs(s, d):
    """The model's inputs in order, which of them are categories, and the known values of each."""
    df = card_events(s, d)
    names = encode.feature_columns(df.schema)
    counts = df.agg(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(c in CATEGORIES).cast("int").alias("is_category"), F.count(c).alias("known")) for i, c in enumerate(names)]).alias("rows"))
    return counts.select(F.inline("rows"))


def _inputs_sql():
    names = [c for c in CARD_EVENT_NUMBERS if c not in (*KEY_COLUMNS, *GEO_COLUMNS)] + TEXT_CATEGORIES
    parts = [f"SELECT {i} AS position, '{c}' AS feature, {int(c in CATEGORIES)} AS is_category, count({c}) AS known FROM txn" for i, c in enumerate(names)]
    return over_events(" UNION ALL ".join(parts))


QUERIES = {
    "model_inputs": _inputs,
    "null_sentinel": lambda s, d: encode.fill_sentinel(card_events(s, d), FILLED).select("trans_num", *FILLED),
    "category_codes": lambda s, d: encode.fit_encoders(card_events(s, d), CATEGORIES),
    "encoded_categories": _coded,
    "encoded_first_class": lambda s, d: _coded(s, d, first=True),
    "serving_vector": _serving,
    "validation_split": lambda s, d: split.validation_flag(card_events(s, d).select("trans_num", "is_fraud")).withColumn(
        "is_validation", F.col("is_validation").cast("int")
    ),
    "validation_split_exact": lambda s, d: split.validation_flag(
        card_events(s, d).select("trans_num", "is_fraud"), exact=True
    ).withColumn("is_validation", F.col("is_validation").cast("int")),
    "class_weight": lambda s, d: split.class_weight(card_events(s, d)),
    "class_sample": lambda s, d: split.seeded_sample(card_events(s, d).select("trans_num", "is_fraud"), CLASS_ROWS, SEED, by="is_fraud"),
    "pr_curve": lambda s, d: _r(curves.pr_curve(_levels(s, d)), ["threshold", "precision", "recall", "f1"], 9),
    "threshold_sweep": lambda s, d: _r(
        curves.threshold_sweep(curves.pr_curve(_levels(s, d))), ["threshold", "precision", "recall", "f1"], 9
    ),
    "roc_curve": lambda s, d: _r(curves.roc_curve(_levels(s, d)), ["threshold", "fpr", "tpr"], 9),
    "ranking_areas": lambda s, d: _r(curves.areas(_levels(s, d)), ["pr_auc", "roc_auc"], 9),
    "best_threshold": lambda s, d: _r(
        curves.best_threshold(curves.pr_curve(_levels(s, d))), ["threshold", "precision", "recall", "f1"], 9
    ),
    "best_threshold_min_recall": lambda s, d: _r(
        curves.best_threshold(curves.pr_curve(_levels(s, d)), MIN_RECALL), ["threshold", "precision", "recall", "f1"], 9
    ),
    "threshold_point": lambda s, d: _r(
        curves.mark_threshold(_levels(s, d), 0.8895), ["threshold", "precision", "recall", "f1", "base_rate"], 9
    ),
    "confusion": lambda s, d: _r(evaluate.confusion(_scored(s, d), 0.8895), ["precision", "recall", "f1"]),
    "evaluation_report": lambda s, d: _r(evaluate.report(evaluate.evaluate(_scored(s, d), 0.8895)), ["value"]),
    "error_counts": lambda s, d: evaluate.error_counts(_scored(s, d)),
    "false_positives": lambda s, d: evaluate.error_sample(_scored(s, d), "FP"),
    "false_negatives": lambda s, d: evaluate.error_sample(_scored(s, d), "FN"),
    "error_means": lambda s, d: evaluate.error_means(_scored(s, d, wide_events(s, d))),
    "score_dependence": lambda s, d: _r(
        evaluate.dependence(_scored(s, d), "IPRiskScore", 10), ["feature_mean", "score_mean"]
    ),
    "top_categories_by_risk": lambda s, d: quality.top_n(
        wide_events(s, d).groupBy("MerchantCategory").agg(F.round(F.avg("RiskSignalWeightedScore"), 6).alias("risk")).dropna(), "risk", 3,
        "MerchantCategory",
    ),
}

_HASH = "CAST('0x' || substr(md5(CAST(trans_num AS VARCHAR) || '#42'), 1, 8) AS BIGINT)"

_LEVELS = (
    "lv AS (SELECT fraud_score AS threshold, count(*) FILTER (WHERE is_fraud = 1) AS pos, count(*) FILTER (WHERE is_fraud = 0) AS neg "
    "FROM txn GROUP BY 1), "
    "cum AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn "
    "FROM lv WINDOW w AS (ORDER BY threshold DESC)), "
    "curve AS (SELECT threshold, CAST(tp / (tp + fp) AS DOUBLE) AS precision, CAST(tp / np AS DOUBLE) AS recall, "
    "CAST(2 * tp / (tp + fp + np) AS DOUBLE) AS f1, fp / nn AS fpr FROM cum)"
)
_POINT = "round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


def _codes(source, columns, null_as="__NA__"):
    numeric = {*CALENDAR_CATEGORIES, "merchant", "nation", "cc_num"}
    parts = []
    for c in columns:
        order = "try_cast(category AS DOUBLE) NULLS LAST, category" if c in numeric else "category"
        parts.append(
            f"SELECT '{c}' AS \"column\", category, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INT) AS code FROM "
            f"(SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), '{null_as}') AS category FROM {source})"
        )
    return " UNION ALL ".join(parts)


def _apply(columns, unseen, null_as="__NA__"):
    cols = ", ".join(f"coalesce(e{i}.code, {unseen}) AS {c}" for i, c in enumerate(columns))
    joins = " ".join(
        f"LEFT JOIN codes e{i} ON e{i}.\"column\" = '{c}' AND e{i}.category = coalesce(CAST(txn.{c} AS VARCHAR), '{null_as}')"
        for i, c in enumerate(columns)
    )
    fitted = f"fitted AS (SELECT * FROM txn WHERE unix_time < {ORDERS_CUTOFF}), codes AS ({_codes('fitted', columns, null_as)})"
    return over_orders(f"SELECT txn.trans_num, {cols} FROM txn {joins} WHERE unix_time >= {ORDERS_CUTOFF}", fitted)


_SCORED = (
    "scored AS (SELECT * RENAME (fraud_score AS score), CASE WHEN fraud_score >= 0.5 THEN 'decline' WHEN fraud_score >= 0.3 THEN 'review' "
    "ELSE 'approve' END AS decision FROM txn), kinds AS (SELECT *, CASE WHEN is_fraud = 0 AND decision = 'decline' THEN 'FP' "
    "WHEN is_fraud = 1 AND decision = 'approve' THEN 'FN' WHEN is_fraud = 1 AND decision = 'decline' THEN 'TP' END AS slice FROM scored)"
)
_SHOWN = "score, amt, BotLikelihoodScore, IPRiskScore, CheckoutTimeSec, SessionDurationSec, IsNewDevice, IsVPN"
_CONFUSION = (
    "conf AS (SELECT count(*) FILTER (WHERE is_fraud = 0 AND fraud_score < 0.8895) AS tn, count(*) FILTER (WHERE is_fraud = 0 AND fraud_score >= 0.8895) AS fp, "
    "count(*) FILTER (WHERE is_fraud = 1 AND fraud_score < 0.8895) AS fn, count(*) FILTER (WHERE is_fraud = 1 AND fraud_score >= 0.8895) AS tp FROM txn), "
    "rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, "
    "CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM conf)"
)
_AREAS = (
    "area AS (SELECT sum(pos * tp / (tp + fp)) / any_value(np) AS pr_auc, sum(neg * (tp - pos / 2)) / (any_value(np) * any_value(nn)) AS roc_auc FROM cum)"
)


def _report_sql():
    values = {
        "threshold": "0.8895",
        "fraud_caught": "tp / (tp + fn)",
        "legit_blocked": "fp / (fp + tn)",
    }
    parts = [
        f"SELECT '{m}' AS metric, round(CAST({values.get(m, m)} AS DOUBLE), 6) AS value FROM rates, area" for m in evaluate.REPORT_METRICS
    ]
    return over_events(" UNION ALL ".join(parts), f"{_LEVELS}, {_CONFUSION}, {_AREAS}")


def _compared(c):
    means = ", ".join(f"round(avg({c}) FILTER (WHERE slice = '{k}'), 3) AS {k.lower()}_mean" for k in ("FP", "FN", "TP"))
    return f"SELECT '{c}' AS feature, {means} FROM kinds"


ORACLE = {
    "model_inputs": _inputs_sql(),
    "null_sentinel": over_events("SELECT trans_num, " + ", ".join(f"coalesce({c}, -999.0) AS {c}" for c in FILLED) + " FROM txn"),
    "category_codes": over_events(_codes("txn", CATEGORIES)),
    "encoded_categories": _apply(ORDER_CATEGORIES, -1),
    "encoded_first_class": _apply(ORDER_CATEGORIES, 0, "nan"),
    "serving_vector": over_events(
        "SELECT trans_num, amt, coalesce(EmailRiskScore, -999.0) AS EmailRiskScore, CAST(a.code AS DOUBLE) AS MerchantCategory, "
        "CAST(b.code AS DOUBLE) AS TransactionHour, CAST(-999.0 AS DOUBLE) AS ScoreOfTomorrow FROM txn "
        "JOIN codes a ON a.\"column\" = 'MerchantCategory' AND a.category = coalesce(txn.MerchantCategory, '__NA__') "
        "JOIN codes b ON b.\"column\" = 'TransactionHour' AND b.category = CAST(txn.TransactionHour AS VARCHAR)",
        f"codes AS ({_codes('txn', SERVING_CATEGORIES)})",
    ),
    "validation_split": over_events(f"SELECT trans_num, is_fraud, CAST({_HASH} < 858993459 AS INT) AS is_validation FROM txn"),
    "validation_split_exact": over_events(
        "SELECT trans_num, is_fraud, CAST(row_number() OVER (PARTITION BY is_fraud ORDER BY h, trans_num) <= "
        f"round(count(*) OVER (PARTITION BY is_fraud) * 0.2) AS INT) AS is_validation FROM (SELECT *, {_HASH} AS h FROM txn)"
    ),
    "class_weight": over_events(
        "SELECT count(*) FILTER (WHERE is_fraud = 0) AS n_neg, count(*) FILTER (WHERE is_fraud = 1) AS n_pos, "
        "round(count(*) FILTER (WHERE is_fraud = 0) / count(*) FILTER (WHERE is_fraud = 1), 2) AS scale_pos_weight FROM txn"
    ),
    "class_sample": over_events(
        f"SELECT trans_num, is_fraud FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY {_HASH}, trans_num) AS r FROM txn) WHERE r <= {CLASS_ROWS}"
    ),
    "pr_curve": over_events(f"SELECT {_POINT} FROM curve", _LEVELS),
    "threshold_sweep": over_events(f"SELECT {_POINT} FROM curve ORDER BY curve.threshold", _LEVELS),
    "roc_curve": over_events("SELECT round(threshold, 9) AS threshold, round(fpr, 9) AS fpr, round(recall, 9) AS tpr FROM curve", _LEVELS),
    "ranking_areas": over_events("SELECT round(pr_auc, 9) AS pr_auc, round(roc_auc, 9) AS roc_auc FROM area", f"{_LEVELS}, {_AREAS}"),
    "best_threshold": over_events(f"SELECT {_POINT} FROM curve ORDER BY curve.f1 DESC, curve.threshold LIMIT 1", _LEVELS),
    "best_threshold_min_recall": over_events(
        f"SELECT {_POINT} FROM curve ORDER BY curve.recall >= {MIN_RECALL} DESC, curve.f1 DESC, curve.threshold LIMIT 1", _LEVELS
    ),
    "threshold_point": over_events(f"SELECT {_POINT}, (SELECT round(avg(is_fraud), 9) FROM txn) AS base_rate FROM curve ORDER BY abs(curve.threshold - 0.8895), curve.threshold LIMIT 1", _LEVELS),
    "confusion": over_events(
        "SELECT tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rates", _CONFUSION
    ),
    "evaluation_report": _report_sql(),
    "error_counts": over_events("SELECT slice, count(*) AS n FROM kinds WHERE slice IS NOT NULL GROUP BY slice", _SCORED),
    "false_positives": over_events(f"SELECT trans_num, {_SHOWN} FROM kinds WHERE slice = 'FP' ORDER BY score DESC, trans_num LIMIT 10", _SCORED),
    "false_negatives": over_events(f"SELECT trans_num, {_SHOWN} FROM kinds WHERE slice = 'FN' ORDER BY score DESC, trans_num LIMIT 10", _SCORED),
    "error_means": over_events(
        " UNION ALL ".join(_compared(c) for c in evaluate.COMPARED_COLUMNS),
        f"{WIDE_SQL}, {_SCORED.replace('FROM txn', 'FROM wide').replace('kinds AS (', 'kinds AS MATERIALIZED (')}",
    ),
    "score_dependence": over_events(
        "SELECT CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(x), 6) AS feature_mean, "
        "round(avg(fraud_score), 6) AS score_mean FROM (SELECT fraud_score, IPRiskScore AS x, min(IPRiskScore) OVER () AS lo, "
        "max(IPRiskScore) OVER () AS hi FROM txn) GROUP BY 1"
    ),
    "top_categories_by_risk": over_events(
        "SELECT MerchantCategory, round(avg(RiskSignalWeightedScore), 6) AS risk FROM wide WHERE MerchantCategory IS NOT NULL "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
        WIDE_SQL,
    ),
}

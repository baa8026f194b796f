"""Twelve hand-made transactions on three cards, plus edge rows, and plain-Python expectations."""

from __future__ import annotations

import math

# (trans_num, cc_num, unix_time, amt, merchant, category, hour, merch_lat, merch_long, is_fraud)
ROWS = [
    (1, 10, 1_570_000_000, 40.0, "a", "food", 9, 48.15, 11.58, 0),
    (2, 10, 1_570_004_000, 60.0, "b", "food", 10, 48.20, 11.60, 0),
    (3, 10, 1_570_090_000, 55.0, "a", "fuel", 11, 48.10, 11.50, 0),
    (4, 10, 1_574_500_000, 700.0, "c", "trip", 23, 52.52, 13.40, 1),
    (5, 20, 1_570_000_000, 20.0, "d", "food", 8, 45.46, 9.19, 0),
    (6, 20, 1_570_000_300, 22.0, "d", "food", 8, 45.47, 9.20, 0),
    (7, 20, 1_570_000_600, 21.0, "e", "fuel", 8, 45.45, 9.18, 0),
    (8, 20, 1_570_000_900, 450.0, "f", "trip", 8, 41.90, 12.50, 1),
    (9, 30, 1_570_000_000, 80.0, "a", "food", 12, 47.37, 8.54, 0),
    (10, 30, 1_571_500_000, 85.0, "g", "food", 13, 47.38, 8.55, 0),
    (11, 30, 1_575_000_000, 75.0, "g", "fuel", 14, 47.36, 8.53, 0),
    (12, 30, 1_577_900_000, 990.0, "h", "trip", 3, 40.41, -3.70, 1),
    # edges: single-row card, two rows of one second, unknown merchant, category and label
    (13, 40, 1_570_000_000, 10.0, None, None, 0, None, None, None),
    (14, 50, 1_570_000_000, 10.0, "a", "food", 5, 48.0, 11.0, 0),
    (15, 50, 1_570_000_000, 30.0, "b", None, 6, 48.0, 11.0, 1),
    (16, 50, 1_570_000_050, 50.0, "b", "food", 7, 48.0, 11.0, 0),
]
HOME = {10: (48.14, 11.57), 20: (45.46, 9.19), 30: (47.37, 8.54), 40: (0.0, 0.0), 50: (48.0, 11.0)}
SCHEMA = (
    "trans_num long, cc_num long, unix_time long, amt double, merchant string, MerchantCategory string, TransactionHour int, "
    "merch_lat double, merch_long double, is_fraud int, cust_lat double, cust_long double"
)


def frame(spark):
    return spark.createDataFrame([r + HOME[r[1]] for r in ROWS], SCHEMA)


def cards():
    out = {}
    for r in sorted(ROWS, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def km(a, b, c, d):
    if None in (a, b, c, d):
        return None
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(max(h, 0), 1)))


def mean(v):
    return sum(v) / len(v)


def pop_sd(v):
    return math.sqrt(mean([(x - mean(v)) ** 2 for x in v]))


def sample_sd(v):
    return math.sqrt(sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None


def entropy(gaps):
    if len(gaps) < 2:
        return 0.0
    k, lo, hi = min(20, len(gaps)), min(gaps), max(gaps)
    counts = [0] * k
    for g in gaps:
        counts[0 if hi == lo else min(int((g - lo) / (hi - lo) * k), k - 1)] += 1
    return -sum(c / len(gaps) * math.log2(c / len(gaps)) for c in counts if c)


def average_precision(scores, labels):
    """Step-wise area, ties entering together."""
    total, ap, tp, n = sum(labels), 0.0, 0, 0
    for s in sorted(set(scores), reverse=True):
        group = [y for x, y in zip(scores, labels, strict=True) if x == s]
        tp, n = tp + sum(group), n + len(group)
        ap += sum(group) / total * tp / n
    return ap


def roc_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels, strict=True) if y == 1]
    neg = [s for s, y in zip(scores, labels, strict=True) if y == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))

"""Registered queries and their SQL equivalents."""

from txnrisk.queries import features, files, models, quality, rules, streams

_MODULES = [features, rules, quality, models, streams, files]


def queries():
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

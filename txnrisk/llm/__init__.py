"""Operators for building training corpora, with their queries and SQL equivalents."""

from importlib import import_module

#: Modules that register a query; each has QUERIES and ORACLE.
_MODULES = ["mixing", "urlfilter", "warc", "linededup", "ann", "langid", "decontaminate", "pii", "nearduplicates", "tokenstore", "fillmiddle", "conversations", "partenum"]


def _loaded():
    return [import_module(f"{__name__}.{m}") for m in _MODULES]


def queries():
    return {name: fn for m in _loaded() for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _loaded() for name, sql in m.ORACLE.items()}

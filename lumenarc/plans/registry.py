"""All registered queries of the core library and the SQL each of them equals."""

from __future__ import annotations

from importlib import import_module

MODULES = ("search_queries", "corpus_queries", "text_queries", "record_queries", "graph_queries", "stream_queries", "view_queries")


def _all():
    out = {}
    for m in MODULES:
        out |= import_module(f"lumenarc.plans.{m}").QUERIES
    return out


def queries():
    return {k: v[0] for k, v in _all().items()}


def oracle_sql():
    return {k: v[1] for k, v in _all().items() if v[1]}

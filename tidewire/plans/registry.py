"""The engine's registered queries and their reference SQL."""

from __future__ import annotations

from tidewire.plans import activation, articles, identity, incidents, pages, recovery, repair, routing, stories, surface

_ALL = {**pages.QUERIES, **articles.QUERIES, **stories.QUERIES, **identity.QUERIES, **surface.QUERIES, **routing.QUERIES, **incidents.QUERIES, **recovery.QUERIES, **activation.QUERIES, **repair.QUERIES}


def flagship(spark, sf_dir):
    return pages.page_quality_by_domain(spark, sf_dir)


def queries():
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

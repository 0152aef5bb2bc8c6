"""Registered queries with their SQL counterparts."""

from pairloom.queries import (
    aggregates,
    joins,
    models,
    projections,
    ordering,
    scans,
    stacking,
    streams,
    texts,
    vectors,
)

GROUPS = (scans, projections, joins, aggregates, ordering, texts, vectors, stacking, models, streams)


def all_queries():
    return {name: build for group in GROUPS for name, build in group.QUERIES.items()}


def all_sql():
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}

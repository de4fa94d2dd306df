"""Filters of change feeds and positions in result sets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.find import find
from docloom.operators.predicates import literal, predicate, resolve
from docloom.plans.query import Leaf, Logical, QuerySpec, parse_query

INLINE_BYTES = 1024


def filtered_events(events: DataFrame, query: dict | QuerySpec) -> DataFrame:
    """Events whose document matches the query's filters; events without one always pass. Works on streams too."""
    spec = query if isinstance(query, QuerySpec) else parse_query(query)
    if not spec.filters:
        return events
    p = predicate(_within(spec.filters, "doc"), events.schema)
    if isinstance(p, bool):
        return events if p else events.where(F.col("doc").isNull())
    return events.where(p | F.col("doc").isNull())


def _within(filters: tuple, field: str) -> tuple:
    """The filters with all paths inside a field."""
    return tuple(Leaf(f.op, f"{field}.{f.path}", f.value) if isinstance(f, Leaf) else Logical(f.op, tuple(_within(g, field) for g in f.groups)) for f in filters)


def resumed(df: DataFrame, query: dict | QuerySpec, id_col: str, last_id: Any, key: str | None = None, last_key: Any = None) -> DataFrame:
    """Matches after a position: past last_id in id order, or past (last_key, last_id) in the order of an indexed path."""
    rows = find(df, query)
    i = F.col(f"`{id_col}`") > F.lit(last_id)
    if key is None:
        return rows.where(i)
    c, t = resolve(df.schema, key)
    k = literal(last_key, t)
    return rows.where((c > k) | ((c == k) & i))

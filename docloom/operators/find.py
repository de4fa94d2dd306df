"""Running a query document over a typed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import UnsupportedCursorQuery
from docloom.operators.predicates import predicate, resolve
from docloom.plans.query import QuerySpec, parse_query

_INT_MAX = (1 << 31) - 1


def _order(spec: QuerySpec, schema: T.StructType, tie: tuple[str, ...]) -> list:
    ties = [F.col(f"`{t}`").asc_nulls_last() for t in tie]
    if spec.sort is None:
        return ties
    found = resolve(schema, spec.sort.path)
    if found is None or isinstance(found[1], (T.StructType, T.ArrayType)):
        # all rows are missing or level: only presence counts
        return [F.asc(found[0].isNull()), *ties] if found else ties
    c = found[0]
    if isinstance(found[1], T.BinaryType):
        size = F.octet_length(c)
        return [size.asc_nulls_last(), c.asc_nulls_last(), *ties] if spec.sort.ascending else [size.desc_nulls_last(), c.desc_nulls_last(), *ties]
    return [c.asc_nulls_last() if spec.sort.ascending else c.desc_nulls_last(), *ties]


def sliced(df: DataFrame, offset: int | None, limit: int | None) -> DataFrame:
    if offset:
        df = df.offset(min(offset, _INT_MAX))
    return df if limit is None else df.limit(min(limit, _INT_MAX))


def find(df: DataFrame, query: dict | QuerySpec, tie: tuple[str, ...] = (), hidden: tuple[str, ...] = ()) -> DataFrame:
    """Filter, sort, slice and project.

    tie: columns of the rows' own order; they end a sort's ties and order a slice without
    a sort. Without them such rows come in any order. hidden: columns that the result leaves out.
    """
    spec = query if isinstance(query, QuerySpec) else parse_query(query)
    if spec.cursor is not None:
        raise UnsupportedCursorQuery("cursors need a bucket")
    schema = df.schema
    p = predicate(spec.filters, schema)
    out = df if p is True else df.where(F.lit(False) if p is False else p)
    if spec.sort is not None or spec.has_sector:
        order = _order(spec, schema, tie)
        if order:
            out = out.orderBy(*order)
        out = sliced(out, spec.offset, spec.limit)
    names = [n for n in schema.names if n not in hidden]
    if spec.projection is not None:
        names = spec.projection.columns(names)
    return out if names == schema.names else out.select(*[F.col(f"`{n}`") for n in names])

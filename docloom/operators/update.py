"""Applying update programs to the matching rows of a typed table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import errors as E
from docloom.functions.expressions import compile_expression
from docloom.operators.predicates import predicate
from docloom.plans.query import QuerySpec, parse_query
from docloom.plans.update import Assign, Stage, parse_program


def now_utc() -> dt.datetime:
    """The present, to the millisecond."""
    n = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return n.replace(microsecond=n.microsecond // 1000 * 1000)


def _fit(value: Column, of: T.DataType, to: T.DataType) -> Column:
    """A value as the type of the field it goes to; numbers that don't fit stop the update (ANSI cast)."""
    if isinstance(of, T.NullType):
        return F.lit(None).cast(to)
    if of == to:
        return value
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    times = (T.TimestampType, T.TimestampNTZType)
    if (isinstance(of, numbers) and isinstance(to, numbers)) or (isinstance(of, times) and isinstance(to, times)):
        return value.cast(to)
    if isinstance(of, T.StructType) and isinstance(to, T.StructType) and set(of.names) <= set(to.names):
        return F.struct(*[(_fit(value.getField(f.name), of[f.name].dataType, f.dataType) if f.name in of.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields])
    if isinstance(of, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(value, lambda x: _fit(x, of.elementType, to.elementType))
    raise E.UnsupportedType(f"{of.simpleString()} can't be stored as {to.simpleString()}")


def _assigned(old: Column | None, of: T.DataType | None, parts: list[str], value: Column, value_type: T.DataType) -> tuple[Column, T.DataType]:
    """A field after an assignment at a path inside it, and its type."""
    if not parts:
        if of is None or isinstance(of, T.NullType):
            t = T.StringType() if isinstance(value_type, T.NullType) else value_type
            return value.cast(t), t
        return _fit(value, value_type, of), of
    head, rest = parts[0], parts[1:]
    if of is None or isinstance(of, T.NullType):
        if head.isdecimal():
            raise E.UnsupportedType("a new array field by index; use a bucket of documents")
        inner, t = _assigned(None, None, rest, value, value_type)
        return F.struct(inner.alias(head)), T.StructType([T.StructField(head, t)])
    if isinstance(of, T.StructType):
        present = head in of.names
        inner, t = _assigned(old.getField(head) if present else None, of[head].dataType if present else None, rest, value, value_type)
        fields, names = [], []
        for f in of.fields:
            fields.append(inner.alias(head) if f.name == head else F.when(old.isNotNull(), old.getField(f.name)).alias(f.name))
            names.append(T.StructField(head, t) if f.name == head else f)
        if not present:
            fields.append(inner.alias(head))
            names.append(T.StructField(head, t))
        return F.struct(*fields), T.StructType(names)
    if isinstance(of, T.ArrayType) and head.isdecimal():
        i = int(head)
        inner, _ = _assigned(F.get(old, F.lit(i)), of.elementType, rest, value, value_type)
        size = F.coalesce(F.size(old), F.lit(0))
        long = F.concat(F.coalesce(old, F.array().cast(of)), F.array_repeat(F.lit(None).cast(of.elementType), F.greatest(F.lit(0), F.lit(i + 1) - size)))
        return F.transform(long, lambda x, k: F.when(k == i, inner).otherwise(x)), of
    raise E.UnsupportedType(f"{head} inside {of.simpleString()}")


def _removed(old: Column, of: T.DataType, parts: list[str]) -> Column:
    """A field after the removal of a path inside it: NULL, which is missing; array elements close up."""
    if not parts:
        return F.lit(None).cast(of)
    head, rest = parts[0], parts[1:]
    if isinstance(of, T.StructType) and head in of.names:
        fields = [(_removed(old.getField(f.name), f.dataType, rest) if f.name == head else old.getField(f.name)).alias(f.name) for f in of.fields]
        return F.when(old.isNotNull(), F.struct(*fields))
    if isinstance(of, T.ArrayType) and head.isdecimal():
        i = int(head)
        if rest:
            return F.transform(old, lambda x, k: F.when(k == i, _removed(x, of.elementType, rest)).otherwise(x))
        return F.filter(old, lambda _, k: k != i)
    return old


def apply_stage(df: DataFrame, stage: Stage, match: Column | bool, now: dt.datetime, id_col: str = "_id") -> DataFrame:
    """One stage as one select: every expression reads the stage's input."""
    schema = df.schema
    state: dict[str, tuple[Column | None, T.DataType | None]] = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}
    touched: list[str] = []
    for step in stage:
        top, *parts = step.path.split(".")
        old, of = state.get(top, (None, None))
        if isinstance(step, Assign):
            value, t = compile_expression(step.value, schema, now)
            state[top] = _assigned(old, of, parts, value, t)
        elif old is not None and not (top == id_col and not parts):
            state[top] = _removed(old, of, parts), of
        else:
            continue
        touched.append(top)
    out = {}
    for name in dict.fromkeys(touched):
        new, t = state[name]
        was = F.col(f"`{name}`") if name in schema.names else F.lit(None)
        if name in schema.names and schema[name].dataType != t:
            was = _fit(was, schema[name].dataType, t)
        out[name] = new if match is True else F.when(match, new).otherwise(was.cast(t))
    return df.withColumns(out) if out else df


def update(df: DataFrame, query: dict | QuerySpec, program: object, now: dt.datetime | None = None, id_col: str = "_id") -> DataFrame:
    """All rows of df, matching ones after the program; fields new to the schema are added.

    Sort, sector and projection of the query play no part here. An expression that fails on any
    matching row fails the whole job.
    """
    spec = query if isinstance(query, QuerySpec) else parse_query(query)
    stages = parse_program(program)
    p = predicate(spec.filters, df.schema)
    now = now or now_utc()
    match = p if p is True else F.lit(False) if p is False else F.coalesce(p, F.lit(False))
    if p is True or len(stages) == 1:
        for stage in stages:
            df = apply_stage(df, stage, match, now, id_col)
        return df
    # later stages must go by the match of the rows as they were
    marked = df.withColumn("__match", match)
    for stage in stages:
        marked = apply_stage(marked, stage, F.col("__match"), now, id_col)
    return marked.drop("__match")


def delete(df: DataFrame, query: dict | QuerySpec) -> DataFrame:
    """The rows that don't match; only the query's filters count."""
    spec = query if isinstance(query, QuerySpec) else parse_query(query)
    p = predicate(spec.filters, df.schema)
    if isinstance(p, bool):
        return df.where(F.lit(not p))
    return df.where(~F.coalesce(p, F.lit(False)))

"""Update expressions as Columns over a typed table."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import errors as E
from docloom.functions.values import kind
from docloom.operators.predicates import column_kind, literal, resolve
from docloom.plans.update import Call, Literal, Make, Now, Ref

_ISO = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_TYPES = {"int32": T.IntegerType(), "int64": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "datetime": T.TimestampType(), "binary": T.BinaryType(), "objectId": T.BinaryType(), "null": T.NullType()}

Typed = tuple[Column, T.DataType]


def _failure(name: str, of: Column | str = "") -> Column:
    return F.raise_error(F.concat(F.lit(f"{name}: "), F.coalesce(of if isinstance(of, Column) else F.lit(of), F.lit("null"))))


def _constant(value: Any) -> Typed:
    t = _TYPES[kind(value)]
    return (F.lit(None) if value is None else literal(value, t).cast(t)), t


def _iso(c: Column) -> Column:
    """The timestamp of an ISO text; a text of another form or before 1970 stops the update."""
    upper = F.upper(c)
    # the fraction is cut to milliseconds by text, before any rounding
    text = F.regexp_replace(F.regexp_replace(upper, r"(\.\d{3})\d+", "$1"), "Z$", "+00:00")
    offset = F.regexp_extract(text, r"[+-](\d{2}):(\d{2})$", 1).cast("int") * 60 + F.regexp_extract(text, r"[+-](\d{2}):(\d{2})$", 2).cast("int")
    minutes_ok = F.regexp_extract(text, r"[+-](\d{2}):(\d{2})$", 2).cast("int") < 60
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    local = F.try_to_timestamp(F.concat(F.regexp_replace(text, r"[+-]\d{2}:\d{2}$", ""), F.lit("+00:00")))
    moment = F.timestamp_millis(F.unix_millis(local) - sign * offset * 60_000)
    good = c.rlike(_ISO) & local.isNotNull() & (offset < 24 * 60) & minutes_ok & (F.unix_millis(moment) >= 0)
    return F.when(c.isNull(), _failure("InvalidExpressionArgument", "$isoDateTime")).when(F.coalesce(good, F.lit(False)), moment).otherwise(_failure("InvalidDateTime", c))


def compile_expression(e: Any, schema: T.StructType, now: dt.datetime) -> Typed:
    """The column and type of an expression. A missing field is NULL; what a call can't take stops the update."""
    if isinstance(e, Literal):
        return _constant(e.value)
    if isinstance(e, Now):
        return _constant(now)
    if isinstance(e, Ref):
        return resolve(schema, e.path) or (F.lit(None), T.NullType())
    if isinstance(e, Make):
        items = [compile_expression(x, schema, now) for x in e.items]
        if e.names is None:
            kinds = {t.simpleString() for _, t in items} - {"void"}
            if len(kinds) > 1:
                raise E.UnsupportedType("an array of several types; use a bucket of documents")
            inner = next((t for _, t in items if not isinstance(t, T.NullType)), T.StringType())
            return F.array(*[c.cast(inner) for c, _ in items]).cast(T.ArrayType(inner)), T.ArrayType(inner)
        fields = [T.StructField(n, t if not isinstance(t, T.NullType) else T.StringType()) for n, (_, t) in zip(e.names, items, strict=True)]
        return F.struct(*[c.cast(f.dataType).alias(f.name) for f, (c, _) in zip(fields, items, strict=True)]), T.StructType(fields)
    assert isinstance(e, Call)
    args = [compile_expression(x, schema, now) for x in e.args]
    if any(isinstance(t, T.NullType) for _, t in args):
        raise E.InvalidExpressionArgument(f"{e.op} of a null")
    kinds = [column_kind(t) for _, t in args]
    if e.op == "$concat":
        if set(kinds) != {"string"}:
            raise E.InvalidExpressionArgument(e.op)
        return F.coalesce(F.concat(*[c for c, _ in args]), _failure("InvalidExpressionArgument", e.op)), T.StringType()
    if e.op == "$isoDateTime":
        c, t = args[0]
        if kinds[0] == "datetime":
            return F.coalesce(c, _failure("InvalidExpressionArgument", e.op).cast(t)), t
        if kinds[0] != "string":
            raise E.InvalidExpressionArgument(e.op)
        return _iso(c), T.TimestampType()
    if not set(kinds) <= {"int32", "int64", "double"}:
        raise E.InvalidExpressionArgument(e.op)
    # as in a left fold, a double makes all that follows double; whole numbers before it stay exact
    total, of = args[0][0].cast("double" if kinds[0] == "double" else "long"), kinds[0]
    for (c, _), k in zip(args[1:], kinds[1:], strict=True):
        if "double" in (of, k):
            total, c, of = total.cast("double"), c.cast("double"), "double"
        else:
            c, of = c.cast("long"), "int64"
        total = total + c if e.op == "$plus" else total - c
    t = T.DoubleType() if of == "double" else T.LongType()
    return F.coalesce(total, _failure("InvalidExpressionArgument", e.op).cast(t)), t

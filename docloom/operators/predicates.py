"""Filters of a query as a Column over a typed table.

In a typed table SQL NULL means that the field is missing; an explicit null can't be stored.
Which kind wins a comparison across kinds is known from the column's type and the literal, so every
leaf becomes a plain comparison, a null check or a constant, and the data source sees it.

Negation ($nor) is pushed to the leaves: the opposite of a leaf p is `path is null or not p`,
which keeps rows with missing fields and still reaches the Parquet reader.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import UnsupportedType
from docloom.functions.values import RANKS, Double, Int32, Int64, ObjectId, kind, milliseconds
from docloom.plans.query import Filter, Leaf

_NUMBERS = {T.ByteType: "int32", T.ShortType: "int32", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "double", T.DoubleType: "double"}
_OTHERS = {T.StringType: "string", T.StructType: "document", T.ArrayType: "array", T.BinaryType: "binary", T.BooleanType: "boolean", T.TimestampType: "datetime", T.TimestampNTZType: "datetime"}
_INT32 = (-(1 << 31), (1 << 31) - 1)
Test = Column | bool


def column_kind(data_type: T.DataType, path: str = "") -> str:
    for table in (_NUMBERS, _OTHERS):
        for cls, name in table.items():
            if isinstance(data_type, cls):
                return name
    raise UnsupportedType(f"{path}: {data_type.simpleString()}; cast it first")


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column and type at a dotted path; None where the schema has no such path. Numbers index arrays."""
    column: Column | None = None
    at: T.DataType = schema
    for part in path.split("."):
        if isinstance(at, T.StructType):
            if part not in at.names:
                return None
            at = at[part].dataType
            column = F.col(f"`{part}`") if column is None else column.getField(part)
        elif isinstance(at, T.ArrayType) and part.isdecimal() and int(part) <= _INT32[1]:
            at, column = at.elementType, F.get(column, F.lit(int(part)))
        else:
            return None
    return column, at


def literal(value: Any, data_type: T.DataType) -> Column:
    """A literal as the given type, where it is of the same class."""
    if isinstance(value, ObjectId):
        return F.lit(bytearray(value.raw))
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytearray(value))
    if isinstance(value, dt.datetime):
        moment = F.timestamp_millis(F.lit(milliseconds(value)))
        if isinstance(data_type, T.TimestampNTZType):
            return F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=milliseconds(value))).cast("timestamp_ntz")
        return moment
    return F.lit(float(value)) if isinstance(value, float) else F.lit(int(value)) if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)


def _exact(value: Any, column: str) -> Any:
    """A literal as the column's own kind, or None where equality can't hold: bare numbers adapt if nothing is lost, wrapped ones don't."""
    k = kind(value)
    if k == column or (k == "objectId" and column == "binary"):
        return value
    if RANKS[k] != 2 or RANKS.get(column) != 2 or isinstance(value, (Int32, Int64, Double)):
        return None
    if column == "double":
        return Double(value) if int(float(value)) == value else None
    if isinstance(value, float) and not value.is_integer():
        return None
    low, high = _INT32 if column == "int32" else (-(1 << 63), (1 << 63) - 1)
    return int(value) if low <= value <= high else None


def _rank(value: Any, column: str) -> int:
    """Rank of a literal; twelve bytes written as ObjectId rank as the binary column they're compared with."""
    return RANKS["binary"] if isinstance(value, ObjectId) and column == "binary" else RANKS[kind(value)]


def _all(tests: list[Test]) -> Test:
    rest = [t for t in tests if t is not True]
    return False if any(t is False for t in rest) else reduce(and_, rest) if rest else True


def _any(tests: list[Test]) -> Test:
    rest = [t for t in tests if t is not False]
    return True if any(t is True for t in rest) else reduce(or_, rest) if rest else False


def _ordered(op: str, c: Column, data_type: T.DataType, k: str, value: Any) -> Test:
    if isinstance(value, ObjectId) and k == "string":
        value = str(value)
    here, there = RANKS[k], _rank(value, k)
    if here != there:
        return c.isNotNull() if (here > there) == op.startswith("$g") else False
    if k in ("document", "array"):
        return c.isNotNull() if op.endswith("e") else False
    v = literal(value, data_type)
    if k == "binary":
        size, most = F.octet_length(c), F.octet_length(v)
        first = size < most if op.startswith("$l") else size > most
        same = {"$lt": c < v, "$lte": c <= v, "$gt": c > v, "$gte": c >= v}[op]
        return first | ((size == most) & same)
    return {"$lt": c < v, "$lte": c <= v, "$gt": c > v, "$gte": c >= v}[op]


def _equals(c: Column, data_type: T.DataType, k: str, values: list[Any]) -> Test:
    """Whether the column equals any of the values; NULL or false otherwise."""
    if k == "document":
        return False
    if k == "array":
        inner = column_kind(data_type.elementType)
        whole = [v for v in values if kind(v) == "array"]
        single = [x for v in values if kind(v) not in ("array", "document", "null") for x in [_exact(str(v) if isinstance(v, ObjectId) and inner == "string" else v, inner)] if x is not None]
        if inner in ("document", "array"):
            single = []
        tests = []
        if len(single) == 1:
            tests.append(F.array_contains(c, literal(single[0], data_type.elementType)))
        elif single:
            tests.append(F.arrays_overlap(c, F.array(*[literal(v, data_type.elementType) for v in single])))
        for v in whole:
            items = [_exact(x, inner) for x in v]
            if all(x is not None for x in items) and inner not in ("document", "array"):
                tests.append(c == F.array(*[literal(x, data_type.elementType) for x in items]).cast(data_type))
        return _any(tests)
    exact = [x for v in values for x in [_exact(str(v) if isinstance(v, ObjectId) and k == "string" else v, k)] if x is not None]
    if not exact:
        return False
    items = [literal(x, data_type) for x in exact]
    return c == items[0] if len(items) == 1 else c.isin(*items)


def leaf_column(leaf: Leaf, schema: T.StructType) -> tuple[Test, Column | None]:
    """The leaf as a Column (true, or false or NULL), and the column it reads (None for constants)."""
    found = resolve(schema, leaf.path)
    if found is None:
        return (True if leaf.op == "$notExists" else False), None
    c, data_type = found
    if leaf.op == "$exists":
        return c.isNotNull(), c
    if leaf.op == "$notExists":
        return c.isNull(), c
    k = column_kind(data_type, leaf.path)
    value = leaf.value
    if leaf.op in ("$startsWith", "$endsWith"):
        return ((c.startswith(value) if leaf.op == "$startsWith" else c.endswith(value)) if k == "string" else False), c
    if leaf.op == "$between":
        return _all([_ordered("$gt", c, data_type, k, value[0]), _ordered("$lt", c, data_type, k, value[1])]), c
    if leaf.op in ("$lt", "$lte", "$gt", "$gte"):
        return _ordered(leaf.op, c, data_type, k, value), c
    if leaf.op == "$in":
        return _equals(c, data_type, k, list(value)), c
    same = _equals(c, data_type, k, [value])
    if leaf.op == "$eq":
        return same, c
    if isinstance(same, bool):
        return c.isNotNull(), c
    if k == "array":
        return c.isNotNull() & ~F.coalesce(same, F.lit(False)), c
    return c != literal(_exact(str(value) if isinstance(value, ObjectId) and k == "string" else value, k), data_type), c


def _compile(filters: tuple[Filter, ...], schema: T.StructType, negated: bool) -> Test:
    parts = []
    for f in filters:
        if isinstance(f, Leaf):
            p, c = leaf_column(f, schema)
            if not negated:
                parts.append(p)
            elif isinstance(p, bool):
                parts.append(not p)
            elif f.op in ("$exists", "$notExists"):
                parts.append(c.isNull() if f.op == "$exists" else c.isNotNull())
            elif isinstance(resolve(schema, f.path)[1], T.ArrayType):
                parts.append(~F.coalesce(p, F.lit(False)))
            else:
                parts.append(c.isNull() | ~p)
            continue
        inside = [_compile(g, schema, negated != (f.op == "$nor")) for g in f.groups]
        conjunction = (f.op == "$and") != negated if f.op != "$nor" else not negated
        parts.append(_all(inside) if conjunction else _any(inside))
    return _any(parts) if negated else _all(parts)


def predicate(filters: tuple[Filter, ...], schema: T.StructType) -> Test:
    """All filters as one Column for DataFrame.where (false or NULL: no match), or True or False where they don't depend on the rows."""
    return _compile(filters, schema, False)

"""Queries and updates over documents without a common schema: a BINARY column of BSON.

Meaning comes from the document evaluator, in Arrow batches; order is a struct that
Catalyst compares, so sorting, slicing and shuffling stay with Spark.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.bson import decode, encode
from docloom.functions.values import MISSING, RANKS, ObjectId, at_path, kind, milliseconds
from docloom.operators.find import sliced
from docloom.plans.evaluate import apply_stages, matches, project
from docloom.plans.query import Filter, QuerySpec, parse_query
from docloom.plans.update import Stage

ORDER_KEY = "struct<rank:int,num:double,i64:bigint,len:int,sub:int,bin:binary>"


def order_key(value: object) -> dict | None:
    """A struct that sorts as the value does; None for a missing one. Containers of a kind are level."""
    if value is MISSING:
        return None
    k = kind(value)
    out: dict = {"rank": RANKS[k], **dict.fromkeys(("num", "i64", "len", "sub", "bin"))}
    if k in ("int32", "int64", "boolean", "datetime"):
        n = milliseconds(value) if k == "datetime" else int(value)
        out["num"], out["i64"] = float(n), n
    elif k == "double":
        out["num"] = float(value)
        if math.isfinite(value) and abs(value) < 1 << 63:
            out["i64"] = math.floor(value)
    elif k == "string":
        out["bin"] = value.encode()
    elif k == "binary":
        out["len"], out["sub"], out["bin"] = len(value), getattr(value, "subtype", 0), bytes(value)
    elif k == "objectId":
        out["bin"] = value.raw
    return out


def _batched(f: Callable, returns: str) -> Callable:
    @F.pandas_udf(returns)
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: f(decode(d)), na_action="ignore")

    return run


def match_column(filters: tuple[Filter, ...], doc: str = "doc") -> Column:
    return _batched(lambda d: matches(filters, d), "boolean")(F.col(doc))


def key_column(path: str, doc: str = "doc") -> Column:
    @F.pandas_udf(ORDER_KEY)
    def run(docs: pd.Series) -> pd.DataFrame:
        keys = [order_key(at_path(decode(d), path)) or {} for d in docs]
        return pd.DataFrame({c: pd.Series([k.get(c) for k in keys], dtype=t) for c, t in (("rank", "Int32"), ("num", "Float64"), ("i64", "Int64"), ("len", "Int32"), ("sub", "Int32"), ("bin", "object"))})

    return run(F.col(doc))


def entry_keys(df: DataFrame, path: str, sparse: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep): an order key for the value at a path, or for each distinct scalar of an array; missing is null unless sparse."""

    def of(document: dict) -> list[dict]:
        value = at_path(document, path)
        if value is MISSING:
            return [] if sparse else [order_key(None)]
        items = [x for x in value if kind(x) not in ("array", "document")] if kind(value) == "array" else [value]
        return list({repr(k): k for k in map(order_key, items)}.values())

    keys = _batched(of, f"array<{ORDER_KEY}>")(F.col("doc"))
    return df.select(F.explode(keys).alias("key"), *keep)


def _found(filters: tuple[Filter, ...], f: Callable[[dict], object], returns: str) -> Callable:
    """A struct of whether a document matches and, if so, what f makes of it. One step for both: every step on its own is one more Python process a core."""

    @F.pandas_udf(f"hit boolean, doc {returns}")
    def run(docs: pd.Series) -> pd.DataFrame:
        hits, made = [], []
        for d in docs:
            document = None if d is None else decode(d)
            hits.append(document is not None and matches(filters, document))
            made.append(f(document) if hits[-1] else None)
        return pd.DataFrame({"hit": pd.Series(hits, dtype="bool"), "doc": pd.Series(made, dtype="object")})

    return run.asNondeterministic()  # else Spark may run it once for the filter and again for the result


def find_documents(df: DataFrame, query: dict | QuerySpec, tie: str = "_seq", read: Callable[[dict], object] | None = None, returns: str = "binary") -> DataFrame:
    """Filter, sort, slice and project rows (doc, …, tie) of BSON documents; `doc` becomes what read() makes of each, of type `returns`, if given."""
    spec = query if isinstance(query, QuerySpec) else parse_query(query)

    def made(document: dict) -> object:
        document = project(spec.projection, document)
        return encode(document) if read is None else read(document)

    changes = spec.projection is not None or read is not None
    if changes and spec.filters and spec.sort is None and not spec.has_sector:
        found = df.withColumn("__found", _found(spec.filters, made, returns)(F.col("doc"))).where("__found.hit")
        return found.withColumn("doc", F.col("__found.doc")).drop("__found")
    out = df.where(match_column(spec.filters)) if spec.filters else df
    if spec.sort is not None or spec.has_sector:
        names = out.columns
        order = [F.col(tie)]
        if spec.sort is not None:
            out = out.withColumn("__key", key_column(spec.sort.path))
            missing = F.col("__key.rank").isNull()
            by = [missing.asc(), F.col("__key").asc() if spec.sort.ascending else F.col("__key").desc()]
            order = [*by, *order]
        out = sliced(out.orderBy(*order), spec.offset, spec.limit).select(*names)
    if changes:
        out = out.withColumn("doc", _batched(made, returns)(F.col("doc")))
    return out


def _identified(f: Callable[[dict], dict]) -> Callable:
    """A struct of the document that f returns and its _id as BSON of its own. One step makes both: every step on its own is one more Python process a core."""

    @F.pandas_udf("doc binary, _id binary")
    def run(docs: pd.Series) -> pd.DataFrame:
        made = [None if d is None else f(decode(d)) for d in docs]
        return pd.DataFrame({"doc": pd.Series([None if m is None else encode(m) for m in made], dtype="object"), "_id": pd.Series([None if m is None else encode({"_id": m.get("_id")}) for m in made], dtype="object")})

    return run


def updated_documents(df: DataFrame, stages: tuple[Stage, ...], now: dt.datetime) -> DataFrame:
    """Rows (doc, _id, …) with the documents put through the stages, and the _id of what comes out."""
    made = _identified(lambda d: apply_stages(stages, d, now))(F.col("doc"))
    return df.withColumn("__made", made).withColumns({"doc": F.col("__made.doc"), "_id": F.col("__made._id")}).drop("__made")


def with_ids(df: DataFrame) -> DataFrame:
    """(doc, _id): documents checked as BSON, with an _id made for those without; a broken one stops the job."""
    made = _identified(lambda d: d if "_id" in d else {**d, "_id": ObjectId()})
    return df.select(made.asNondeterministic()(F.col("doc")).alias("__made")).select("__made.doc", "__made._id")  # else Spark may run it once for every use

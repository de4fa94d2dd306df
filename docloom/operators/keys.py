"""Index keys: the entries of a path, and keys that a unique index forbids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import UnsupportedType
from docloom.operators.predicates import resolve

MAX_KEY_BYTES = 256


def multikey_entries(df: DataFrame, path: str, sparse: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep): an entry for a row's value, or for each distinct element of an array.

    Rows without the field have a NULL entry, none in a sparse index. Containers within arrays aren't indexed.
    """
    found = resolve(df.schema, path)
    if found is None:
        return df.select(F.lit(None).cast("string").alias("key"), *keep) if not sparse else df.where(F.lit(False)).select(F.lit(None).cast("string").alias("key"), *keep)
    c, t = found
    if isinstance(t, T.StructType):
        raise UnsupportedType(f"{path} is a document")
    if isinstance(t, T.ArrayType):
        rows = df.select(F.explode_outer(F.array_distinct(c)).alias("key"), *keep) if not sparse else df.select(F.explode(F.array_distinct(c)).alias("key"), *keep)
        return rows
    rows = df.select(c.alias("key"), *keep)
    return rows.where("key is not null") if sparse else rows


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the columns that more than one row has, with their count n."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def first_duplicate(df: DataFrame, path: str, sparse: bool, new: DataFrame | None = None) -> tuple | None:
    """A key that two rows of df (or of df and new together) have under a unique index on path, or None.

    With `new`, rows of df are only looked up by the keys of new, so nothing but keys is read and shuffled.
    NULL is a key of its own in an index that isn't sparse. An array may repeat an element.
    """
    if new is None:
        hit = multikey_entries(df, path, sparse).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").first()
        return None if hit is None else (hit["key"],)
    fresh = multikey_entries(new, path, sparse)
    hit = fresh.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").first()
    if hit is None:
        old = multikey_entries(df, path, sparse)
        hit = old.join(fresh.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left_semi").select("key").first()
    return None if hit is None else (hit["key"],)


def oversized(df: DataFrame, path: str) -> bool:
    """Whether an indexed string of df is longer than an index takes."""
    found = resolve(df.schema, path)
    if found is None:
        return False
    t = found[1].elementType if isinstance(found[1], T.ArrayType) else found[1]
    if not isinstance(t, T.StringType):
        return False
    return not multikey_entries(df, path).where(F.octet_length("key") > MAX_KEY_BYTES).isEmpty()

"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.files import Files, shared_root

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lost executors cost nothing that came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def drop(table: DataFrame) -> None:
    """Removes the folder of a staged table that no later plan reads."""
    Files(table.sparkSession, _folders.pop(table)).delete("")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name

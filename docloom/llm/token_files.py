"""Token ids in Parquet: list columns with chosen encodings, bounded row groups and page indexes.

Rows are ranged and sorted by document id, a file per range. Ids are
dictionary-encoded (a vocabulary fits a dictionary page); the ascending metadata
columns are delta-encoded. Small pages and the column index let a reader that wants a
range of documents, or metadata only, skip the pages of all others.

A document's place in the whole is its place in its file, which is stored, plus
the tokens of all files before, summed from the metadata columns on reading; so nothing is
written twice and no task ever sees more than one range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.tokenize import encoded
from docloom.llm.worker import fresh

_SCHEMA = "part int, doc_id long, place long, n_tokens int, ids array<int>"


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for first, flat, offsets in encoded(batch.column(1), vocabulary, end_id):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        keys.slice(first, n),
                        pa.array(before + offsets[:-1]),
                        pa.array(np.diff(offsets).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int32))),
                    ],
                    ["part", "doc_id", "place", "n_tokens", "ids"],
                )
                before += len(flat)

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
    part_bytes: int = 256 << 20,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2000,
) -> None:
    """Writes every document's ids, end id last, in ascending id order (null ids first, repeated ids by text).

    Null text: only the end id. Empty table: a file without rows. Other columns aren't written.
    Files are as many as shuffle partitions, or as the input has `part_bytes` if that's more, unless `parts` says so.
    """
    spark = docs.sparkSession
    if not parts:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, for a table that is read
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes) if size < 1 << 60 else 0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": 1 << 20,
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "place")},
    }
    ranged.mapInArrow(_encode(vocabulary, end_id), _SCHEMA).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, unless ids=False, the ids.

    A condition on doc_id reaches the files' statistics and page indexes; starts stay those of the whole.
    """
    rows = spark.read.schema(_SCHEMA).parquet(path)
    ends = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file: as many as `parts`, whatever the number of documents
    bases = F.broadcast(ends.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")))
    kept = rows if where is None else rows.where(where)
    return kept.join(bases, "part").select("doc_id", (F.col("_base") + F.col("place")).alias("start"), F.col("n_tokens").cast("long"), *["ids"] * ids)


def crc32_of_ids(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens with ids replaced by the CRC-32 of their little-endian unsigned 32-bit form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy().tolist()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(fresh(run), "doc_id long, start long, n_tokens long, ids_crc32 long")

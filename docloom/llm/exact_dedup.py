"""Exact duplicate removal by a tree-merge of sorted digest runs (DataFrame functions only).

Every input partition makes a run: its digests in order, rows of one digest combined into an
entry (digest, smallest id, rows). Runs are cut into ranges of the digest, so that a merge is spread over as many tasks as there
are ranges. Rounds follow a binomial tree: in each of them the run whose number ends in the round's one bit and zeros goes to the
run without that bit. `fan_in_bits` rounds are taken at a time: the 2**fan_in_bits runs that end up in
one are brought together once, put in digest order, and merged in one pass that keeps the smallest identifier of each digest and adds up rows.
After log(runs) rounds run 0 has every digest once. The verdict goes back down the same tree: entries meet
what they were merged into, and the rows of a partition meet their own run's entry. At every step a digest has at most
2**fan_in_bits entries, so a text that makes up a third of all rows never gathers in one task on either way.

Runs are ordered by a 64-bit hash; "verified" means that entries merge only where SHA-256 and byte length of the
normalised texts agree as well, at every level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.lineage import staged, unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGEST = ["_hash", "_sha", "_len"]
_ENTRY = ["_run", "_range", *_DIGEST]


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _range_bits(df: DataFrame) -> int:
    """At least eight ranges of the digest for each shuffle partition."""
    return (8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in_bits: int = 5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays. Null text: empty text. Null id: ranks behind every id, so
    it stays only in a group without ids. Rows that repeat an id within a group count in
    group_size, and one of them is kept. Empty table: empty result. Other columns don't matter.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rank = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.octet_length(text).alias("_len"))
    bits = _range_bits(docs)
    rows = staged(rows.withColumn("_range", F.shiftrightunsigned("_hash", 64 - bits).cast("int")).withColumn("_run", F.spark_partition_id()), "digests")
    last_run = rows.agg(F.max("_run")).first()[0] or 0

    def merged(entries: DataFrame, run: Column) -> DataFrame:
        """Entries brought to their next run, in digest order; of a digest's entries the first stays, with the rows of all."""
        runs = entries.withColumn("_run", run).repartition("_run", "_range").sortWithinPartitions(*_ENTRY, rank, "_from")
        group = Window.partitionBy(*_ENTRY).orderBy(rank, "_from")
        runs = runs.withColumn("_rows", F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        return runs.withColumn("_place", F.row_number().over(group)).where("_place = 1").select(*_ENTRY, "_id", "_from", F.col("_rows").alias("_n"))

    # the runs of partitions: rows of one digest are combined where they are before anything moves
    best = F.min("_id") if keep == "smallest" else F.max("_id")
    levels = [staged(rows.groupBy(*_ENTRY).agg(best.alias("_id"), F.count("*").alias("_n")).withColumn("_from", F.col("_run")), "runs")]
    while last_run >> (fan_in_bits * (len(levels) - 1)):
        done = fan_in_bits * len(levels)
        levels.append(staged(merged(levels[-1], F.shiftleft(F.shiftright("_run", done), done)), "runs"))
    verdict = levels.pop().select(*_ENTRY, F.col("_id").alias("_keep"), F.col("_from").alias("_home"), F.col("_n").alias("_size"))
    while levels:
        done = fan_in_bits * len(levels)
        below = levels.pop().select(F.col("_run").alias("_child"), F.shiftleft(F.shiftright("_run", done), done).alias("_run"), "_range", *_DIGEST)
        verdict = below.join(verdict, _ENTRY).select(F.col("_child").alias("_run"), "_range", *_DIGEST, "_keep", "_home", "_size")
    out = rows.join(verdict, _ENTRY)
    # of rows that repeat the id that stays, one in the run that gave it is kept
    same = Window.partitionBy(*_ENTRY, "_id").orderBy("_id")
    kept = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_run") == F.col("_home")) & (F.row_number().over(same) == 1)
    return out.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def without_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs that stay, with their own columns, whatever their names. Rows that share id and text stay once."""
    id_, sha, place = unused(docs, "kept_id"), unused(docs, "kept_sha"), unused(docs, "place")
    own = unused(docs, "sha")
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias(id_), F.col("text_sha256").alias(sha))
    joined = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256)).join(kept, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)))
    same = Window.partitionBy(id_, own).orderBy(id_)
    return joined.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).select(*[f"`{c}`" for c in (columns or docs.columns)])

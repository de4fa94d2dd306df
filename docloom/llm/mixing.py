"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. Each source's size is its word count; its target follows from weights and caps.
2. A source's rows are dealt to shards by a hash of id and size, about `shard_words` words
   each. Blocks of `block_words` words are the seats: the
   highest quotients target / (2 s + 1) give each source its number of blocks, and
   the same rule splits a source's blocks among its shards by their sizes, 512 at a time down a tree of shards.
3. In a shard the documents stand on a circle in seeded order. The shard's quota
   of blocks is taken as whole rounds of the circle plus one arc of consecutive
   blocks from a seeded start, so no block list is ever made.

Apportionment runs on one row per source (or per shard of a source): the divisor
of the highest-quotient rule is bisected inside an array expression, and seats
that tie at the last quotient go in order of position. Sources are listed in one row, so they may be as many as
names of sites, say 100,000, but not as many as documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.lineage import staged

WORD = r"[^\x20\x09-\x0D]+"
_WITH_BLANKS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def seats(votes: Column, n: Column) -> Column:
    """Sainte-Laguë seats (array<bigint>) for array<double> votes >= 0 and n seats in total; both are plain columns.

    Seats at divisor d are round(v / d), half up; the divisor is bisected on a
    log scale, then the seats still missing go one each to the votes whose next
    quotient is highest, ties to the earlier position. No votes: no seats.
    """


    def whole(v: Column, d: Column) -> Column:
        return F.floor(v / d + F.lit(0.5)).cast("long")

    def total(d: Column) -> Column:
        return F.aggregate(votes, F.lit(0).cast("long"), lambda a, v: a + whole(v, d))

    def halved(s: Column, _: Column) -> Column:
        return _let(
            (s["lo"] + s["hi"]) / 2,
            lambda d: F.when(total(d) > n, F.struct(d.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), d.alias("hi"))),
        )

    def filled(w: Column) -> Column:
        """Seats at the higher divisor; what ties at the lower one adds goes in order while seats are left."""
        start = F.struct((n - F.aggregate(w["s"], F.lit(0).cast("long"), lambda a, x: a + x)).alias("left"), F.array().cast("array<bigint>").alias("out"))
        pairs = F.arrays_zip(w["s"].alias("s"), w["t"].alias("t"))

        def one(a: Column, x: Column) -> Column:
            more = F.least(a["left"], x["t"] - x["s"])
            return F.struct((a["left"] - more).alias("left"), F.concat(a["out"], F.array(x["s"] + more)).alias("out"))

        return F.aggregate(pairs, start, one)["out"]

    def between(all_votes: Column) -> Column:
        # more than n seats at the low end, none at the high end
        ends = F.struct((all_votes / (n + F.size(votes) + 1) / 2).alias("lo"), (all_votes * 2 + 1).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)), ends, halved)

    def at_both(b: Column) -> Column:
        return F.struct(F.transform(votes, lambda v: whole(v, b["hi"])).alias("s"), F.transform(votes, lambda v: whole(v, b["lo"])).alias("t"))

    all_votes = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v)
    given = _let(_let(between(all_votes), at_both), filled)
    return F.when((all_votes > 0) & (n > 0), given).otherwise(F.transform(votes, lambda v: F.lit(0).cast("long")))


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """sizes (source, source_size) with target: the level L at which sum(min(cap * size, weight * L)) = share * total.

    Sources are few against rows; one window over them ranks and accumulates.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_goal", F.lit(float(share)) * F.sum("source_size").over(everything))
    level = (F.col("_goal") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    w = w.withColumn("_level", level)
    # in order of cap / weight, sources are full while the level left for the rest is above theirs; from the first other one the levels fall
    w = w.withColumn("_L", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything))
    return w.select("source", "source_size", "_rank", F.least("_cap", F.coalesce(F.col("_w") * F.col("_L"), F.col("_cap"))).alias("target"))


def _planned(
    rows: DataFrame, share: float, cap: float, weights: tuple[float, ...], block_words: int, shard_words: int, seed: int, fan_out: int = 512
) -> DataFrame:
    """Rows with columns _id, source, size and any others, and what the mix takes of each: rounds, arc_start, arc_words, wrap_words, taken.

    A row's shard and its place there follow from the row itself, so rows alike in all columns have places of their own.
    """
    if not cap >= share > 0:
        raise ValueError("cap >= share > 0 is needed")
    sizes = staged(rows.select("_id", "source", "size"), "sizes")
    if rows.columns == sizes.columns:  # nothing to carry: words needn't be counted again
        rows = sizes
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    block, blocks = F.lit(int(block_words)), F.round(F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) / F.lit(float(block_words))).cast("long")
    listed = targets.withColumn("_blocks", blocks).groupBy().agg(F.sort_array(F.collect_list(F.struct("_rank", "source", "source_size", "target"))).alias("_s"), F.max("_blocks").alias("_blocks"))
    listed = listed.withColumn("_v", F.transform("_s", lambda s: s["target"]))
    quota = seats(F.col("_v"), F.col("_blocks"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_words))))
    plan = staged(
        listed.select(F.explode(F.arrays_zip(F.col("_s"), quota.alias("_q"))).alias("x"))
        .select(F.col("x._s.source").alias("_src"), F.col("x._s.source_size").alias("source_size"), F.col("x._s.target").alias("target"), F.col("x._q").alias("_quota"))
        .withColumn("_shards", shards.cast("long")),
        "sources",
    )

    def dealt(df: DataFrame) -> DataFrame:
        joined = df.join(plan, df["source"].eqNullSafe(plan["_src"]))
        return joined.withColumn("_shard", F.pmod(F.xxhash64("_id", "size", F.lit(seed)), F.col("_shards")))

    # shards' sizes, and their quotas down a tree of shards: what a node has is split among its fan_out children by their sizes
    sized = staged(dealt(sizes).groupBy("_src", "_shard").agg(F.sum("size").alias("_n")), "shards")
    level, most = 0, plan.agg(F.max("_shards")).first()[0] or 1
    while fan_out ** (level + 1) < most:
        level += 1
    quotas = plan.select(F.col("_src").alias("_s2"), F.lit(0).cast("long").alias("_h2"), "_quota")
    for k in range(level, -1, -1):
        below = sized.groupBy("_src", F.expr(f"_shard div {fan_out**k}").alias("_node")).agg(F.sum("_n").alias("_n"))
        children = below.groupBy("_src", F.expr(f"_node div {fan_out}").alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_node", "_n"))).alias("_c"))
        split = children.join(quotas, children["_src"].eqNullSafe(quotas["_s2"]) & (children["_up"] == quotas["_h2"])).withColumn("_v", F.transform("_c", lambda c: c["_n"].cast("double")))
        split = split.select("_src", F.explode(F.arrays_zip(F.col("_c"), seats(F.col("_v"), F.col("_quota")).alias("_q"))).alias("x"))
        quotas = staged(split.select(F.col("_src").alias("_s2"), F.col("x._c._node").alias("_h2"), F.col("x._c._n").alias("_n"), F.col("x._q").alias("_quota")), "quotas")
    need = F.least(F.col("_quota") * block, (F.lit(float(cap)) * F.col("_n")).cast("long"))
    per_shard = quotas.select("_s2", "_h2", "_n", need.alias("_need"))

    cell = dealt(rows)
    placed = cell.join(per_shard, cell["_src"].eqNullSafe(per_shard["_s2"]) & (cell["_shard"] == per_shard["_h2"]))
    order = Window.partitionBy("_src", "_shard").orderBy(F.xxhash64("_id", F.lit(seed + 1)), F.col("_id"), F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_at", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")))
    rounds = F.when(F.col("_n") > 0, F.expr("_need div _n")).otherwise(F.lit(0)).cast("long")
    in_shard = F.greatest(F.lit(1), F.ceil(F.col("_n") / block))
    start = F.pmod(F.xxhash64("_src", "_shard", F.lit(seed + 2)), in_shard.cast("long")) * block
    placed = placed.withColumn("_rounds", rounds).withColumn("_start", start.cast("long")).withColumn("_arc", F.col("_need") - F.col("_rounds") * F.col("_n"))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(b, F.col("_at") + F.col("size")) - F.greatest(a, F.col("_at")))

    stop = F.col("_start") + F.col("_arc")
    arc, wrap = overlap(F.col("_start"), F.least(stop, F.col("_n"))), overlap(F.lit(0).cast("long"), stop - F.col("_n"))
    return placed.select(
        *rows.columns,
        "source_size",
        "target",
        (F.col("_rounds") * F.col("size") + arc + wrap).alias("taken"),
        F.col("_rounds").alias("rounds"),
        F.greatest(F.lit(0).cast("long"), F.col("_start") - F.col("_at")).alias("arc_start"),
        arc.alias("arc_words"),
        wrap.alias("wrap_words"),
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    block_words: int = 64,
    shard_words: int = 1 << 18,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, and the arc taken of its own words.

    taken = rounds * size + arc words; the arc is words [arc_start, arc_start + arc_words) of the
    document and, where the arc wraps round within it, also its first wrap_words words.
    Null text or one without words: size 0, taken 0. Null source: a source of its own, last.
    Null ids are dealt to shards by size. Rows that repeat an id are separate. Empty table: empty result.
    cap must be at least share, so that the targets can be reached. Other columns don't matter.
    """
    rows = docs.select(*_sized(docs, id_col, text_col, source_col))
    out = _planned(rows, share, cap, weights, block_words, shard_words, seed)
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken", "rounds", "arc_start", "arc_words", "wrap_words")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    block_words: int = 64,
    shard_words: int = 1 << 18,
    seed: int = 17,
) -> DataFrame:
    """docs as the mix takes them: a row for each round, one more with the words of the arc, none where nothing is taken.

    Columns are those of docs, whatever their names; only the text of an arc is cut, at word bounds, blanks before words kept.
    Every row carries its own plan, so rows alike in id, source and size are taken as often as the mix says.
    """
    rows = docs.select(*_sized(docs, id_col, text_col, source_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    plan = _planned(rows, share, cap, weights, block_words, shard_words, seed)
    text = F.col("doc")[text_col]
    words = F.regexp_extract_all(text, F.lit(_WITH_BLANKS), F.lit(0))

    def cut(a: Column, n: Column) -> Column:
        return F.array_join(F.slice(words, (a + 1).cast("int"), n.cast("int")), "")

    size, arc, none = F.col("size"), F.col("arc_words"), F.array().cast("array<string>")
    whole = F.array_repeat(text, (F.col("rounds") + F.when(arc == size, 1).otherwise(0)).cast("int"))
    partial = F.when((arc > 0) & (arc < size), F.array(cut(F.col("arc_start"), arc))).otherwise(none)
    wrapped = F.when(F.col("wrap_words") > 0, F.array(cut(F.lit(0), F.col("wrap_words")))).otherwise(none)
    texts = F.when(size > 0, F.concat(whole, partial, wrapped)).otherwise(none)
    return plan.select("doc", F.explode(texts).alias("taken_text")).select(*[F.col("taken_text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])

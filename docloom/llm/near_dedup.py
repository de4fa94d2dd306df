"""Near-duplicate groups by bottom-k sketches of one hash function.

1. A text's set holds the hashes of its distinct word shingles. Equal sets form
   one class, so copies cost nothing further. A class keeps a bottom-k sketch: the
   k smallest values of the one hash.
2. Two sets at least `threshold` alike share about k * threshold retained values;
   `need` is that less 6.5 standard deviations. Sets that share `need` of k values
   share one among their k - need + 1 rarest, so only those stand in inverted
   lists (a prefix filter with the corpus' own value counts). Values held by one
   class alone drop out, and a passage that many texts share is rarely among the rarest.
3. In a list of up to `small_list` classes all pairs are candidates. In a longer one every class is held
   against a hub, then against the class nearest to what most of the list's classes hold (their
   consensus); links so found give first components. Only classes of different components can still
   add something, and they are found by prefixes of their deltas, what they add to the consensus and what
   they lack of it (`around`).
4. Whatever list a candidate comes from, the union sketch of the pair estimates its similarity and drops
   it under need / k, and the exact Jaccard similarity of the full sets decides.
5. Verified links give components.

What can be lost: a link whose sketches are 6.5 standard deviations off. Up to k values a sketch is the
whole set and nothing is lost; for larger sets at the very threshold the chance is P(Binomial(k, threshold) < need) at
most, 2.2e-9 for k = 48 and 0.85, and falls fast above it; a component loses a row only if all its links are.
Work: hubs, consensus and deltas are linear in a list's classes. Pairs are formed only between
components that share rare additions (or, where classes chiefly lack text, rare omissions). That keeps families of edited
copies small, but is no bound: where edits draw on few words, unlinked copies do share them, and pairs grow faster than the family.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.lineage import drop, staged, unused
from docloom.llm.textvec import slices, text_sets
from docloom.llm.worker import fresh

_NO_ID = (1 << 63) - 1
_SLICE_BYTES = 1 << 18


def needed(k: int, threshold: float) -> int:
    """Retained values, of k, that two sets at the threshold share, less 6.5 standard deviations."""
    return max(1, math.floor(k * threshold - 6.5 * math.sqrt(k * threshold * (1 - threshold))))


def _sets(width: int, k: int | None):
    """Arrow function (_key, _id, text) -> (_key, _id, fp, n, values): the bottom-k sketch, or the full set where k is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(2), _SLICE_BYTES):
                sets = [np.sort(s.view(np.int64)) for s in text_sets(piece, width)]
                kept = [s[:k] for s in sets]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(piece.first, piece.n) for c in (0, 1)],
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64), pa.int64())),
                    ],
                    ["_key", "_id", "fp", "n", "values"],
                )

    return run


_SETS_SCHEMA = "_key long, _id long, fp binary, n long, values array<long>"


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for edges (a, b).

    Labels spread to neighbours and then jump to their label's label, so chains shorten
    by half at least in each round; every round is a written table, which the next one replaces.
    """
    both = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "links")
    table = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        labels = table.select("node", "label")
        seen = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("seen"))
        spread = labels.join(seen, labels["node"] == seen["u"]).select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        to = labels.select(F.col("node").alias("t"), F.col("label").alias("jump"))
        step = spread.join(to, spread["label"] == to["t"]).select("node", "was", F.least("label", "jump").alias("label"))
        before, table = table, staged(step, "labels")
        drop(before)
        if table.where(F.col("label") != F.col("was")).isEmpty():
            drop(both)
            return table.select("node", "label")


class _Search:
    """Estimating and verifying pairs of classes, and joining lists around hubs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, threshold: float, width: int):
        self.docs, self.nodes, self.k, self.width = docs, nodes, k, width
        self.need = needed(k, threshold)
        self.parts = round(threshold * 1_000_000)
        self.threshold = threshold

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), any way round and repeated, those whose sizes and sketches allow a link."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        sketch = self.nodes.select("fp", "values", "n")
        x = pairs.join(sketch.select(F.col("fp").alias("b"), F.col("values").alias("vb"), F.col("n").alias("nb")), "b")
        x = x.join(sketch.select(F.col("fp").alias("a"), F.col("values").alias("va"), F.col("n").alias("na")), "a")
        union = F.slice(F.sort_array(F.array_union("va", "vb")), 1, self.k)
        shared = F.size(F.array_intersect(F.array_intersect(union, F.col("va")), F.col("vb"))).cast("long")
        bound = F.least("na", "nb") * F.lit(1_000_000) >= F.lit(self.parts) * F.greatest("na", "nb")
        return staged(x.where(bound & (shared * F.lit(self.k) >= F.lit(self.need) * F.size(union))).select("a", "b"), "likely")

    def full_sets(self, wanted: DataFrame) -> DataFrame:
        """(fp, set) of the wanted classes, from the text of one row each."""
        wanted = staged(self.nodes.join(wanted.select("fp").distinct(), "fp").select(F.col("key").alias("_key"), F.col("fp").alias("_fp")), "wanted")
        mine = self.docs.join(wanted.select("_key").distinct(), "_key", "left_semi")
        if not wanted.where("_key is null").isEmpty():  # classes of rows without a key only
            mine = mine.union(self.docs.where("_key is null"))
        full = mine.mapInArrow(fresh(_sets(self.width, None)), _SETS_SCHEMA).select("fp", F.col("values").alias("set"))
        # rows that share a key or have none may give other sets or a set twice
        return staged(full.join(wanted.select(F.col("_fp").alias("fp")), "fp", "left_semi").dropDuplicates(["fp"]), "sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        y = pairs.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
        y = y.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a")
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        either = F.size("sa") + F.size("sb") - both
        return y.where(both * F.lit(1_000_000) >= F.lit(self.parts) * either).select("a", "b")

    def _linked(self, n: Column, other_n: Column, apart: Column) -> Column:
        """Whether sets of these sizes that differ in `apart` values are alike enough."""
        return (n + other_n - apart) * F.lit(1_000_000) >= F.lit(self.parts) * (n + other_n + apart)

    def deltas(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(hub, fp, n, hn, added, lacked, near) of the classes around hubs; near: linked to the hub."""
        y = members.join(sets, "fp").join(sets.select(F.col("fp").alias("hub"), F.col("set").alias("hs")), "hub")
        y = y.select("hub", "fp", F.size("set").cast("long").alias("n"), F.size("hs").cast("long").alias("hn"), F.array_except("set", "hs").alias("added"), F.array_except("hs", "set").alias("lacked"))
        return staged(y.withColumn("near", self._linked(F.col("n"), F.col("hn"), (F.size("added") + F.size("lacked")).cast("long"))), "deltas")

    @staticmethod
    def _counted(deltas: DataFrame) -> DataFrame:
        """(hub, v, plus, df) of the values in deltas; plus: an added one."""
        values = F.concat(
            F.transform("added", lambda v: F.struct(v.alias("v"), F.lit(True).alias("plus"))), F.transform("lacked", lambda v: F.struct(v.alias("v"), F.lit(False).alias("plus")))
        )
        return deltas.select("hub", "fp", F.explode(values).alias("x")).select("hub", "fp", "x.*")

    def recentred(self, deltas: DataFrame) -> DataFrame:
        """deltas against the consensus of a hub's classes, the values that more than half of them hold; h is its size."""
        size = deltas.groupBy("hub").agg(F.count("*").alias("classes"))
        often = self._counted(deltas).groupBy("hub", "v", "plus").agg(F.count("*").alias("df")).join(size, "hub").where("2 * df > classes")
        # at most twice the mean delta of a list
        turned = often.groupBy("hub").agg(F.collect_list(F.when(F.col("plus"), F.col("v"))).alias("gains"), F.collect_list(F.when(~F.col("plus"), F.col("v"))).alias("losses"))
        x = deltas.join(turned, "hub", "left")
        for c in ("gains", "losses"):
            x = x.withColumn(c, F.coalesce(c, F.array().cast("array<bigint>")))
        added = F.concat(F.array_except("added", "gains"), F.array_except("losses", "lacked"))
        lacked = F.concat(F.array_except("lacked", "losses"), F.array_except("gains", "added"))
        x = x.select("hub", "fp", "n", (F.col("hn") + F.size("gains") - F.size("losses")).alias("h"), added.alias("added"), lacked.alias("lacked"))
        return staged(x.withColumn("d", F.size("added") + F.size("lacked")), "recentred")

    def _apart(self, a: str, b: str) -> Column:
        """In how many values two classes differ, from their deltas against one consensus."""
        both = [F.size(F.array_intersect(f"{c}_{a}", f"{c}_{b}")) for c in ("added", "lacked")]
        return (F.size(f"added_{a}") + F.size(f"lacked_{a}") + F.size(f"added_{b}") + F.size(f"lacked_{b}") - 2 * (both[0] + both[1])).cast("long")

    @staticmethod
    def _named(x: DataFrame, side: str) -> DataFrame:
        return x.select("hub", F.col("fp").alias(side), F.col("n").alias(f"n_{side}"), F.col("added").alias(f"added_{side}"), F.col("lacked").alias(f"lacked_{side}"))

    def near_centre(self, centred: DataFrame) -> DataFrame:
        """Links (a, b) of classes to the class nearest to their consensus."""
        first = centred.groupBy("hub").agg(F.min(F.struct("d", "fp")).alias("x")).select("hub", F.col("x.fp").alias("fp"))
        middle = self._named(centred.join(first, ["hub", "fp"]), "b")
        y = self._named(centred, "a").join(middle, "hub").where("a != b")
        return y.where(self._linked(F.col("n_a"), F.col("n_b"), self._apart("a", "b"))).select("a", "b")

    def _bounds(self, d: tuple[Column, Column], m: tuple[Column, Column], r: tuple[Column, Column], h: Column) -> tuple[Column, Column, Column]:
        """How many values two linked classes' deltas differ in at most, share at least, and share at least of what they add.

        With h values in the consensus, a class that adds a values and lacks r has h + a - r = h - m. Linked classes differ in at most
        c (|x| + |y|) values, c = (1 - t) / (1 + t), so deltas of dx and dy values share half of what dx + dy exceeds that by; of
        those, at most the smaller r can be lacked ones. All three hold as well for bounds of d and m from below and of r from above.
        """
        c = (1 - self.threshold) / (1 + self.threshold)
        reach = F.floor(F.lit(c) * (2 * h - m[0] - m[1]) + F.lit(1e-9))
        share = F.ceil((d[0] + d[1] - reach) / 2)
        return reach, share, share - F.least(*r)

    def _prefixes(self, x: DataFrame) -> DataFrame:
        """x with `least_added`, `least_shared` (null: no such partner) and `free`, over all partners that a class can be linked to.

        Classes are binned by d and m; pairs of bins, few however many classes there are, tell what their classes must share.
        """
        # one value of d each below 64, from there 16 bins to every doubling; seven of m
        x = x.withColumn("d_bin", F.when(F.col("d") < 64, F.col("d")).otherwise(64 + F.floor(16 * F.log2(F.greatest(F.col("d"), F.lit(64)) / 64))).cast("int"))
        x = x.withColumn("m_bin", F.least(F.lit(3), F.greatest(F.lit(-3), F.ceil(F.col("m") / F.greatest(F.lit(1), F.floor(F.col("h") / 64))))).cast("int"))
        own = ["hub", "in_top", "d_bin", "m_bin"]
        limits = [F.min("d").alias("d_low"), F.max("d").alias("d_high"), F.min("m").alias("m_low"), F.max("r").alias("r_high"), F.max("a").alias("a_high"), F.first("h").alias("h")]
        bins = staged(x.groupBy(*own).agg(*limits), "bins")
        other = bins.drop("h").select("hub", *[F.col(c).alias(f"o_{c}") for c in bins.columns if c not in ("hub", "h")])
        pairs = bins.join(other, "hub").where("not (in_top and o_in_top)")
        both = {c: (F.col(c), F.col(f"o_{c}")) for c in ("d_low", "m_low", "r_high")}
        reach, share, added = self._bounds(both["d_low"], both["m_low"], both["r_high"], F.col("h"))
        pairs = pairs.withColumn("reach", reach).withColumn("share", share).withColumn("added", added)
        pairs = pairs.where("d_low - o_d_high <= reach and o_d_low - d_high <= reach and share <= least(d_high, o_d_high) and added <= least(a_high, o_a_high)")
        kinds = [F.min(F.when(F.col("added") >= 1, F.col("added"))).alias("least_added"), F.min(F.when((F.col("added") < 1) & (F.col("share") >= 1), F.col("share"))).alias("least_shared")]
        needs = pairs.groupBy(*own).agg(*kinds, F.max(F.col("share") < 1).alias("free"))
        return x.join(needs, own)

    def around(self, centred: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (a, b) between classes around one consensus that aren't in one component yet.

        A pair that must share additions has one in a prefix of each side's rarest additions; other pairs that must share a value
        have one in prefixes of whole deltas; where nothing need be shared the classes meet as they are. Values held
        once come first in a prefix but give no key. Every key carries what its place in the prefix allows (`room`), so the join
        keeps only pairs whose own numbers put the value in both prefixes.
        """
        ids = ["hub", "fp"]
        x = centred.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        # only lists with several components can add a link, and none within the component that most of a list is in
        by_label = x.groupBy("hub", "label").agg(F.count("*").alias("classes"))
        top = by_label.groupBy("hub").agg(F.max(F.struct("classes", "label"))["label"].alias("top"), F.count("*").alias("labels")).where("labels > 1").select("hub", "top")
        x = staged(x.join(top, "hub").withColumn("in_top", F.col("label") == F.col("top")).drop("top"), "open")
        spread = self._counted(x)
        common = spread.groupBy("hub", "v").agg(F.count("*").alias("df")).where("df > 1")
        held = spread.join(common, ["hub", "v"]).groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("df", "v", "plus"))).alias("held"))
        a, r = F.size("added"), F.size("lacked")
        x = x.select(*ids, "label", "in_top", F.col("h").cast("int").alias("h"), a.alias("a"), r.alias("r"), (a + r).alias("d"), (r - a).alias("m"))
        x = self._prefixes(x).join(held, ids, "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<df:bigint,v:bigint,plus:boolean>>")))
        x = x.withColumn("plus", F.filter("held", lambda s: s["plus"]))

        def prefix(kind: int, values: str, size: str, least: str) -> Column:
            room = F.col(size) + 1 - (F.col(size) - F.size(values))  # of the first value: what must be shared has to stay below
            keys = F.transform(values, lambda s, i: F.struct(F.lit(kind).alias("kind"), s["v"].alias("v"), (room - i).cast("long").alias("room")))
            return F.when(F.col(least).isNotNull(), F.filter(keys, lambda s: s["room"] > F.col(least))).otherwise(F.array().cast("array<struct<kind:int,v:bigint,room:bigint>>"))

        alone = F.when(F.col("free"), F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("room")))).otherwise(F.array().cast("array<struct<kind:int,v:bigint,room:bigint>>"))
        keys = x.select(*ids, "label", "in_top", "h", "d", "m", "r", F.explode(F.concat(prefix(0, "plus", "a", "least_added"), prefix(1, "held", "d", "least_shared"), alone)).alias("x"))
        keys = staged(keys.select(*ids, "label", "in_top", "h", "d", "m", "r", "x.*"), "keys")
        key = ["hub", "kind", "v"]
        mixed = keys.groupBy(*key).agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first != last").select(*key)
        keys = keys.join(mixed, key)
        sides = [keys.select(*key, F.col("fp").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("label", "in_top", "h", "d", "m", "r", "room")]) for n in "ab"]
        both = {c: (F.col(f"{c}_a"), F.col(f"{c}_b")) for c in "dmr"}
        reach, share, added = self._bounds(both["d"], both["m"], both["r"], F.col("h_a"))
        fits = F.when(F.col("kind") == 0, (added >= 1) & (added < F.least("room_a", "room_b"))).when(F.col("kind") == 1, (share >= 1) & (share < F.least("room_a", "room_b"))).otherwise(True)
        pairs = sides[0].where("not in_top_a").join(sides[1], key).where(fits & (F.abs(F.col("d_a") - F.col("d_b")) <= reach) & F.expr("label_a != label_b and (in_top_b or a < b)"))
        pairs = staged(pairs.select("hub", "a", "b").distinct(), "pairs")
        likely = self.likely(pairs.select("a", "b"))
        pairs = pairs.join(likely.union(likely.select("b", "a")), ["a", "b"])
        y = pairs.join(self._named(centred, "b"), ["hub", "b"]).join(self._named(centred, "a"), ["hub", "a"])
        return staged(y.where(self._linked(F.col("n_a"), F.col("n_b"), self._apart("a", "b"))).select("a", "b"), "late")


def _grouped(texts: DataFrame, threshold: float, width: int, k: int, small_list: int) -> DataFrame:
    """(_key, _id, n, component, first) for rows (_key, _id, text); first: the group's row of the smallest id, of the smallest key among equal ids."""
    known = staged(texts.mapInArrow(fresh(_sets(width, k)), _SETS_SCHEMA), "sketches")
    first = F.min(F.struct(F.coalesce("_id", F.lit(_NO_ID)).alias("id"), F.col("_key").alias("key")))
    nodes = known.where("n > 0").groupBy("fp").agg(first.alias("first"), F.first("n").alias("n"), F.first("values").alias("values"))
    nodes = staged(nodes.select("fp", "n", "values", F.col("first.key").alias("key"), "first"), "nodes")
    search = _Search(texts, nodes, k, threshold, width)
    postings = nodes.select("fp", F.size("values").alias("s"), F.explode("values").alias("v"))
    common = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    hits = postings.join(common, "v").groupBy("fp").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("h"))
    hits = hits.withColumn("alone", F.col("s") - F.size("h"))
    room = F.col("s") - F.ceil(F.col("s") * F.lit(search.need) / F.lit(k)).cast("int") + 1 - F.col("alone")
    prefix = staged(hits.withColumn("room", room).where("room > 0").select("fp", "alone", F.explode(F.slice("h", 1, F.col("room"))).alias("h")).select("fp", "alone", F.col("h.v").alias("v")), "prefixes")
    # the hub of a list is the class with the fewest values of its own: the text the others were made from, if there is one
    lists = prefix.groupBy("v").agg(F.count("*").alias("len"), F.min(F.struct("alone", "fp")).alias("h")).where("len > 1")
    lists = staged(lists.select("v", "len", F.col("h.fp").alias("hub")), "lists")
    short = prefix.join(lists.where(F.col("len") <= small_list).select("v"), "v", "left_semi")
    pairs = short.select("v", F.col("fp").alias("a")).join(short.select("v", F.col("fp").alias("b")), "v").where("a < b").select("a", "b")
    pairs = search.likely(pairs)
    members = prefix.join(lists.where(F.col("len") > small_list).select("v", "hub"), "v").select("hub", "fp").distinct()
    members = staged(members, "members")
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(members.select("fp"))
    sets = search.full_sets(wanted)
    deltas = search.deltas(members, sets)
    near = deltas.where("near and hub != fp").select("hub", "fp")
    centred = search.recentred(deltas)
    links = staged(search.verified(pairs, sets).union(near).union(search.near_centre(centred)), "links")
    labels = components(links)
    late = search.around(centred, labels)
    if not late.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(late))

    named = nodes.select("fp", "first").join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    of = named.join(least, "label").select(F.col("fp").alias("_fp"), "least")
    out = known.where("n > 0").join(of, known["fp"] == of["_fp"])
    out = out.select("_key", "_id", "n", F.nullif("least.id", F.lit(_NO_ID)).alias("component"), F.col("_key").eqNullSafe(F.col("least.key")).alias("first"))
    return out.union(known.where("n = 0").select("_key", "_id", "n", F.col("_id").alias("component"), F.lit(True).alias("first")))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, k: int = 48, small_list: int = 8
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id linked through), kept (id = component_id).

    Words are runs of bytes other than ASCII blanks, A-Z lower-cased. Texts with
    fewer words than `width` have their whole word sequence as one shingle; null texts and
    texts without words have no set, link with nothing and are components of their own.
    Null ids: component_id is the smallest id of the component, null if it has none; kept is false beside one that has.
    Repeated rows are equal sets; a repeated id with other texts links nothing by itself. Empty table: empty result. Other columns don't matter.
    """
    key = F.col(id_col).cast("long")
    rows = _grouped(docs.select(key.alias("_key"), key.alias("_id"), F.col(text_col).alias("text")), threshold, width, k, small_list)
    return rows.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept"))


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, k: int = 48, small_list: int = 8
) -> DataFrame:
    """docs with one row of each near-duplicate group, a row of the smallest id (null ids last), all columns as they were.

    Exactly one row of a group stays, also where ids repeat or are null; texts without words stay. Other columns may have any name.
    """
    row = unused(docs, "row")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    texts = keyed.select(F.col(row).alias("_key"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    kept = _grouped(texts, threshold, width, k, small_list).where("first").select(F.col("_key").alias(row))
    return keyed.join(kept, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])

"""Queries that go through a bucket: what is written is read back, and SQL gives the same rows."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import errors as E
from docloom.functions.bson import decode, encode, from_json
from docloom.functions.records import from_document, to_document
from docloom.functions.values import kind
from docloom.sources.bucket import Bucket
from docloom.sources.files import scratch
from docloom.streaming.subscription import LiveTail, apply_batch, attach_replica, event_stream, read_batch, replication_cursor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PART = "p_partkey as _id, p_name, p_brand, p_type, p_size"


def _query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _parts(spark: SparkSession, sf_dir: str) -> Bucket:
    """A bucket of parts in key order."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as _id", "p_name", "p_brand", "p_type", "p_size")
    bucket = Bucket.open(spark, scratch(spark), schema=rows.schema)
    bucket.insert(rows.repartitionByRange("_id").sortWithinPartitions("_id"))
    return bucket


def _documents(spark: SparkSession, sf_dir: str) -> Bucket:
    """A bucket of BSON documents in which p_size is missing, a string or an integer by turns."""

    @F.pandas_udf("binary")  # Spark runs it and the bucket's own function in one Python process
    def made(keys: pd.Series, names: pd.Series, sizes: pd.Series) -> pd.Series:
        docs = []
        for key, name, size in zip(keys, names, sizes, strict=True):
            d = {"_id": int(key), "name": name, "tags": name.split(" ")}
            if key % 5:
                d["size"] = str(size) if key % 5 == 1 else int(size)
            docs.append(encode(d))
        return pd.Series(docs, dtype="object")

    bucket = Bucket.open(spark, scratch(spark))
    bucket.insert(spark.read.parquet(f"{sf_dir}/part.parquet").select(made("p_partkey", "p_name", "p_size").alias("doc")))
    return bucket


def _ids(bucket: Bucket, query: dict) -> DataFrame:
    """The keys of the matches, read in the step that finds them."""
    return bucket.find(query, lambda d: int(d["_id"]), "long").withColumnRenamed("doc", "_id")


def _one(spark: SparkSession, **values: object) -> DataFrame:
    """One row of whole numbers and strings."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))


@_query(f"select {_PART} from part where p_size > 25 order by _id limit 100 offset 10")
def bucket_insert_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).find({"query": {"p_size": {"$gt": 25}}, "sector": {"offset": 10, "limit": 100}})


@_query(f"select {_PART} from part where p_size <= 40")
def bucket_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    bucket.delete({"query": {"p_size": {"$gt": 40}}, "sector": {"limit": 1}})
    return bucket.find()


@_query(
    "with m as (select p_partkey from part where p_size > 40 order by p_partkey limit 50 offset 5) "
    "select p_partkey as _id, p_name, case when p_partkey in (select p_partkey from m) then 'X' else p_brand end as p_brand, p_type, "
    "(p_size + case when p_partkey in (select p_partkey from m) then 1000 else 0 end)::int as p_size from part"
)
def bucket_update_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    bucket.update({"query": {"p_size": {"$gt": 40}}, "sector": {"offset": 5, "limit": 50}}, {"p_brand": "X", "p_size": {"$plus": ["$.p_size", 1000]}})
    return bucket.find()


@_query("select _id, p_size from (select p_partkey as _id, p_size, case when p_size = 7 then 1 else 0 end as moved from part) order by moved, _id limit 20 offset (select count(*) - 20 from part)")
def bucket_updated_go_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    bucket.update({"query": {"p_size": 7}}, {"p_brand": "moved"})
    return bucket.find({"sector": {"offset": bucket.count() - 20}, "projection": {"pick": ["_id", "p_size"]}})


@_query(
    "select p_partkey as _id, p_name, case when p_size > 45 then null else p_brand end as p_brand, case when p_size > 45 then 'T' else p_type end as p_type, p_size, "
    "case when p_partkey % 3 > 0 then 9007199254740993 + 2 * p_partkey end as wide, p_partkey % 4 = 0 as nan from part where p_size not between 10 and 12"
)
def bucket_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that change() hands on stay what they are: longs beyond 2**53 beside missing ones, NaN."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey as _id", "p_name", "p_brand", "p_type", "p_size", "case when p_partkey % 3 > 0 then 9007199254740993 + 2 * p_partkey end as wide", "if(p_partkey % 4 = 0, double('NaN'), 0.5d) as ratio"
    )
    bucket = Bucket.open(spark, scratch(spark), schema=rows.schema)
    bucket.insert(rows)
    query = {"query": {"$or": [{"p_size": {"$gt": 45}}, {"p_size": {"$gte": 10, "$lte": 12}}]}}
    bucket.transform(query, lambda d: {k: v for k, v in d.items() if k != "p_brand"} | {"p_type": "T"} if d["p_size"] > 45 else None)
    return bucket.find().select("_id", "p_name", "p_brand", "p_type", "p_size", "wide", F.isnan("ratio").alias("nan"))


@_query(f"select {_PART} from part where p_size <> 3 union all select -1, 'new', null, null, 3")
def bucket_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    with bucket.transaction() as tx:
        tx.delete({"query": {"p_size": 3}})
        tx.insert({"_id": -1, "p_name": "new", "p_size": 3})
    undone = bucket.transaction()
    undone.delete({"query": {}})
    undone.rollback()
    return bucket.find()


@_query(
    "with d as (select p_partkey, row_number() over (order by p_partkey) as k, count(*) over () as n from part where p_size = 3) "
    "select row_number() over (order by p_partkey) as seqno, 'insert' as op, p_partkey as doc_id, p_size from part where true "
    "union all select (select count(*) from part) + k, 'delete', p_partkey, null from d"
)
def bucket_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    bucket.delete({"query": {"p_size": 3}})
    return bucket.changes().select("seqno", "op", "doc_id", F.col("doc.p_size").alias("p_size"))


@_query("select op, count(*) as n from (select 'insert' as op from part where p_size > 30 union all select 'delete' from part where p_size = 3) group by op")
def bucket_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    bucket.delete({"query": {"p_size": 3}})
    name = "events_" + bucket.files.root.rsplit("-", 1)[-1].replace("/", "_")
    stream = event_stream(bucket, {"query": {"p_size": {"$gt": 30}}}).groupBy("op").agg(F.count("*").alias("n"))
    run = stream.writeStream.format("memory").outputMode("complete").queryName(name).option("checkpointLocation", bucket.files.full("_stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@_query(f"select {_PART} from part where p_size >= 30 and (p_size > (select p_size from part where p_partkey = 100) or (p_size = (select p_size from part where p_partkey = 100) and p_partkey > 100))")
def bucket_cursor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    bucket.ensure_index("p_size")
    query = {"query": {"p_size": {"$gte": 30}}}
    return bucket.find(query | {"cursor": bucket.export_cursor(query, 100)})


@_query(f"select {_PART} from part where starts_with(p_name, 's') and p_partkey > 100")
def bucket_cursor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    query = {"query": {"p_name": {"$startsWith": "s"}}}
    return bucket.find(query | {"cursor": bucket.export_cursor(query, 100)})


@_query(f"select {_PART} from part where p_size <= 40")
def bucket_vacuum_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _parts(spark, sf_dir)
    bucket.delete({"query": {"p_size": {"$gt": 40}}})
    bucket.vacuum()
    copy = scratch(spark)
    bucket.dump(copy)
    return Bucket.open(spark, copy).find()


@_query("select p_partkey as _id, case when p_size = 5 then 'five' else p_brand end as p_brand from part where p_size <> 3")
def bucket_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _parts(spark, sf_dir)
    replica = attach_replica(source, scratch(spark))
    source.delete({"query": {"p_size": 3}})
    source.update({"query": {"p_size": 5}}, {"p_brand": "five"})
    while batch := read_batch(source, replication_cursor(replica), max_bytes=1):
        apply_batch(replica, batch)
    return replica.find({"projection": {"pick": ["_id", "p_brand"]}})


@_query("select p_partkey as _id from part where p_partkey % 5 = 1 or (p_partkey % 5 > 1 and p_size > 30)")
def dynamic_cross_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings rank above numbers, missing fields match nothing."""
    return _ids(_documents(spark, sf_dir), {"query": {"size": {"$gt": 30}}})


@_query("select p_partkey as _id from part where p_name like '%red%' and list_contains(string_split(p_name, ' '), 'red') and p_partkey % 5 = 0")
def dynamic_array_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(_documents(spark, sf_dir), {"query": {"tags": "red", "size": {"$notExists": True}}})


@_query(
    "select p_partkey as _id from part order by case when p_partkey % 5 = 0 then 2 when p_partkey % 5 = 1 then 1 else 0 end, "
    "case when p_partkey % 5 > 1 then p_size end, case when p_partkey % 5 = 1 then p_size::varchar end, p_partkey "
    "limit (select count(*) + 40 from part where p_partkey % 5 = 1) offset (select count(*) - 20 from part where p_partkey % 5 > 1)"
)
def dynamic_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, then strings, then documents without the field: the last 20 numbers, all strings, the first 20 without."""
    bucket = _documents(spark, sf_dir)
    strings = bucket.find({"query": {"size": {"$gte": ""}}}).count()
    numbers = bucket.find({"query": {"size": {"$lt": ""}}}).count()
    return _ids(bucket, {"sort": {"asc": "size"}, "sector": {"offset": numbers - 20, "limit": strings + 40}})


@_query(
    "select (select count(*) from part where p_size > 40) as updated, (select count(*) from part where p_size <= 10) as deleted, 0 as nothing, "
    "(select count(*) from part where p_size > 10) as left_over, (select count(*) from part where p_size > 10) as counted"
)
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What updates and deletes report, and what is left."""
    bucket = _parts(spark, sf_dir)
    updated = bucket.update({"query": {"p_size": {"$gt": 40}}}, {"p_brand": "X"})
    deleted, nothing = bucket.delete({"query": {"p_size": {"$lte": 10}}}), bucket.delete({"query": {"p_size": {"$lt": 0}}})
    return _one(spark, updated=updated, deleted=deleted, nothing=nothing, left_over=bucket.count(), counted=bucket.find().count())


@_query(
    "select 'p_size' as path, false as uniq, false as sparse, '' as refused union all select 'p_partkey2', true, true, '' union all select 'dropped', false, false, 'gone' union all select 'p_brand', false, false, 'DuplicateKey'"
)
def bucket_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes that are made, dropped, and refused because keys repeat; an insert that repeats a unique key changes nothing."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as _id", "p_brand", "p_size", "case when p_partkey % 2 = 0 then p_partkey end as p_partkey2")
    bucket = Bucket.open(spark, scratch(spark), schema=rows.schema)
    bucket.insert(rows)
    bucket.ensure_index("p_size")
    bucket.ensure_index("p_partkey2", unique=True, sparse=True)
    bucket.ensure_index("p_brand")
    bucket.drop_index("p_brand")
    out = [("dropped", False, False, "gone" if "p_brand" not in bucket.list_indexes() else "there")]
    try:
        bucket.ensure_index("p_brand", unique=True)
    except E.DuplicateKey as e:
        out.append(("p_brand", False, False, type(e).__name__))
    before = bucket.count()
    try:
        bucket.insert([{"_id": -1, "p_partkey2": 4}, {"_id": -2}])
    except E.DuplicateKey:
        assert bucket.count() == before
    out += [(path, bool(x["unique"]), bool(x["sparse"]), "") for path, x in bucket.list_indexes().items() if path != "_id"]
    return spark.createDataFrame(out, "path string, uniq boolean, sparse boolean, refused string")


@_query(
    "with n as (select count(*) as n from part), s as (select p_partkey, row_number() over (order by p_partkey) as k, count(*) over () as m from part where p_size = 7 order by p_partkey limit 12) "
    "select n + k as seqno, 'update' as op, p_partkey as doc_id, '' as label from s, n union all select n + least(m, 12) + k, 'update', p_partkey, 'short' from s, n"
)
def bucket_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates as polls of five events at most bring them, one event each: first too large to be carried in an event, then small."""
    bucket = _parts(spark, sf_dir)
    feed = bucket.subscribe({"query": {"p_size": 7}})
    chosen = sorted(r["_id"] for r in bucket.find({"query": {"p_size": 7}, "sector": {"limit": 12}}).select("_id").collect())
    for name in ("x" * 300_000, "short"):
        bucket.update({"query": {"_id": {"$in": chosen}}}, {"p_name": name})
    got = []
    while batch := feed.poll(5):
        assert len(batch["batch"]) <= 5
        got += batch["batch"]
    return spark.createDataFrame([(e["seqno"], e["op"], e["doc_id"], e["doc"]["p_name"] if "doc" in e else "") for e in got], "seqno long, op string, doc_id long, label string")


@_query("select p_partkey as _id, p_size from part where p_size = 7")
def bucket_live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What polls of a live tail bring before and after an insert."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as _id", "p_size")
    bucket = Bucket.open(spark, scratch(spark), schema=rows.schema)
    tail, got = LiveTail(bucket, {"query": {"p_size": 7}}), []
    for half in (0, 1):
        bucket.insert(rows.where(F.col("_id") % 2 == half))
        got += tail.poll()
    return spark.createDataFrame([(d["_id"], d["p_size"]) for d in got + tail.poll()], "_id long, p_size int")


@_query("select event_id, (props->>'$.k')::int as k, 'int32' as kind, 2 as fields from events")
def json_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON made documents, encoded, validated and decoded; integers are 32 bits wide."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, props in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                back = decode(encode(from_json(json.loads(props)) | {"_id": key}))
                out.append({"event_id": back["_id"], "k": back["k"], "kind": kind(back["k"]), "fields": len(back)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("event_id", pa.int64()), ("k", pa.int32()), ("kind", pa.string()), ("fields", pa.int32())]))

    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props").mapInArrow(run, "event_id long, k int, kind string, fields int")


@_query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey % 2 = 0 union all select n_nationkey, 'InvalidFormat', -1 from nation where n_nationkey % 2 = 1")
def record_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataclasses made documents and read back; a document of another shape is refused."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                document = decode(encode(to_document(_Nation(r["n_nationkey"], r["n_name"], r["n_regionkey"]))))
                if r["n_nationkey"] % 2:
                    document["name"] = [1]
                try:
                    n = from_document(_Nation, document)
                    out.append({"n_nationkey": n.key, "n_name": n.name, "n_regionkey": n.region})
                except E.InvalidFormat as e:
                    out.append({"n_nationkey": r["n_nationkey"], "n_name": type(e).__name__, "n_regionkey": -1})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("n_nationkey", pa.int32()), ("n_name", pa.string()), ("n_regionkey", pa.int32())]))

    return spark.read.parquet(f"{sf_dir}/nation.parquet").mapInArrow(run, "n_nationkey int, n_name string, n_regionkey int")


@dataclasses.dataclass
class _Nation:
    key: int
    name: str
    region: int | None = None


@_query("select p_partkey as _id from part where p_partkey % 5 > 1 and p_size + 1 > 30")
def dynamic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _documents(spark, sf_dir)
    bucket.delete({"query": {"$nor": [{"size": {"$lt": ""}}]}})
    bucket.update({}, {"0": {"now.size": {"$plus": ["$.size", 1]}}, "1": {"$unset": ["size", "tags"]}})
    return _ids(bucket, {"query": {"now.size": {"$gt": 30}, "size": {"$notExists": 1}}})

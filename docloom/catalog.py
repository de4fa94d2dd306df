"""Queries of the engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.find import find
from docloom.operators.keys import multikey_entries, unique_violations
from docloom.operators.update import delete, update
from docloom.streaming.feed import filtered_events, resumed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_OPT = "(select o_orderkey, case when o_totalprice > 100000 then o_totalprice end as big from orders)"
_TAGS = "(select p_partkey, string_split(p_name, ' ') as tags from part)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("big"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))


def _spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("spec"))


def _find(name: str, source: str | Query, query: dict, sql: str, tie: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(_table(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir), query, tie)

    QUERIES[name], ORACLES[name] = run, sql


def _leafs() -> None:
    _find("filter_eq", "events", {"query": {"event_type": {"$eq": "purchase"}}}, "select * from events where event_type = 'purchase'")
    _find("filter_eq_implicit", "events", {"query": {"event_type": "purchase"}}, "select * from events where event_type = 'purchase'")
    _find("filter_ne", "events", {"query": {"event_type": {"$ne": "purchase"}}}, "select * from events where event_type <> 'purchase'")
    _find("filter_lt", "events", {"query": {"value": {"$lt": 50}}}, "select * from events where value < 50")
    _find("filter_lte", "part", {"query": {"p_size": {"$lte": 10}}}, "select * from part where p_size <= 10")
    _find("filter_gt", "events", {"query": {"value": {"$gt": 50}}}, "select * from events where value > 50")
    _find("filter_gte", "part", {"query": {"p_size": {"$gte": 40}}}, "select * from part where p_size >= 40")
    _find("filter_in", "orders", {"query": {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}}, "select * from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
    _find("filter_between_exclusive", "part", {"query": {"p_size": {"$between": [10, 20]}}}, "select * from part where p_size > 10 and p_size < 20")
    _find("filter_starts_with", "part", {"query": {"p_name": {"$startsWith": "small"}}}, "select * from part where starts_with(p_name, 'small')")
    _find("filter_ends_with", "part", {"query": {"p_name": {"$endsWith": "bolt"}}}, "select * from part where ends_with(p_name, 'bolt')")
    _find("filter_datetime", "orders", {"query": {"o_orderdate": {"$gte": dt.datetime(1997, 1, 1)}}}, "select * from orders where o_orderdate >= timestamp '1997-01-01'")
    _find("filter_exists", _opt, {"query": {"big": {"$exists": True}}}, f"select * from {_OPT} where big is not null")
    _find("filter_not_exists", _opt, {"query": {"big": {"$notExists": True}}}, f"select * from {_OPT} where big is null")
    _find("ne_missing_is_false", _opt, {"query": {"big": {"$ne": 0}}}, f"select * from {_OPT} where big <> 0")
    _find("logical_and", "events", {"query": {"$and": [{"value": {"$gte": 10}}, {"event_type": "click"}]}}, "select * from events where value >= 10 and event_type = 'click'")
    _find("logical_or", "events", {"query": {"$or": [{"event_type": "error"}, {"value": {"$gt": 400}}]}}, "select * from events where event_type = 'error' or value > 400")
    _find("logical_nor_missing_is_true", _opt, {"query": {"$nor": [{"big": {"$lt": 300000}}, {"big": 0}]}}, f"select * from {_OPT} where not (coalesce(big < 300000, false) or coalesce(big = 0, false))")
    _find(
        "logical_nested",
        "events",
        {"query": {"$or": [{"event_type": "error"}, {"$and": [{"value": {"$gt": 100}}, {"user_id": {"$lt": 50}}]}], "event_id": {"$gte": 100}}},
        "select * from events where (event_type = 'error' or (value > 100 and user_id < 50)) and event_id >= 100",
    )
    _find("logical_nor_of_and", "events", {"query": {"$nor": [{"event_type": "click", "value": {"$lt": 60}}]}}, "select * from events where not (event_type = 'click' and value < 60)")
    _find("array_eq_any", _tags, {"query": {"tags": "red"}, "projection": {"pick": ["p_partkey"]}}, f"select p_partkey from {_TAGS} where list_contains(tags, 'red')")
    _find("array_in_any", _tags, {"query": {"tags": {"$in": ["red", "bolt"]}}, "projection": {"pick": ["p_partkey"]}}, f"select p_partkey from {_TAGS} where list_has_any(tags, ['red', 'bolt'])")
    _find("array_ne_none", _tags, {"query": {"tags": {"$ne": "red"}}, "projection": {"omit": ["tags"]}}, f"select p_partkey from {_TAGS} where not list_contains(tags, 'red')")
    _find("array_index_path", _tags, {"query": {"tags.0": "small"}, "projection": {"pick": ["p_partkey"]}}, f"select p_partkey from {_TAGS} where tags[1] = 'small'")
    _find("cross_type_gt", "events", {"query": {"event_type": {"$gt": 5}}, "projection": {"pick": ["event_id"]}}, "select event_id from events where event_type is not null")
    _find("cross_type_lt", "events", {"query": {"event_type": {"$lt": 5}}, "projection": {"pick": ["event_id"]}}, "select event_id from events where false")
    _find("null_eq_is_false", _opt, {"query": {"big": None}}, f"select * from {_OPT} where false")

    def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(_spec(spark, sf_dir), {"query": {"spec.size": {"$gt": 25}}}).select("p_partkey", F.col("spec.brand").alias("brand"))

    QUERIES["path_nested"], ORACLES["path_nested"] = nested, "select p_partkey, p_brand as brand from part where p_size > 25"


def _present_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty with the field and the first twenty without it."""
    rows = _opt(spark, sf_dir)
    return find(rows, {"sort": {"asc": "big"}, "sector": {"offset": rows.where("big is not null").count() - 20, "limit": 40}}, ("o_orderkey",))


def _shape() -> None:
    _find("sort_asc_limit", "events", {"sort": {"asc": "value"}, "sector": {"limit": 25}}, "select * from events order by value asc nulls last, event_id limit 25", ("event_id",))
    _find("sort_desc_offset_limit", "orders", {"sort": {"desc": "o_totalprice"}, "sector": {"offset": 20, "limit": 10}}, "select * from orders order by o_totalprice desc nulls last, o_orderkey limit 10 offset 20", ("o_orderkey",))
    _find("sort_missing_last", _opt, {"sort": {"desc": "big"}, "sector": {"offset": 5}}, f"select * from {_OPT} order by big desc nulls last, o_orderkey offset 5", ("o_orderkey",))
    QUERIES["sort_asc_missing_last"] = _present_and_missing
    ORACLES["sort_asc_missing_last"] = f"select * from {_OPT} order by big asc nulls last, o_orderkey limit 40 offset (select count(big) - 20 from {_OPT})"
    _find("sector_offset_limit", "events", {"sector": {"offset": 20, "limit": 10}}, "select * from events order by event_id limit 10 offset 20", ("event_id",))
    _find("sector_skips_matches", "events", {"query": {"event_type": "click"}, "sector": {"offset": 7, "limit": 30}}, "select * from events where event_type = 'click' order by event_id limit 30 offset 7", ("event_id",))
    _find("project_pick", "customer", {"projection": {"pick": ["c_name", "c_custkey", "none"]}}, "select c_custkey, c_name from customer")
    _find("project_omit", "customer", {"projection": {"omit": ["c_acctbal", "c_name"]}}, "select * exclude (c_acctbal, c_name) from customer")
    _find("project_empty_is_all", "nation", {"projection": {}}, "select * from nation")
    _find("find_full", "orders", FLAGSHIP, "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000 order by o_totalprice desc nulls last, o_orderkey limit 20 offset 5", ("o_orderkey",))


FLAGSHIP = {
    "query": {"o_orderstatus": "F", "o_totalprice": {"$gt": 1000}},
    "sort": {"desc": "o_totalprice"},
    "sector": {"offset": 5, "limit": 20},
    "projection": {"pick": ["o_orderkey", "o_totalprice"]},
}


def _update(name: str, source: str | Query, query: dict, program: object, sql: str, columns: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        out = update(df, {"query": query}, program, now=dt.datetime(2024, 1, 2, 3, 4, 5))
        return out.select(*columns) if columns else out

    QUERIES[name], ORACLES[name] = run, sql


def _writes() -> None:
    big = {"p_size": {"$gt": 40}}
    _update("update_set_literal", "part", big, {"$set": {"p_type": "HUGE"}}, "select * replace (case when p_size > 40 then 'HUGE' else p_type end as p_type) from part")
    _update("update_direct_assignment", "part", big, {"p_type": "HUGE"}, "select * replace (case when p_size > 40 then 'HUGE' else p_type end as p_type) from part")
    _update("update_unset", "part", big, {"$unset": "p_brand"}, "select * replace (case when p_size > 40 then null else p_brand end as p_brand) from part")
    _update("update_unset_many", "part", big, {"$unset": ["p_brand", "p_type", "nothing"]}, "select * replace (case when p_size > 40 then null else p_brand end as p_brand, case when p_size > 40 then null else p_type end as p_type) from part")
    _update("update_plus", "part", big, {"$set": {"p_size": {"$plus": ["$.p_size", 1, 2]}}}, "select * replace (case when p_size > 40 then (p_size + 1 + 2)::int else p_size end as p_size) from part")
    _update("update_minus", "customer", {"c_acctbal": {"$lt": 0}}, {"$set": {"c_acctbal": {"$minus": ["$.c_acctbal", 5, 2]}}}, "select * replace (case when c_acctbal < 0 then c_acctbal - 5 - 2 else c_acctbal end as c_acctbal) from customer")
    _update("update_concat", "part", {"p_size": 1}, {"$set": {"p_name": {"$concat": ["$.p_brand", " ", "$.p_name"]}}}, "select * replace (case when p_size = 1 then p_brand || ' ' || p_name else p_name end as p_name) from part")
    _update("update_field_ref", "part", big, {"label": "$.p_brand"}, "select *, case when p_size > 40 then p_brand end as label from part")
    _update("update_stage_isolation", "part", {}, {"$set": {"a": {"$plus": ["$.p_size", 1]}, "b": {"$plus": ["$.p_size", 2]}, "p_size": 0}}, "select p_partkey, (p_size + 1)::bigint as a, (p_size + 2)::bigint as b, 0 as p_size from part", ["p_partkey", "a", "b", "p_size"])
    _update("update_pipeline", "part", {"p_size": {"$lt": 20}}, {"0": {"p_size": {"$plus": ["$.p_size", 10]}}, "1": {"p_type": {"$concat": ["$.p_type", "-x"]}, "sum": {"$plus": ["$.p_size", 1]}}, "2": {"$unset": "p_brand"}}, "select p_partkey, case when p_size < 20 then p_type || '-x' else p_type end as p_type, case when p_size < 20 then p_size + 10 else p_size end::int as p_size, case when p_size < 20 then (p_size + 11)::bigint end as sum, case when p_size >= 20 then p_brand end as p_brand from part", ["p_partkey", "p_type", "p_size", "sum", "p_brand"])
    _update("update_nested_set", _spec, {"spec.size": {"$gt": 25}}, {"$set": {"spec.brand": "none", "spec.note": "$.spec.brand"}}, "select p_partkey, case when p_size > 25 then 'none' else p_brand end as brand, p_size as size, case when p_size > 25 then p_brand end as note from part", ["p_partkey", "spec.brand", "spec.size", "spec.note"])
    _update("update_nested_unset", _spec, {"spec.size": {"$gt": 25}}, {"$unset": "spec.brand"}, "select p_partkey, case when p_size <= 25 then p_brand end as brand, p_size as size from part", ["p_partkey", "spec.brand", "spec.size"])
    _update("update_literal_document", "nation", {"n_regionkey": 1}, {"doc": {"name": "$.n_name", "n": {"$minus": ["$.n_nationkey", 1]}}}, "select n_nationkey, case when n_regionkey = 1 then n_name end as name, case when n_regionkey = 1 then (n_nationkey - 1)::bigint end as n from nation", ["n_nationkey", "doc.name", "doc.n"])

    def moment(spark: SparkSession, sf_dir: str) -> DataFrame:
        program = {"at": {"$isoDateTime": {"$concat": ["2019-07-05T03:15:41", ".2068-03:30"]}}, "now": "$$now"}
        out = update(_table(spark, sf_dir, "orders"), {}, program, now=dt.datetime(2021, 9, 8, 7, 6, 5, 432000))
        return out.select("o_orderkey", F.unix_millis("at").alias("ms"), F.unix_millis("now").alias("now_ms"))

    QUERIES["update_iso_datetime"] = moment
    ORACLES["update_iso_datetime"] = "select o_orderkey, epoch_ms(timestamp '2019-07-05 06:45:41.206') as ms, epoch_ms(timestamp '2021-09-08 07:06:05.432') as now_ms from orders"

    def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = update(_table(spark, sf_dir, "nation"), {"query": {"n_regionkey": {"$lte": 2}}}, {"names": ["$.n_name", "and", {"$concat": ["$.n_name", "!"]}]})
        return out.select("n_nationkey", *[F.col("names")[k].alias(f"name{k}") for k in range(3)], F.size("names").alias("n"))

    QUERIES["update_literal_array"] = arrays
    ORACLES["update_literal_array"] = "select n_nationkey, case when n_regionkey <= 2 then n_name end as name0, case when n_regionkey <= 2 then 'and' end as name1, case when n_regionkey <= 2 then n_name || '!' end as name2, (case when n_regionkey <= 2 then 3 end)::int as n from nation"
    QUERIES["delete_matching"] = lambda s, d: delete(_table(s, d, "events"), {"query": {"event_type": "error"}})
    ORACLES["delete_matching"] = "select * from events where not coalesce(event_type = 'error', false)"


def _rest() -> None:
    QUERIES["index_multikey_entries"] = lambda s, d: multikey_entries(_tags(s, d), "tags").groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"))
    ORACLES["index_multikey_entries"] = f"select k, count(*) as n from (select unnest(list_distinct(tags)) as k from {_TAGS}) group by k"
    QUERIES["index_unique_violations"] = lambda s, d: unique_violations(_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    ORACLES["index_unique_violations"] = "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1"

    def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
        return resumed(_table(spark, sf_dir, "events"), {"query": {"value": {"$gt": 100}}}, "event_id", 77, "value", 250.5)

    QUERIES["cursor_resume"] = resume
    ORACLES["cursor_resume"] = "select * from events where value > 100 and (value > 250.5 or (value = 250.5 and event_id > 77))"

    def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
        gone = F.col("event_id") % 7 == 0
        log = _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seqno"), F.when(gone, "delete").otherwise("insert").alias("op"), F.when(~gone, F.struct("event_type")).alias("doc"))
        return filtered_events(log, {"query": {"event_type": "click"}}).select("seqno", "op", F.col("doc.event_type").alias("et"))

    QUERIES["subscribe_filtered"] = changes
    ORACLES["subscribe_filtered"] = "select * from (select event_id + 1 as seqno, case when event_id % 7 = 0 then 'delete' else 'insert' end as op, case when event_id % 7 <> 0 then event_type end as et from events) where coalesce(et = 'click', false) or et is null"


_leafs()
_shape()
_writes()
_rest()

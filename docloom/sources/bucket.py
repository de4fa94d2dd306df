"""Buckets: collections of documents with indexes, transactions and a change log.

A bucket is a folder of Parquet files and a list of versions, each naming the files that
hold its rows. A write makes new files and then one new version, so readers see all of it or
nothing, and a failed job leaves no trace but unnamed files. Updates and deletes rewrite only
the files that hold matching rows. Every row carries `_seq`, its place in the order of
insertion (an updated row moves to the end).

Typed buckets have a schema; documents without a common one go into a dynamic bucket as BSON.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom import errors as E
from docloom.functions.bson import decode, encode
from docloom.functions.values import ObjectId
from docloom.operators import dynamic as D
from docloom.operators.find import find, sliced
from docloom.operators.keys import MAX_KEY_BYTES, multikey_entries
from docloom.operators.predicates import predicate
from docloom.operators.update import apply_stage, now_utc
from docloom.plans.query import Cursor, Leaf, Logical, QuerySpec, parse_query
from docloom.plans.update import parse_program
from docloom.sources import state as V
from docloom.sources.files import Files, scratch
from docloom.streaming.feed import INLINE_BYTES

SEQ = "_seq"
_ROW_BITS = 33  # rows of one partition in monotonically_increasing_id
_SCORES = {"$eq": 100, "$in": 95, "$between": 85, "$lt": 80, "$lte": 80, "$gt": 80, "$gte": 80, "$startsWith": 70}


def object_ids() -> Column:
    """New ObjectIds for rows: the second, then a random start plus the row's number, spilling into the machine bytes."""
    base = int.from_bytes(uuid.uuid4().bytes[:7], "big")
    tail = (F.monotonically_increasing_id() + F.lit(base)).cast("long")
    hexed = F.concat(F.lpad(F.hex(F.lit(int(time.time()))), 8, "0"), F.lpad(F.hex(tail), 16, "0"))
    return F.unhex(hexed)


class Bucket:
    def __init__(self, spark: SparkSession, files: Files, state: V.State, memory: bool, oplog: bool, oplog_size: int, auto_vacuum: bool):
        self.spark, self.files, self.state = spark, files, state
        self.memory, self.oplog, self.oplog_size, self.auto_vacuum = memory, oplog and not memory, oplog_size, auto_vacuum and not memory
        self._open: Transaction | None = None

    # -- opening and reading --------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str = ":memory:", schema: T.StructType | str | None = None, oplog: bool = True, oplog_size: int = 1 << 20, auto_vacuum: bool = True) -> Bucket:
        """Opens a bucket, or creates one: typed if a schema is given, else of BSON documents. `:memory:` is private and keeps no change log."""
        memory = path == ":memory:"
        files = Files(spark, scratch(spark) if memory else path)
        state = V.load(files)
        if state is None:
            if isinstance(schema, str):
                schema = T._parse_datatype_string(schema)
            fields = schema.fields if schema is not None else [T.StructField("doc", T.BinaryType())]
            if "_id" not in [f.name for f in fields]:
                fields = [T.StructField("_id", T.BinaryType()), *fields]
            struct = T.StructType([*[f for f in fields if f.name != SEQ], T.StructField(SEQ, T.LongType())])
            state = V.State(dynamic=schema is None, schema=json.dumps(struct.jsonValue()), indexes={"_id": {"unique": True, "sparse": False, "reverse": False}})
            if not V.commit(files, state):
                state = V.load(files)
        bucket = cls(spark, files, state, memory, oplog, oplog_size, auto_vacuum)
        bucket._publish(state)
        return bucket

    def close(self) -> None:
        if self._open:
            self._open.rollback()

    def unlock(self) -> None:
        """Frees a version number that a writer claimed and then died; to be called only when no writer is at work."""
        self.refresh()
        for name in self.files.names(V.FOLDER):
            if name.endswith(".claim") and int(name.split(".")[0]) > self.state.version:
                self.files.delete(f"{V.FOLDER}/{name}")

    def refresh(self) -> None:
        """Goes to the newest version, which another writer may have made."""
        if self._open is None:
            self.state = V.load(self.files)

    def at(self, version: int) -> DataFrame:
        """The rows of an older version that vacuum() hasn't removed."""
        return self._rows(V.load(self.files, version))

    def _rows(self, state: V.State, files: list[str] | None = None) -> DataFrame:
        names = state.files if files is None else files
        if not names:
            # plain nulls of no row: the optimizer drops what is asked of them, where an empty list would start Python workers
            return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.struct.fields])
        return self.spark.read.schema(state.struct).parquet(*[self.files.full(n) for n in names])

    @property
    def df(self) -> DataFrame:
        """All rows with `_seq`; inside a transaction, as it sees them."""
        return self._rows(self._open.state if self._open else self.state)

    def count(self) -> int:
        return (self._open.state if self._open else self.state).doc_count

    def find(self, query: dict | None = None, read: Callable[[dict], Any] | None = None, returns: str = "binary") -> DataFrame:
        """The result of a query. Typed rows come as columns, others as a BSON column `doc` (see documents()), or what read() makes of each document, of type `returns`."""
        spec = parse_query(query or {})
        rows = self.df
        if spec.cursor is not None:
            rows, spec = self._past(rows, spec, query)
        if self.state.dynamic:
            return D.find_documents(rows, spec, SEQ, read, returns).select("doc")
        if read is not None:
            raise ValueError("read is for documents without a schema")
        return find(rows, spec, tie=(SEQ,), hidden=(SEQ,))

    def exists(self, query: dict | None = None) -> bool:
        """Whether any document matches."""
        return not self.find(query).isEmpty()

    def documents(self, query: dict | None = None) -> Iterator[dict]:
        """The result of a query as dicts, fetched by partition."""
        for row in self.find(query).toLocalIterator():
            yield decode(row["doc"]) if self.state.dynamic else row.asDict(recursive=True)

    # -- cursors --------------------------------------------------------------

    def _plan(self, spec: QuerySpec) -> str | None:
        """The path of the index a cursor follows, None for insertion order; refuses what has no single order."""
        if spec.sort or spec.has_sector:
            raise E.UnsupportedCursorQuery("sort or sector")
        best: tuple[int, str, str] = (0, "", "")

        def indexed(group: tuple) -> bool:
            return any(isinstance(f, Leaf) and f.path in self.state.indexes and f.op in _SCORES for f in group)

        def look(filters: tuple) -> None:
            nonlocal best
            for f in filters:
                if isinstance(f, Leaf):
                    if f.path in self.state.indexes and _SCORES.get(f.op, 0) > best[0]:
                        best = (_SCORES[f.op], f.op, f.path)
                elif f.op == "$and":
                    for g in f.groups:
                        look(g)
                elif f.groups and best[0] < (60 if f.op == "$or" else 50) and (all if f.op == "$or" else any)(map(indexed, f.groups)):
                    best = (60 if f.op == "$or" else 50, f.op, "")

        look(spec.filters)
        if best[1] in ("$in", "$or", "$nor"):
            raise E.UnsupportedCursorQuery(best[1])
        return best[2] or None

    def export_cursor(self, query: dict, last_id: Any = None) -> dict:
        """A cursor after the match with an _id, for the `cursor` section; without one, a cursor at the start."""
        path = self._plan(parse_query({k: v for k, v in query.items() if k != "cursor"}))
        out: dict = {"version": 1, "mode": "index_range" if path else "full_scan"} | ({"indexPath": path} if path else {})
        if last_id is not None:
            row = self._by_id(last_id).first()
            if row is None:
                raise E.InvalidCursor("no such document")
            out["anchor"] = {"_id": last_id}
        return out

    def _by_id(self, value: Any) -> DataFrame:
        leaf = (Leaf("$eq", "_id", value),)
        if self.state.dynamic:
            return self.df.where(F.col("_id") == F.lit(bytearray(encode({"_id": value}))))
        p = predicate(leaf, self.state.struct)
        return self.df.where(F.lit(p) if isinstance(p, bool) else p)

    def _past(self, rows: DataFrame, spec: QuerySpec, query: dict) -> tuple[DataFrame, QuerySpec]:
        cursor: Cursor = spec.cursor
        bare = QuerySpec(spec.filters, projection=spec.projection)
        path = self._plan(bare)
        if (cursor.mode == "index_range") != (path is not None) or cursor.index_path != path:
            raise E.UnsupportedCursorQuery("the query goes another way now")
        key = None
        if path is not None:
            key = D.key_column(path) if self.state.dynamic else F.col(".".join(f"`{p}`" for p in path.split(".")))
        if cursor.anchor is not None:
            anchor = self._by_id(cursor.anchor["_id"])
            at = anchor.select(F.col(SEQ).alias("s"), *([key.alias("k")] if key is not None else [])).first()
            if at is None:
                raise E.InvalidCursor("the anchor is gone")
            later = F.col(SEQ) > at["s"]
            if key is None:
                rows = rows.where(later)
            elif self.state.dynamic:
                k = F.lit(None) if at["k"] is None else F.struct(*[F.lit(bytearray(v) if isinstance(v, (bytes, bytearray)) else v).cast(t).alias(n) for (n, t), v in zip([x.split(":") for x in D.ORDER_KEY[7:-1].split(",")], at["k"], strict=True)])
                rows = rows.withColumn("__k", key).where((F.col("__k") > k) | ((F.col("__k") == k) & later)).drop("__k")
            else:
                rows = rows.where((key > F.lit(at["k"])) | ((key == F.lit(at["k"])) & later))
        order = [SEQ] if key is None else [key.asc_nulls_first(), F.col(SEQ)]
        return rows.orderBy(*order), bare

    # -- writing --------------------------------------------------------------

    def _apply(self, step: Callable[[V.State], tuple[V.State, Any]]) -> Any:
        if self._open is not None:
            raise E.TransactionActive("write through the transaction")
        self.refresh()
        new, result = step(self.state)
        self._commit(new)
        return result

    def _commit(self, new: V.State) -> None:
        if new is self.state:
            return
        new = self._retained(new.copy(version=self.state.version + 1))
        if not V.commit(self.files, new):
            raise E.TransactionActive("another writer has committed")
        self.state = new
        self._publish(new)

    def _publish(self, state: V.State) -> None:
        """Moves committed events to where streams look; repeated on opening, should a driver die between."""
        waiting = set(self.files.names("_pending"))
        for s in state.segments:
            if s.name in waiting:
                self.files.move(f"_pending/{s.name}", f"changes/{s.name}")

    def _retained(self, state: V.State) -> V.State:
        """Without segments that lie wholly outside the newest oplog_size events."""
        floor = state.seqno - self.oplog_size
        state.segments = [s for s in state.segments if s.last > floor]
        if floor > 0:
            state.oldest_seqno = max(state.oldest_seqno, state.segments[0].first if state.segments else state.seqno + 1)
        return state

    def _written(self, df: DataFrame, state: V.State) -> tuple[str, int, int]:
        """Writes rows; the folder, their number and the next free _seq."""
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*state.struct.names).write.parquet(self.files.full(folder))
        names = self.files.parts(folder)
        if not names:
            return folder, 0, state.next_seq
        n, last = self._rows(state, names).agg(F.count("*"), F.max(SEQ)).first()
        return folder, n, state.next_seq if last is None else max(state.next_seq, last + 1)

    def _log(self, state: V.State, op: str, rows: DataFrame, first_seq: int | None) -> None:
        """Adds an event for each row, in _seq order, to a state. first_seq: of rows numbered by a write, whose numbers are dense per partition."""
        if not self.oplog:
            return
        if first_seq is None:
            numbered = f"_pending/{uuid.uuid4().hex}.rows"
            rows.withColumn("__m", F.monotonically_increasing_id()).write.parquet(self.files.full(numbered))
            rows = self.spark.read.parquet(self.files.full(numbered))
        else:
            rows, numbered = rows.withColumn("__m", F.col(SEQ) - first_seq), None
        part = F.shiftright("__m", _ROW_BITS)
        counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
        total = sum(n for _, n in counts)
        if total:
            before, base = [], state.seqno
            for p, n in counts:
                before.append((p, base))
                base += n
            table = pa.table({"__p": pa.array([p for p, _ in before], pa.int64()), "__base": pa.array([b for _, b in before], pa.int64())})
            bases = F.broadcast(self.spark.createDataFrame(table))  # a row per written partition; an Arrow table needs no Python workers
            names = [n for n in state.struct.names if n not in (SEQ, *(["_id"] if state.dynamic else []))]
            doc = F.col("doc") if state.dynamic else F.struct(*names)
            size = F.octet_length(doc) if state.dynamic else F.octet_length(F.to_json(doc))
            inline = F.when((F.lit(op) != "delete") & (size <= INLINE_BYTES), doc)
            events = rows.withColumn("__p", part).join(bases, "__p").select(
                (F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).alias("seqno"),
                F.lit(op).alias("op"),
                F.col("_id").alias("doc_id"),
                F.lit(time.time_ns()).alias("ts"),
                inline.alias("doc"),
            )
            name = uuid.uuid4().hex
            events.write.parquet(self.files.full(f"_pending/{name}"))
            state.segments.append(V.Segment(name, state.seqno + 1, state.seqno + total))
            state.seqno += total
        if numbered:
            self.files.delete(numbered)

    def _check(self, state: V.State, old: DataFrame, new: DataFrame, touched: set[str] | None = None) -> None:
        """Unique and size rules of indexes for rows about to join others; of those alone that lie in touched fields, if given."""
        for path, index in state.indexes.items():
            if touched is not None and path.split(".")[0] not in touched:
                continue
            fresh = self._entries(state, new, path, index["sparse"])
            sizes = F.octet_length("key.bin") if state.dynamic else F.octet_length("key") if dict(fresh.dtypes)["key"] == "string" else None
            text = (F.col("key.rank") == 3) if state.dynamic else F.lit(True)
            if sizes is not None and not fresh.where(text & (sizes > MAX_KEY_BYTES)).isEmpty():
                raise E.KeyTooLong(path)
            if not index["unique"]:
                continue
            if not fresh.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                raise E.DuplicateKey(path)
            held = self._entries(state, old, path, index["sparse"])
            if not state.dynamic:
                # only old keys within the new ones' range can collide, so the reader skips the rest
                low, high, blank = fresh.agg(F.min("key"), F.max("key"), F.max(F.col("key").isNull())).first()
                inside = F.lit(False) if low is None else F.col("key").between(F.lit(low), F.lit(high))
                held = held.where(inside | F.col("key").isNull() if blank else inside)
            if not held.join(fresh.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left_semi").isEmpty():
                raise E.DuplicateKey(path)

    def _entries(self, state: V.State, rows: DataFrame, path: str, sparse: bool) -> DataFrame:
        return D.entry_keys(rows, path, sparse) if state.dynamic else multikey_entries(rows, path, sparse)

    def _frame(self, docs: DataFrame | Iterable[dict] | dict) -> DataFrame:
        """Rows to insert, without _seq."""
        if isinstance(docs, dict):
            docs = [docs]
        struct = self.state.struct
        if self.state.dynamic:
            if not isinstance(docs, DataFrame):
                docs = self.spark.createDataFrame([(bytearray(encode(d)),) for d in docs], "doc binary")
            return D.with_ids(docs)
        fields = T.StructType([f for f in struct.fields if f.name != SEQ])
        if not isinstance(docs, DataFrame):
            rows = [{k: v.raw if isinstance(v, ObjectId) else v for k, v in d.items()} for d in docs]
            unknown = {k for r in rows for k in r} - set(fields.names)
            if unknown:
                raise E.InvalidDocument(f"not in the schema: {sorted(unknown)}")
            docs = self.spark.createDataFrame([tuple(r.get(n) for n in fields.names) for r in rows], fields)
        columns = []
        for f in fields.fields:
            c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in docs.columns else F.lit(None).cast(f.dataType)
            if f.name == "_id" and isinstance(f.dataType, T.BinaryType):
                c = F.coalesce(c, object_ids())
            columns.append(c.alias(f.name))
        return docs.select(*columns)

    def _insert(self, state: V.State, docs: Any) -> tuple[V.State, int]:
        rows = self._frame(docs).withColumn(SEQ, F.lit(state.next_seq) + F.monotonically_increasing_id())
        folder, n, following = self._written(rows, state)
        if not n:
            return state, 0
        written = self._rows(state, self.files.parts(folder))
        self._check(state, self._rows(state), written)
        new = state.copy(files=[*state.files, *self.files.parts(folder)], doc_count=state.doc_count + n, next_seq=following)
        self._log(new, "insert", written, state.next_seq)
        return new, n

    def _matching(self, state: V.State, spec: QuerySpec, sector: bool) -> tuple[Column | bool, list[str]]:
        """A column that is true for the rows meant (never NULL), and the files that hold any."""
        rows = self._rows(state)
        if state.dynamic:
            match: Column | bool = D.match_column(spec.filters) if spec.filters else True
        else:
            match = predicate(spec.filters, state.struct)
        if match is False or not state.files:
            return False, []
        found = rows if match is True else rows.where(match)
        if sector and spec.has_sector:
            # the slice is of matches in insertion order; its rows are named by their _seq
            cut = sliced(found.select(SEQ).orderBy(SEQ), spec.offset, spec.limit)
            low, high = cut.agg(F.min(SEQ), F.max(SEQ)).first()
            if low is None:
                return False, []
            inside = F.col(SEQ).between(low, high)
            match = inside if match is True else inside & match
            found = rows.where(match)
        prefix = F.substring_index(F.col("_metadata.file_path"), "/", -3)
        held = {r[0] for r in found.select(prefix).distinct().collect()}  # at most a row per file
        names = [n for n in state.files if n in held]
        return (F.lit(True) if match is True else F.coalesce(match, F.lit(False))), names

    def _replaced(self, state: V.State, names: list[str], kept: DataFrame, fresh: DataFrame | None, touched: set[str] | None = None) -> tuple[V.State, int, DataFrame | None]:
        """A state in which rows `kept` and `fresh` stand for the rows of files `names`; the number of fresh rows and their frame."""
        folder, held, _ = self._written(kept, state)
        files = [n for n in state.files if n not in set(names)] + (self.files.parts(folder) if held else [])
        if fresh is None:
            return state.copy(files=files), 0, None
        numbered = fresh.withColumn(SEQ, F.lit(state.next_seq) + F.monotonically_increasing_id())
        extra, n, following = self._written(numbered, state)
        written = self._rows(state, self.files.parts(extra)) if n else None
        if written is not None:
            self._check(state, self._rows(state, files), written, touched)
            files = files + self.files.parts(extra)
        return state.copy(files=files, next_seq=following), n, written

    def _delete(self, state: V.State, query: dict) -> tuple[V.State, int]:
        match, names = self._matching(state, parse_query(query), sector=False)
        if not names:
            return state, 0
        rows = self._rows(state, names)
        gone = rows.where(match)
        n = gone.count()
        new, _, _ = self._replaced(state, names, rows.where(~match), None)
        new.doc_count, new.deleted_count = state.doc_count - n, state.deleted_count + n
        self._log(new, "delete", gone.orderBy(SEQ), None)
        return new, n

    def _update(self, state: V.State, query: dict, program: Any, now: dt.datetime | None) -> tuple[V.State, int]:
        stages, spec, now = parse_program(program), parse_query(query), now or now_utc()
        match, names = self._matching(state, spec, sector=True)
        if not names:
            return state, 0
        rows = self._rows(state, names)
        # insertion order of the old versions is the order of the new ones
        chosen = rows.where(match).orderBy(SEQ)
        if state.dynamic:
            changed = D.updated_documents(chosen, stages, now)
        else:
            changed = chosen
            for stage in stages:
                changed = apply_stage(changed, stage, True, now)
        target = state
        wider = [f for f in changed.schema.fields if f.name not in state.struct.names or state.struct[f.name].dataType != f.dataType]
        if wider:
            merged = [changed.schema[f.name] if f.name in changed.columns else f for f in state.struct.fields if f.name != SEQ]
            merged += [f for f in changed.schema.fields if f.name not in state.struct.names]
            struct = T.StructType([*[T.StructField(f.name, f.dataType) for f in merged], T.StructField(SEQ, T.LongType())])
            target = state.copy(schema=json.dumps(struct.jsonValue()))
        kept = self._rows(target, names).where(~match)
        touched = {step.path.split(".")[0] for stage in stages for step in stage}
        new, n, written = self._replaced(target, names, kept, changed, touched)
        new.deleted_count = state.deleted_count + n
        if written is not None:
            self._log(new, "update", self._rows(new, [f for f in new.files if f not in set(state.files)]).where(F.col(SEQ) >= state.next_seq), state.next_seq)
        return new, n

    def _transform(self, state: V.State, query: dict, change: Callable[[dict], dict | None]) -> tuple[V.State, int]:
        """Each match becomes what change() returns for it, or goes where that is None."""
        spec = parse_query(query)
        match, names = self._matching(state, spec, sector=True)
        if not names:
            return state, 0
        rows = self._rows(state, names)
        chosen, struct = rows.where(match).orderBy(SEQ), state.struct
        fields = [n for n in struct.names if n != SEQ]

        dynamic, names_out, target = state.dynamic, struct.names, to_arrow_schema(struct)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for record in batch.to_pylist():
                    seq = record.pop(SEQ)
                    old = decode(record["doc"]) if dynamic else {k: v for k, v in record.items() if v is not None}
                    new = change(dict(old))
                    if new is None:
                        continue
                    new = {"_id": old["_id"], **new} if "_id" not in new and "_id" in old else new
                    row = {"doc": encode(new), "_id": encode({"_id": new.get("_id")})} if dynamic else {n: new.get(n) for n in fields}
                    out.append(row | {SEQ: seq})
                yield from pa.Table.from_pylist(out, target).select(names_out).to_batches()

        # values stay as they are stored: no detour over floats, and NaN is a value
        changed = chosen.mapInArrow(run, struct)
        new, n, written = self._replaced(state, names, rows.where(~match), changed)
        before = chosen.count()
        new.doc_count, new.deleted_count = state.doc_count - before + n, state.deleted_count + before
        if written is not None:
            self._log(new, "update", written, state.next_seq)
        if n < before:
            left = chosen.join(written.select(F.col("_id").alias("_k")), F.col("_id") == F.col("_k"), "left_anti") if written is not None else chosen
            self._log(new, "delete", left, None)
        return new, before

    def insert(self, docs: DataFrame | Iterable[dict] | dict) -> int:
        """Adds documents (a DataFrame, dicts or one dict) in one version; all or, at a DuplicateKey, none."""
        return self._apply(lambda s: self._insert(s, docs))

    def delete(self, query: dict) -> int:
        """Removes all matches; sort and sector are ignored."""
        n = self._apply(lambda s: self._delete(s, query))
        self._tidy()
        return n

    def update(self, query: dict, program: Any, now: dt.datetime | None = None) -> int:
        """Puts matches (within the sector, in insertion order; sort is ignored) through a program; how many there were."""
        return self._apply(lambda s: self._update(s, query, program, now))

    def transform(self, query: dict, change: Callable[[dict], dict | None]) -> int:
        """Replaces each match by change(document), or removes it where that is None. An omitted _id is kept."""
        n = self._apply(lambda s: self._transform(s, query, change))
        self._tidy()
        return n

    def transform_iterator(self, query: dict) -> TransformIterator:
        return TransformIterator(self, query)

    def transaction(self) -> Transaction:
        return Transaction(self)

    # -- indexes and upkeep ---------------------------------------------------

    def ensure_index(self, path: str, unique: bool = False, sparse: bool = False, reverse: bool = False) -> None:
        """Enters an index; one on the same path stays as it is."""
        if not path or "" in path.split("."):
            raise E.InvalidQueryPath(path)

        def step(s: V.State) -> tuple[V.State, None]:
            if path in s.indexes:
                return s, None
            new = s.copy()
            new.indexes = {**s.indexes, path: {"unique": unique, "sparse": sparse, "reverse": reverse}}
            only = s.copy(indexes={path: new.indexes[path]})
            rows = self._rows(s)
            self._check(only, rows.where(F.lit(False)), rows)
            return new, None

        self._apply(step)

    def drop_index(self, path: str) -> None:
        def step(s: V.State) -> tuple[V.State, None]:
            if path not in s.indexes:
                raise E.IndexNotFound(path)
            return s.copy(indexes={k: v for k, v in s.indexes.items() if k != path}), None

        self._apply(step)

    def list_indexes(self) -> dict[str, dict]:
        return dict(self.state.indexes)

    def _tidy(self) -> None:
        if self.auto_vacuum and self.state.deleted_count > self.state.doc_count:
            self.vacuum()

    def vacuum(self) -> None:
        """Rewrites the rows into new files and removes what older versions alone hold. Nothing to do in memory."""
        if self.memory:
            return

        def step(s: V.State) -> tuple[V.State, None]:
            folder, n, _ = self._written(self._rows(s).repartitionByRange(F.col(SEQ)).sortWithinPartitions(SEQ), s)
            return s.copy(files=self.files.parts(folder) if n else [], deleted_count=0, generation=s.generation + 1), None

        self._apply(step)
        self.checkpoint()
        live = {n.split("/")[1] for n in self.state.files}
        for folder in self.files.names("data"):
            if folder not in live:
                self.files.delete(f"data/{folder}")

    def checkpoint(self) -> None:
        """Forgets older versions and change segments beyond the log's size."""
        for v in V.versions(self.files):
            if v < self.state.version:
                self.files.delete(V.name_of(v))
                self.files.delete(V.name_of(v) + ".claim")
        named = {s.name for s in self.state.segments}
        for name in self.files.names("changes"):
            if name not in named:
                self.files.delete(f"changes/{name}")

    def flush(self) -> None:
        """Writes are whole when they return."""

    def dump(self, path: str) -> None:
        """A copy of the rows and indexes as a bucket of its own, without a change log."""
        files = Files(self.spark, path)
        if files.exists(V.FOLDER):
            raise E.InvalidFormat(f"{path} is a bucket already")
        folder = f"data/{uuid.uuid4().hex}"
        self._rows(self.state).write.parquet(files.full(folder))
        V.commit(files, self.state.copy(version=0, generation=1, files=files.parts(folder), segments=[], seqno=0, oldest_seqno=1, deleted_count=0))

    # -- changes --------------------------------------------------------------

    @property
    def seqno(self) -> int:
        return self.state.seqno

    def event_schema(self) -> T.StructType:
        struct = self.state.struct
        doc = T.BinaryType() if self.state.dynamic else T.StructType([f for f in struct.fields if f.name != SEQ])
        return T.StructType([T.StructField("seqno", T.LongType()), T.StructField("op", T.StringType()), T.StructField("doc_id", struct["_id"].dataType), T.StructField("ts", T.LongType()), T.StructField("doc", doc)])

    def changes(self, after: int = 0) -> DataFrame:
        """Committed events past a seqno, as a table."""
        if not self.oplog:
            raise E.WalNotActive("this bucket keeps no change log")
        names = [s.name for s in self.state.segments if s.last > after]
        if not names:
            return self.spark.createDataFrame([], self.event_schema())
        return self.spark.read.schema(self.event_schema()).parquet(*[self.files.full(f"changes/{n}") for n in names]).where(F.col("seqno") > after)

    def subscribe(self, query: dict | None = None, after: int | None = None):
        """Events from now on (or past a seqno) whose documents match."""
        from docloom.streaming.subscription import Subscription

        return Subscription(self, query or {}, self.state.seqno if after is None else after)


class Transaction:
    """Writes that become one version on commit(). Reads through the bucket see them before."""

    def __init__(self, bucket: Bucket):
        if bucket._open is not None:
            raise E.TransactionActive("one at a time")
        bucket.refresh()
        self.bucket, self.state, self.done = bucket, bucket.state, False
        self._start = bucket.state.version
        bucket._open = self

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_: object) -> None:
        if not self.done:
            self.commit() if kind is None else self.rollback()

    def _do(self, step: Callable[[V.State], tuple[V.State, Any]]) -> Any:
        if self.done:
            raise E.InvalidTransaction("closed")
        self.state, result = step(self.state)
        return result

    def insert(self, docs: Any) -> int:
        return self._do(lambda s: self.bucket._insert(s, docs))

    def delete(self, query: dict) -> int:
        return self._do(lambda s: self.bucket._delete(s, query))

    def update(self, query: dict, program: Any, now: dt.datetime | None = None) -> int:
        return self._do(lambda s: self.bucket._update(s, query, program, now))

    def transform(self, query: dict, change: Callable[[dict], dict | None]) -> int:
        return self._do(lambda s: self.bucket._transform(s, query, change))

    def commit(self) -> None:
        if self.done:
            raise E.InvalidTransaction("closed")
        self.done, self.bucket._open = True, None
        self.bucket._commit(self.state)

    def rollback(self) -> None:
        if self.done:
            raise E.InvalidTransaction("closed")
        self.done, self.bucket._open = True, None

    close = rollback


class TransformIterator:
    """Matches one at a time: data() shows one, transform() replaces or removes it; close() commits all in one version."""

    def __init__(self, bucket: Bucket, query: dict):
        spec = parse_query(query)
        self.bucket, self.outcome = bucket, {}
        rows = bucket.df
        plain = QuerySpec(spec.filters, None, spec.offset, spec.limit)
        self._dynamic = bucket.state.dynamic
        found = D.find_documents(rows, plain, SEQ) if self._dynamic else find(rows, plain, tie=(SEQ,))
        self._rows = found.orderBy(SEQ).toLocalIterator()
        self._next()

    def _next(self) -> None:
        row = next(self._rows, None)
        self._row = None if row is None else row.asDict(recursive=True)

    def data(self) -> dict | None:
        if self._row is None:
            return None
        return decode(self._row["doc"]) if self._dynamic else {k: v for k, v in self._row.items() if k != SEQ and v is not None}

    def transform(self, new: dict | None) -> None:
        if self._row is None:
            raise E.IteratorDrained("no document left")
        key = self._row["_id"]
        self.outcome[bytes(key) if isinstance(key, (bytes, bytearray)) else key] = new
        self._next()

    def close(self) -> int:
        if not self.outcome:
            return 0
        outcome, self.outcome = self.outcome, {}
        dynamic = self._dynamic
        ids = [decode(k)["_id"] if dynamic else k for k in outcome]

        def change(doc: dict) -> dict | None:
            key = encode({"_id": doc["_id"]}) if dynamic else doc["_id"]
            return outcome[bytes(key) if isinstance(key, (bytes, bytearray)) else key]

        return self.bucket.transform({"query": {"_id": {"$in": ids}}}, change)

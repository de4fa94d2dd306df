"""Following a bucket: polls, streams, live tails and replicas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import errors as E
from docloom.functions.bson import decode
from docloom.operators.dynamic import match_column
from docloom.plans.query import parse_query
from docloom.sources import state as V
from docloom.sources.bucket import SEQ, Bucket
from docloom.sources.files import Files
from docloom.streaming.feed import filtered_events


def _passing(bucket: Bucket, events: DataFrame, query: dict) -> DataFrame:
    spec = parse_query(query)
    if bucket.state.dynamic:
        return events.where(F.coalesce(match_column(spec.filters), F.lit(False)) | F.col("doc").isNull()) if spec.filters else events
    return filtered_events(events, spec)


class Subscription:
    """Events after a position, in seqno order. Sort, sector and projection of the query play no part."""

    def __init__(self, bucket: Bucket, query: dict, position: int):
        if not bucket.oplog:
            raise E.WalNotActive("this bucket keeps no change log")
        self.bucket, self.query, self.position = bucket, query, position
        parse_query(query)

    @property
    def seqno(self) -> int:
        """The newest committed event's."""
        self.bucket.refresh()
        return self.bucket.seqno

    def poll(self, max_events: int = 1000) -> dict | None:
        """{"batch": [events]} of the next matches, at most max_events; None when there are none. OplogGap if events were lost."""
        self.bucket.refresh()
        if self.position and self.position + 1 < self.bucket.state.oldest_seqno:
            raise E.OplogGap("events between were dropped; subscribe again")
        rows = _passing(self.bucket, self.bucket.changes(self.position), self.query).orderBy("seqno").limit(max_events).collect()
        if len(rows) < max_events:
            self.position = max(self.position, self.bucket.seqno)
        else:
            self.position = rows[-1]["seqno"]
        return {"batch": [self._event(r.asDict(recursive=True)) for r in rows]} if rows else None

    def _event(self, row: dict) -> dict:
        out = {k: row[k] for k in ("seqno", "op", "doc_id", "ts")}
        if self.bucket.state.dynamic:
            out["doc_id"] = decode(out["doc_id"])["_id"]
        if row["doc"] is not None:
            out["doc"] = decode(row["doc"]) if self.bucket.state.dynamic else {k: v for k, v in row["doc"].items() if v is not None}
        return out


def event_stream(bucket: Bucket, query: dict | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Committed events as a streaming DataFrame, oldest kept first."""
    if not bucket.oplog:
        raise E.WalNotActive("this bucket keeps no change log")
    reader = bucket.spark.readStream.schema(bucket.event_schema())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _passing(bucket, reader.parquet(bucket.files.full("changes/*")), query or {})


class LiveTail:
    """Matches in insertion order; each poll brings those added since the last one."""

    def __init__(self, bucket: Bucket, query: dict | None = None):
        self.bucket, self.query, self.last = bucket, query or {}, -1

    def poll(self) -> list[dict]:
        self.bucket.refresh()
        dynamic = self.bucket.state.dynamic
        spec = parse_query(self.query)
        rows = self.bucket.df.where(F.col(SEQ) > self.last)
        if dynamic:
            rows = rows.where(match_column(spec.filters)) if spec.filters else rows
        else:
            from docloom.operators.find import find

            rows = find(rows, {"query": self.query.get("query", {})})
        got = [r.asDict(recursive=True) for r in rows.orderBy(SEQ).toLocalIterator()]
        self.last = max([self.last, *(r[SEQ] for r in got)])
        return [decode(r["doc"]) if dynamic else {k: v for k, v in r.items() if k != SEQ and v is not None} for r in got]


# -- replicas ------------------------------------------------------------------


def replication_cursor(bucket: Bucket) -> dict:
    return {"generation": bucket.state.generation, "version": bucket.state.version}


def read_batch(bucket: Bucket, cursor: dict, max_bytes: int = 1 << 40) -> dict | None:
    """The versions after a cursor whose new files hold at most max_bytes (one version at least); None if there are none."""
    bucket.refresh()
    if cursor["generation"] > bucket.state.generation or cursor["version"] > bucket.state.version:
        raise E.InvalidCursor("ahead of the source")
    if cursor["generation"] < bucket.state.generation:
        raise E.ReplicationGap("the source was rewritten; copy it anew")
    out, total = [], 0
    known = V.versions(bucket.files)
    if cursor["version"] < bucket.state.version and cursor["version"] + 1 not in known:
        raise E.ReplicationGap("versions between were dropped")
    before = set(V.load(bucket.files, cursor["version"]).files) if cursor["version"] in known else set()
    for v in range(cursor["version"] + 1, bucket.state.version + 1):
        state = V.load(bucket.files, v)
        size = sum(bucket.files.size(n) for n in state.files if n not in before)
        if out and total + size > max_bytes:
            break
        out.append(json.loads(state.dumps()))
        total += size
        before = set(state.files)
    return {"source": bucket.files.root, "generation": bucket.state.generation, "states": out} if out else None


def apply_batch(replica: Bucket, batch: dict) -> dict:
    """Copies a batch's files and takes over its versions; versions already there are passed over. The replica's new cursor."""
    source = Files(replica.spark, batch["source"])
    for raw in batch["states"]:
        state = V.State.loads(json.dumps(raw))
        replica.refresh()
        if state.version <= replica.state.version:
            if V.load(replica.files, state.version).dumps() != state.dumps():
                raise E.ReplicationGap("the replica has another history")
            continue
        if state.version != replica.state.version + 1:
            raise E.ReplicationGap("versions between are missing")
        for name in state.files:
            if not replica.files.exists(name):
                replica.files.copy_from(source, name)
        for s in state.segments:
            folder = f"changes/{s.name}"
            if not replica.files.exists(folder):
                for name in source.parts(folder):
                    replica.files.copy_from(source, name)
        if not V.commit(replica.files, state):
            raise E.ReplicationGap("another writer has committed to the replica")
        replica.refresh()
    return replication_cursor(replica)


def attach_replica(source: Bucket, path: str) -> Bucket:
    """A copy of a bucket at another path, at the source's present version, ready for apply_batch()."""
    files = Files(source.spark, path)
    source.refresh()
    for name in source.state.files:
        files.copy_from(source.files, name)
    for s in source.state.segments:
        for name in source.files.parts(f"changes/{s.name}"):
            files.copy_from(source.files, name)
    V.commit(files, source.state)
    return Bucket.open(source.spark, path)



"""Buckets on disk and in memory, typed and of BSON documents."""

import datetime as dt

import pytest
from docloom import errors as E
from docloom.functions.values import ObjectId
from docloom.sources.bucket import Bucket
from docloom.streaming.subscription import LiveTail, apply_batch, attach_replica, event_stream, read_batch, replication_cursor

PEOPLE = [{"name": "Alice", "age": 30, "scores": [5, 7]}, {"name": "Bob", "age": 40, "scores": [9]}, {"name": "Carol", "age": 50}, {"name": "Dora", "age": 35, "scores": [7]}]
SCHEMA = "name string, age int, scores array<int>"


def names(bucket, query):
    return sorted(d["name"] for d in bucket.documents(query))


@pytest.fixture(params=[SCHEMA, None], ids=["typed", "dynamic"])
def people(request, spark, tmp_path):
    bucket = Bucket.open(spark, f"file://{tmp_path}/b", schema=request.param)
    bucket.insert(PEOPLE)
    return bucket


def test_find(people):
    for query, expected in [
        ({"age": 30}, ["Alice"]),
        ({"name": {"$startsWith": "A"}}, ["Alice"]),
        ({"age": {"$gte": 35, "$lte": 40}}, ["Bob", "Dora"]),
        ({"age": {"$in": [30, 40]}}, ["Alice", "Bob"]),
        ({"$and": [{"age": {"$in": [30, 40]}}, {"name": {"$ne": "Bob"}}]}, ["Alice"]),
        ({"age": {"$between": [29, 38]}}, ["Alice", "Dora"]),
        ({"$nor": [{"age": 30}, {"age": 40}]}, ["Carol", "Dora"]),
        ({"scores": {"$in": [7]}}, ["Alice", "Dora"]),
        ({"scores": {"$notExists": 1}}, ["Carol"]),
    ]:
        assert names(people, {"query": query}) == expected, query
    assert [d["name"] for d in people.documents({"sort": {"desc": "age"}, "sector": {"offset": 1, "limit": 2}})] == ["Bob", "Dora"]
    assert [d["name"] for d in people.documents({"sector": {"offset": 2, "limit": 1}})] == ["Carol"]
    assert all(len(d) == 1 for d in people.documents({"projection": {"pick": ["name"]}}))
    assert people.count() == 4 and all(d["_id"] is not None for d in people.documents())


def test_update_delete_transform(people):
    program = {"0": {"age": {"$plus": ["$.age", 1]}}, "1": {"$unset": "scores"}}
    assert people.update({"query": {"age": {"$lt": 40}}}, program) == 2
    assert names(people, {"query": {"age": {"$in": [31, 36]}, "scores": {"$notExists": 1}}}) == ["Alice", "Dora"]
    # updated documents go to the end
    assert [d["name"] for d in people.documents({"sector": {"offset": 0}})] == ["Bob", "Carol", "Alice", "Dora"]
    assert people.update({"query": {}, "sector": {"offset": 1, "limit": 1}}, {"name": "Cora"}) == 1
    assert names(people, {}) == ["Alice", "Bob", "Cora", "Dora"]
    ids = {d["name"]: d["_id"] for d in people.documents()}
    assert people.transform({"query": {"age": {"$gte": 40}}}, lambda d: None if d["name"] == "Bob" else {"name": "Eve", "age": 1}) == 2
    after = {d["name"]: d["_id"] for d in people.documents()}
    assert sorted(after) == ["Alice", "Dora", "Eve"] and after["Eve"] == ids["Cora"]
    assert people.delete({"query": {"age": {"$lt": 30}}, "sector": {"limit": 0}}) == 1
    assert names(people, {}) == ["Alice", "Dora"]
    assert people.delete({"query": {"age": 99}}) == 0


def test_transform_iterator(people):
    it = people.transform_iterator({"query": {"age": {"$gte": 40}}})
    assert it.data()["name"] == "Bob"
    it.transform({"name": "Rob", "age": 41})
    it.transform(None)
    assert it.data() is None
    with pytest.raises(E.IteratorDrained):
        it.transform(None)
    it.close()
    assert names(people, {}) == ["Alice", "Dora", "Rob"]


def test_unique_and_indexes(people):
    people.ensure_index("name", unique=True)
    before = people.state.version
    with pytest.raises(E.DuplicateKey):
        people.insert([{"name": "New", "age": 1}, {"name": "Bob", "age": 2}])
    with pytest.raises(E.DuplicateKey):
        people.insert([{"name": "X", "age": 1}, {"name": "X", "age": 2}])
    with pytest.raises(E.DuplicateKey):
        people.update({"query": {"name": "Bob"}}, {"name": "Alice"})
    with pytest.raises(E.KeyTooLong):
        people.insert({"name": "x" * 257, "age": 1})
    assert people.state.version == before and people.count() == 4
    people.ensure_index("name")  # stays unique
    assert people.list_indexes()["name"]["unique"]
    people.drop_index("name")
    with pytest.raises(E.IndexNotFound):
        people.drop_index("name")
    people.insert({"name": "Bob", "age": 2})
    with pytest.raises(E.DuplicateKey):
        people.ensure_index("name", unique=True)
    # two documents without the field collide in an index that isn't sparse
    with pytest.raises(E.DuplicateKey):
        people.insert([{"name": "p"}, {"name": "q"}]) if people.ensure_index("age", unique=True) is None else None


def test_duplicate_id(spark, tmp_path):
    bucket = Bucket.open(spark, f"file://{tmp_path}/b")
    key = ObjectId("507c7f79bcf86cd7994f6c0e")
    bucket.insert({"_id": key, "name": "a"})
    with pytest.raises(E.DuplicateKey):
        bucket.insert({"_id": key, "name": "b"})
    bucket.insert({"_id": ObjectId("507c7f79bcf86cd7994f6c0f"), "name": "b"})
    assert names(bucket, {}) == ["a", "b"] and names(bucket, {"query": {"_id": key}}) == ["a"]


def test_transaction(people):
    feed = people.subscribe()
    other = Bucket.open(people.spark, people.files.root)
    with people.transaction() as tx:
        tx.insert({"name": "Zed", "age": 42})
        tx.update({"query": {"name": "Bob"}}, {"age": 41})
        with pytest.raises(E.TransactionActive):
            people.insert({"name": "no", "age": 1})
        with pytest.raises(E.TransactionActive):
            people.transaction()
        assert "Zed" in names(people, {}) and "Zed" not in names(other, {})
        assert feed.poll() is None
    other.refresh()
    assert "Zed" in names(other, {})
    assert [e["op"] for e in feed.poll()["batch"]] == ["insert", "update"]
    with pytest.raises(ZeroDivisionError), people.transaction() as tx:
        tx.delete({})
        raise ZeroDivisionError
    assert people.count() == 5
    with pytest.raises(E.InvalidTransaction):
        tx.insert({"name": "late"})


def test_subscription(people):
    feed = people.subscribe({"query": {"age": {"$gt": 60}}})
    people.insert([{"name": "Old", "age": 70}, {"name": "Young", "age": 7}, {"name": "Older", "age": 80}])
    people.delete({"query": {"name": "Young"}})
    batch = feed.poll()["batch"]
    assert [(e["op"], e.get("doc", {}).get("name")) for e in batch] == [("insert", "Old"), ("insert", "Older"), ("delete", None)]
    assert [e["seqno"] for e in batch] == sorted(e["seqno"] for e in batch) and feed.poll() is None
    assert feed.seqno == 8
    people.insert({"name": "Big" + "x" * 1100, "age": 1})  # too long to go inline, so it passes any filter
    assert "doc" not in feed.poll()["batch"][0]
    again = people.subscribe(after=4)
    assert [e["seqno"] for e in again.poll(2)["batch"]] == [5, 6] and [e["seqno"] for e in again.poll(2)["batch"]] == [7, 8]


def test_stream_and_gap(people, tmp_path):
    query = event_stream(people, {"query": {"age": {"$gte": 40}}}).writeStream.format("memory").queryName(f"events_{'d' if people.state.dynamic else 't'}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert people.spark.table(query.name).count() == 2
    feed = people.subscribe()
    people.oplog_size = 2
    for i in range(4):
        people.insert({"name": f"n{i}", "age": i})
    with pytest.raises(E.OplogGap):
        feed.poll()


def test_cursor(people):
    page = {"query": {"age": {"$gte": 35}}}
    people.ensure_index("age")
    first = next(people.documents(page | {"cursor": people.export_cursor(page)}))
    assert first["name"] == "Dora"
    cursor = people.export_cursor(page, first["_id"])
    assert cursor["mode"] == "index_range"
    assert [d["name"] for d in people.documents(page | {"cursor": cursor})] == ["Bob", "Carol"]
    people.insert({"name": "Fay", "age": 45})
    assert [d["name"] for d in people.documents(page | {"cursor": cursor})] == ["Bob", "Fay", "Carol"]
    scan = {"query": {"name": {"$exists": 1}}}
    bob = next(d for d in people.documents({"query": {"name": "Bob"}}))
    assert [d["name"] for d in people.documents(scan | {"cursor": people.export_cursor(scan, bob["_id"])})] == ["Carol", "Dora", "Fay"]
    for bad in ({"query": {"age": {"$in": [1]}}}, {"sort": {"asc": "age"}}, {"sector": {"limit": 1}}, {"query": {"$or": [{"age": 1}]}}):
        with pytest.raises(E.UnsupportedCursorQuery):
            people.export_cursor(bad)
    people.delete({"query": {"name": "Dora"}})
    with pytest.raises(E.InvalidCursor):
        people.find(page | {"cursor": cursor})


def test_vacuum_dump_memory(people, tmp_path):
    people.delete({"query": {"name": "Bob"}})
    generation = people.state.generation
    people.vacuum()
    assert people.state.generation == generation + 1 and people.state.deleted_count == 0 and names(people, {}) == ["Alice", "Carol", "Dora"]
    people.delete({"query": {"age": {"$lt": 40}}})
    assert people.state.generation == generation + 2  # more gone than left
    people.dump(f"file://{tmp_path}/copy")
    assert names(Bucket.open(people.spark, f"file://{tmp_path}/copy"), {}) == ["Carol"]
    memory = Bucket.open(people.spark, schema=None if people.state.dynamic else SCHEMA)
    memory.insert(PEOPLE)
    memory.vacuum()
    memory.dump(f"file://{tmp_path}/copy2")
    assert memory.count() == 4 and names(Bucket.open(people.spark, f"file://{tmp_path}/copy2"), {}) == ["Alice", "Bob", "Carol", "Dora"]
    with pytest.raises(E.WalNotActive):
        memory.subscribe()


def test_unlock(spark, tmp_path):
    bucket = Bucket.open(spark, f"file://{tmp_path}/b", schema=SCHEMA)
    claim = f"{tmp_path}/b/_versions/{bucket.state.version + 1:020d}.json.claim"
    open(claim, "w").close()
    with pytest.raises(E.TransactionActive):
        bucket.insert(PEOPLE[0])
    bucket.unlock()
    assert bucket.insert(PEOPLE[0]) == 1 and bucket.exists({"query": {"age": 30}}) and not bucket.exists({"query": {"age": 31}})


def test_live_tail(people):
    tail = LiveTail(people, {"query": {"age": {"$gte": 40}}})
    assert [d["name"] for d in tail.poll()] == ["Bob", "Carol"] and tail.poll() == []
    people.insert([{"name": "G", "age": 60}, {"name": "H", "age": 6}])
    assert [d["name"] for d in tail.poll()] == ["G"]


def test_replication(people, tmp_path):
    replica = attach_replica(people, f"file://{tmp_path}/r")
    cursor = replication_cursor(replica)
    people.insert([{"name": "M", "age": 1}, {"name": "N", "age": 2}])
    first = read_batch(people, cursor)
    people.delete({"query": {"name": "M"}})
    second = read_batch(people, replication_cursor(people) | {"version": people.state.version - 1})
    with pytest.raises(E.ReplicationGap):
        apply_batch(replica, second)
    apply_batch(replica, first)
    assert replica.count() == 6
    apply_batch(replica, first)
    cursor = apply_batch(replica, second)
    assert names(replica, {}) == names(people, {}) and replica.count() == 5 and read_batch(people, cursor) is None
    people.vacuum()
    with pytest.raises(E.ReplicationGap):
        read_batch(people, cursor)
    with pytest.raises(E.InvalidCursor):
        read_batch(people, {"generation": 99, "version": 0})


def test_mixed_documents(spark):
    bucket = Bucket.open(spark)
    docs = [{"v": x, "n": i} for i, x in enumerate([None, 1, 2.5, "s", True, [1, 2], {"k": 1}, dt.datetime(2024, 1, 1), ObjectId("507c7f79bcf86cd7994f6c0e")])] + [{"n": 9}]
    bucket.insert(docs)
    assert [d["n"] for d in bucket.documents({"sort": {"asc": "v"}})] == [0, 1, 2, 3, 6, 5, 8, 4, 7, 9]
    assert [d["n"] for d in bucket.documents({"sort": {"desc": "v"}})] == [7, 4, 8, 5, 6, 3, 2, 1, 0, 9]
    assert sorted(d["n"] for d in bucket.documents({"query": {"v": {"$gt": 2}}})) == [2, 3, 4, 5, 6, 7, 8]
    assert [d["n"] for d in bucket.documents({"query": {"v": None}})] == [0]
    bucket.update({"query": {"n": 6}}, {"v.k": {"$plus": ["$.v.k", 2147483647]}, "v.deep.er": "$.n"})
    assert next(bucket.documents({"query": {"n": 6}}))["v"] == {"k": 2147483648, "deep": {"er": 6}}

"""Queries and programs: parsing, meaning on one document, and columns that agree with it."""

import datetime as dt
import random

import pytest
from docloom import errors as E
from docloom.functions.bson import decode, encode, from_json
from docloom.functions.values import Binary, Double, Int32, Int64, MaxKey, MinKey, ObjectId, at_path, compare, equal, kind
from docloom.operators.dynamic import order_key
from docloom.operators.find import find
from docloom.operators.update import update
from docloom.plans.evaluate import apply_stages, iso_datetime, matches, project
from docloom.plans.query import parse_filters, parse_query
from docloom.plans.update import parse_program
from hypothesis import given, settings
from hypothesis import strategies as st

NOW = dt.datetime(2023, 11, 14, 22, 13, 20, 123000)


@pytest.mark.parametrize(
    ("query", "error"),
    [
        ({"query": 1}, E.InvalidQueryRoot),
        ({"query": {"f": {"$in": "x"}}}, E.InvalidInOperatorValue),
        ({"query": {"f": {"$startsWith": 42}}}, E.InvalidQueryOperatorParameter),
        ({"query": {"f": {"$endsWith": {"a": 1}}}}, E.InvalidQueryOperatorParameter),
        ({"query": {"good": 1, "bad": {"$nope": 2}}}, E.InvalidQueryOperator),
        ({"query": {"$or": [{"bad": {"$nope": 2}}]}}, E.InvalidQueryOperator),
        ({"query": {"a": {}}}, E.InvalidQueryOperator),
        ({"query": {"a": {"b": 1}}}, E.InvalidQueryOperator),
        ({"query": {"a": [1]}}, E.InvalidQueryFilter),
        ({"query": {"$or": 1}}, E.InvalidQueryFilter),
        ({"query": {"$or": [1]}}, E.InvalidQueryFilter),
        ({"query": {"": 1}}, E.InvalidQueryPath),
        ({"query": {"a": {"$between": [1]}}}, E.InvalidQueryOperatorBetweenSize),
        ({"query": {"a": {"$between": 1}}}, E.InvalidQueryOperatorParameter),
        ({"sort": 1}, E.InvalidQuerySort),
        ({"sort": {"up": "a"}}, E.InvalidQuerySort),
        ({"sort": {"asc": 42}}, E.InvalidQuerySortParamType),
        ({"sort": {"asc": ""}}, E.InvalidQueryPath),
        ({"sort": {"asc": "a", "desc": "b"}}, E.InvalidQuerySortParamLength),
        ({"sector": 1}, E.InvalidQuerySector),
        ({"sector": {"offset": -1}}, E.OffsetValueNegative),
        ({"sector": {"limit": -1}}, E.LimitValueNegative),
        ({"sector": {"limit": "1"}}, E.InvalidQueryOffset),
        ({"projection": {"data": 1}}, E.InvalidQueryProjection),
        ({"projection": {"pick": ["a"], "omit": ["b"]}}, E.InvalidQueryProjection),
        ({"projection": {"pick": "a"}}, E.InvalidQueryProjectionValue),
        ({"projection": {"pick": [1]}}, E.InvalidQueryProjectionValue),
        ({"projection": {"pick": [""]}}, E.InvalidQueryProjectionPath),
        ({"cursor": {"version": 2, "mode": "full_scan"}}, E.InvalidCursorVersion),
        ({"cursor": {"version": 1, "mode": "x"}}, E.InvalidCursorMode),
        ({"cursor": {"version": 1, "mode": "index_range"}}, E.MissingCursorIndexPath),
        ({"cursor": {"version": 1, "mode": "full_scan", "anchor": {}}}, E.InvalidCursorAnchor),
        ({"cursor": {"version": 1, "mode": "full_scan"}, "sort": {"asc": "a"}}, E.UnsupportedCursorQuery),
    ],
)
def test_query_errors(query, error):
    with pytest.raises(error):
        parse_query(query)


@pytest.mark.parametrize(
    ("program", "error"),
    [
        ({}, E.InvalidUpdateProgram),
        ({"0": 1}, E.InvalidUpdateStage),
        ({"0": {}}, E.InvalidUpdateStage),
        ({"$set": 1}, E.InvalidUpdateValue),
        ({"$unset": 1}, E.InvalidUpdateValue),
        ({"$unset": [1]}, E.InvalidUpdateValue),
        ({"$inc": {"a": 1}}, E.InvalidUpdateOperator),
        ({"a..b": 1}, E.InvalidUpdatePath),
        ({"$set": {".a": 1}}, E.InvalidUpdatePath),
        ({"a": "$."}, E.InvalidExpression),
        ({"a": {"$mul": [1, 2]}}, E.InvalidExpression),
        ({"a": {"$plus": [1]}}, E.InvalidExpressionArgumentCount),
        ({"a": {"$plus": 1}}, E.InvalidExpressionArgument),
        ({"a": {"$concat": []}}, E.InvalidExpressionArgumentCount),
    ],
)
def test_program_errors(program, error):
    with pytest.raises(error):
        parse_program(program)


def ran(program, document):
    return apply_stages(parse_program(program), document, NOW)


def test_programs():
    assert ran({"0": {"stock": {"$minus": ["$.stock", 4]}, "shelf": "empty"}, "1": {"$unset": ["supplier"]}}, {"sku": "K-9", "stock": 6, "supplier": {"id": 3}}) == {"sku": "K-9", "stock": 2, "shelf": "empty"}
    out = ran({"$set": {"line": {"$concat": ["$.city", ", ", "$.street", " 7"]}, "checked": "$$now", "due": {"$isoDateTime": "2031-01-31T19:45:00.025Z"}, "rest": {"$minus": [100, "$.used", 1]}}}, {"city": "Oslo", "street": "Havn", "used": 58})
    assert out["line"] == "Oslo, Havn 7" and out["checked"] == NOW and out["due"] == dt.datetime(2031, 1, 31, 19, 45, 0, 25000) and out["rest"] == 41
    assert kind(ran({"a": {"$plus": [2147483647, 1]}}, {})["a"]) == "int64" and kind(ran({"a": {"$plus": [1, 1]}}, {})["a"]) == "int32" and kind(ran({"a": {"$plus": [1, 1.0]}}, {})["a"]) == "double"
    assert ran({"a": "$.b.c", "b": {"c": 2, "d": ["$.b.c", {"e": "$.no"}]}}, {"b": {"c": 1}}) == {"b": {"c": 2, "d": [1, {"e": None}]}, "a": 1}
    assert ran({"a.b.c": 1, "x.0": 5, "s.t": 1}, {"s": 3}) == {"s": {"t": 1}, "a": {"b": {"c": 1}}, "x": [5]}
    assert ran({"$unset": ["a.b", "no.x", "_id", "s.t"]}, {"_id": 1, "a": {"b": 1, "c": 2}, "s": 3}) == {"_id": 1, "a": {"c": 2}, "s": 3}
    for program, error in [({"a": {"$plus": [9223372036854775807, 1]}}, E.IntegerOverflow), ({"a": {"$plus": ["x", 1]}}, E.InvalidExpressionArgument), ({"a": {"$concat": ["x", "$.no"]}}, E.InvalidExpressionArgument)]:
        with pytest.raises(error):
            ran(program, {})


ISO = ["2031-10-02T08:09:10.111Z", "2031-10-02t08:09:10z", "2031-10-02T08:09:10.1119+02:30", "1970-01-01T00:00:00Z", "2024-02-29T23:59:59-05:00", "2000-12-31T23:59:59.9Z"]
NOT_ISO = ["2031-10-02", "2024-02-30T00:00:00Z", "1969-12-31T23:59:59Z", "2031-10-02T08:09:10", "2031-10-02T24:00:00Z", "2031-10-02T08:09:60Z", "2031-10-02 08:09:10Z", "2031-10-02T08:09:10+24:00", "2031-10-02T08:09:10.Z", "1970-01-01T00:30:00+01:00", "x"]


def test_iso_columns(spark):
    rows = spark.createDataFrame([(s,) for s in ISO], "s string")
    got = [r.at.replace(tzinfo=None) for r in update(rows, {}, {"at": {"$isoDateTime": "$.s"}}).selectExpr("cast(at as timestamp_ntz) at").collect()]
    assert got == [iso_datetime(s) for s in ISO]
    for s in NOT_ISO:
        with pytest.raises(E.InvalidDateTime):
            iso_datetime(s)
        with pytest.raises(Exception, match="InvalidDateTime"):
            update(spark.createDataFrame([(s,)], "s string"), {}, {"at": {"$isoDateTime": "$.s"}}).collect()


def test_values():
    assert not equal(Int32(5), Int64(5)) and not equal(Int32(5), Double(5)) and compare(Int32(5), Int64(5)) == 0 == compare(Double(5), 5)
    assert equal([1, "x"], "x") and not equal([[1]], 1) and equal([1, 2], [1, 2]) and not equal({"a": 1}, {"a": 1}) and not equal(1, [1])
    assert compare("a", 5) == 1 and compare(None, 5) == -1 and compare({}, {"a": 1}) == 0 and compare(b"b", b"aa") == -1 and compare(MinKey, None) == -1 and compare(MaxKey, NOW) == 1
    document = {"items": ["x", 2, True, None, {"name": "n"}, [3]]}
    assert [at_path(document, p) for p in ("items.0", "items.1", "items.4.name", "items.5.0")] == ["x", 2, "n", 3]
    assert repr(at_path(document, "items.name")) == "MISSING" == repr(at_path(document, "items.0.x"))
    a, b = ObjectId(), ObjectId()
    assert a != b and len(str(a)) == 24 and ObjectId(str(a)) == a and abs(a.timestamp - dt.datetime.now().timestamp()) < 60


scalars = st.one_of(st.none(), st.booleans(), st.integers(-(1 << 63), (1 << 63) - 1), st.floats(allow_nan=False).map(Double), st.text(max_size=5), st.binary(max_size=5).map(Binary), st.just(MinKey), st.just(MaxKey), st.binary(min_size=12, max_size=12).map(ObjectId), st.datetimes(dt.datetime(1970, 1, 1), dt.datetime(2100, 1, 1)).map(lambda d: d.replace(microsecond=d.microsecond // 1000 * 1000)))
values = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), values, max_size=4))
def test_bson_round_trip(document):
    raw = encode(document)
    back = decode(raw)
    assert encode(back) == raw and list(back) == list(document)
    for cut in (raw[:-1], raw + b"\0", raw[:4]):
        with pytest.raises(E.InvalidDocument):
            decode(cut)


@settings(max_examples=200, deadline=None)
@given(scalars, scalars)
def test_order_key_sorts_as_values_do(a, b):
    exact = lambda x: not isinstance(x, int) or abs(x) < 1 << 53
    if exact(a) and exact(b):
        sort = lambda v: tuple((x is not None, x) for x in order_key(v).values())
        x, y = sort(a), sort(b)
        assert ((x > y) - (x < y)) == compare(a, b)


def test_json():
    assert kind(from_json(5)) == "int32" and kind(from_json(2.5)) == "double"
    with pytest.raises(E.InvalidDocument):
        from_json({"a": [1 << 31]})
    deep = {}
    for _ in range(101):
        deep = {"a": deep}
    with pytest.raises(E.InvalidDocument):
        encode(deep)


SCHEMA = "i int, l long, d double, s string, b boolean, x binary, t timestamp_ntz, tags array<string>, nums array<int>, o struct<a:int, s:string>"
PATHS = "i l d s b x t tags nums o o.a o.s tags.0 nums.1 none o.none s.x".split()
ROWS = [
    (1, 5, 1.5, "ab", True, b"ab", dt.datetime(2020, 1, 1), ["a", "b"], [1, 2], (1, "x")),
    (2, None, 5.0, "b", False, b"b", dt.datetime(2021, 1, 1), [], [5], (None, "ab")),
    (5, 1, None, "", None, b"", None, None, None, None),
    (None, 7, -1.0, None, True, None, dt.datetime(2020, 6, 1), ["ab"], [1, 1], (5, None)),
    (None, None, None, None, None, None, None, None, None, None),
]
OPERANDS = [1, 2, 5, 1.5, 5.0, "ab", "b", "", True, False, b"ab", b"b", dt.datetime(2020, 1, 1), None, "a", Int64(5), Double(5.0)]


def _document(row, fields):
    """A typed row as a document: NULL fields are missing, numbers have their column's kind."""
    kinds = {"i": Int32, "l": Int64, "d": Double}
    out = {}
    for name, value in zip(fields, row, strict=True):
        if value is None:
            continue
        if name == "o":
            value = {k: v if k == "s" else Int32(v) for k, v in zip(("a", "s"), value, strict=True) if v is not None}
        out[name] = kinds[name](value) if name in kinds else [Int32(v) for v in value] if name == "nums" else value
    return out


def _as_column_kind(path, value):
    """The evaluator's operand for a bare number compared with a typed column."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or isinstance(value, (Int32, Int64, Double)):
        return value
    to = {"i": Int32, "l": Int64, "d": Double, "nums": Int32, "nums.1": Int32, "o.a": Int32}.get(path)
    return to(value) if to and to(value) == value else value


def _random_filters(draw, depth=0):
    out = {}
    for _ in range(draw.randint(1, 2)):
        if depth < 2 and draw.random() < 0.35:
            out[draw.choice(["$and", "$or", "$nor"])] = [_random_filters(draw, depth + 1) for _ in range(draw.randint(0, 2))]
            continue
        path, op = draw.choice(PATHS), draw.choice("$eq $ne $lt $lte $gt $gte $in $between $startsWith $endsWith $exists $notExists".split())
        pick = lambda path=path: _as_column_kind(path, draw.choice(OPERANDS))
        operand = [pick() for _ in range(draw.randint(0, 3))] if op == "$in" else [pick(), pick()] if op == "$between" else draw.choice(["", "a", "b"]) if op.endswith("With") else pick()
        out[path] = {op: operand}
    return out


def test_columns_agree_with_the_evaluator(spark):
    draw = random.Random(7)
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    fields = df.columns
    documents = [_document(r, fields) for r in ROWS]
    cases = [_random_filters(draw) for _ in range(250)]
    from docloom.operators.predicates import predicate
    from pyspark.sql import functions as F

    flags = []
    for i, case in enumerate(cases):
        p = predicate(parse_filters(case), df.schema)
        flags.append((F.lit(p) if isinstance(p, bool) else F.coalesce(p, F.lit(False))).alias(f"c{i}"))
    got = [r for k in range(0, len(flags), 50) for r in [df.select(*flags[k : k + 50]).collect()]]
    for i, case in enumerate(cases):
        column = [row[i % 50] for row in got[i // 50]]
        assert column == [matches(parse_filters(case), d) for d in documents], case


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "id % 7 v").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")

    def plan(query):
        return find(df, query)._jdf.queryExecution().executedPlan().toString()

    text = plan({"query": {"v": {"$gt": 3}, "s": {"$startsWith": "4"}}, "projection": {"pick": ["s"]}})
    assert "GreaterThan(v,3)" in text and "StringStartsWith(s,4)" in text and "id:" not in text
    assert "Or(IsNull(v),Not(EqualTo(v,3)))" in plan({"query": {"$nor": [{"v": 3}]}}).replace(" ", "")
    assert "TakeOrderedAndProject" in plan({"sort": {"desc": "v"}, "sector": {"offset": 1, "limit": 3}})


def test_projection():
    spec = parse_query({"projection": {"pick": ["b", "zz"]}})
    assert project(spec.projection, {"a": 1, "b": 2}) == {"b": 2} and parse_query({"projection": {}}).projection is None
    assert project(parse_query({"projection": {"pick": []}}).projection, {"a": 1}) == {}


def test_typed_update(spark):
    df = spark.createDataFrame([(1, 2, "a", (1, "x")), (2, 2147483647, "b", None)], "k int, n int, s string, o struct<a:int, s:string>")
    out = {r.k: r for r in update(df, {"query": {"k": 1}}, {"0": {"n": {"$plus": ["$.n", 1]}, "o.a": "$.n", "new.deep": "$.s"}, "1": {"n": {"$plus": ["$.n", 1]}, "s": {"$concat": ["$.s", "!"]}}}).collect()}
    assert out[1].n == 4 and out[1].o == (2, "x") and out[1].new.deep == "a" and out[1].s == "a!" and out[2].new is None and out[2].s == "b"
    with pytest.raises(Exception, match="OVERFLOW"):
        update(df, {}, {"n": {"$plus": ["$.n", 1]}}).collect()
    with pytest.raises(E.InvalidExpressionArgument):
        update(df, {}, {"n": {"$plus": ["$.s", 1]}})
    with pytest.raises(Exception, match="InvalidExpressionArgument"):
        update(spark.createDataFrame([(None,)], "s string"), {}, {"s": {"$concat": ["$.s", "x"]}}).collect()

"""Reading query documents: {"query", "sort", "sector", "projection", "cursor"}; other sections are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from docloom import errors as E
from docloom.functions.values import ObjectId, kind

LEAVES = frozenset("$eq $ne $lt $lte $gt $gte $in $between $startsWith $endsWith $exists $notExists".split())
LOGICAL = frozenset("$and $or $nor".split())
_DIRECT = frozenset("string int32 int64 objectId datetime boolean null double".split())


@dataclass(frozen=True)
class Leaf:
    op: str
    path: str
    value: Any


@dataclass(frozen=True)
class Logical:
    op: str
    groups: tuple[tuple[Leaf | Logical, ...], ...]


Filter = Leaf | Logical


@dataclass(frozen=True)
class Sort:
    path: str
    ascending: bool


@dataclass(frozen=True)
class Projection:
    pick: bool
    fields: tuple[str, ...]

    def columns(self, names: list[str]) -> list[str]:
        """The names that stay, in their own order."""
        return [n for n in names if (n in self.fields) == self.pick]


@dataclass(frozen=True)
class Cursor:
    mode: str
    index_path: str | None = None
    anchor: dict | None = None


@dataclass(frozen=True)
class QuerySpec:
    filters: tuple[Filter, ...] = ()
    sort: Sort | None = None
    offset: int | None = None
    limit: int | None = None
    projection: Projection | None = None
    cursor: Cursor | None = None
    paths: frozenset[str] = field(default=frozenset(), compare=False)

    @property
    def has_sector(self) -> bool:
        return self.offset is not None or self.limit is not None


def _leaf(op: str, path: str, operand: Any) -> Leaf:
    if op not in LEAVES:
        raise E.InvalidQueryOperator(op)
    k = kind(operand)
    if op == "$in" and k != "array":
        raise E.InvalidInOperatorValue(path)
    if op in ("$startsWith", "$endsWith") and k != "string":
        raise E.InvalidQueryOperatorParameter(op)
    if op == "$between":
        if k != "array":
            raise E.InvalidQueryOperatorParameter(op)
        if len(operand) != 2:
            raise E.InvalidQueryOperatorBetweenSize(path)
    return Leaf(op, path, operand)


def parse_filters(document: Any) -> tuple[Filter, ...]:
    if not isinstance(document, dict):
        raise E.InvalidQueryRoot("query is a document")
    out: list[Filter] = []
    for path, value in document.items():
        if not path:
            raise E.InvalidQueryPath("empty path")
        k = kind(value)
        if path in LOGICAL:
            if k not in ("array", "document"):
                raise E.InvalidQueryFilter(path)
            groups = list(value.values()) if k == "document" else value
            if not all(isinstance(g, dict) for g in groups):
                raise E.InvalidQueryFilter(path)
            out.append(Logical(path, tuple(parse_filters(g) for g in groups)))
        elif k == "document":
            if not value:
                raise E.InvalidQueryOperator(path)
            out.extend(_leaf(op, path, operand) for op, operand in value.items())
        elif k in _DIRECT:
            out.append(Leaf("$eq", path, value))
        else:
            raise E.InvalidQueryFilter(path)
    return tuple(out)


def parse_sort(value: Any) -> Sort:
    if not isinstance(value, dict):
        raise E.InvalidQuerySort("sort is a document")
    if len(value) != 1:
        raise E.InvalidQuerySortParamLength("sort has one key")
    ((way, path),) = value.items()
    if not isinstance(path, str):
        raise E.InvalidQuerySortParamType(way)
    if not path:
        raise E.InvalidQueryPath("empty path")
    if way not in ("asc", "desc"):
        raise E.InvalidQuerySort(way)
    return Sort(path, way == "asc")


def _count(document: dict, name: str, negative: type[Exception]) -> int | None:
    if name not in document:
        return None
    value = document[name]
    if kind(value) not in ("int32", "int64", "double"):
        raise E.InvalidQueryOffset(name)
    if value < 0:
        raise negative(name)
    return int(value)


def parse_projection(value: Any) -> Projection | None:
    if not isinstance(value, dict):
        raise E.InvalidQueryProjection("projection is a document")
    if not value:
        return None
    if len(value) > 1 or next(iter(value)) not in ("pick", "omit"):
        raise E.InvalidQueryProjection("either pick or omit")
    ((mode, fields),) = value.items()
    if kind(fields) != "array" or not all(isinstance(f, str) for f in fields):
        raise E.InvalidQueryProjectionValue(mode)
    if not all(fields):
        raise E.InvalidQueryProjectionPath(mode)
    return Projection(mode == "pick", tuple(fields))


def parse_cursor(value: Any) -> Cursor:
    if not isinstance(value, dict):
        raise E.InvalidCursor("cursor is a document")
    if "version" not in value:
        raise E.InvalidCursorVersion("none")
    version = value["version"]
    if kind(version) not in ("int32", "int64", "double") or version < 0:
        raise E.InvalidCursor("version")
    if int(version) != 1:
        raise E.InvalidCursorVersion(str(version))
    mode = value.get("mode")
    if mode not in ("full_scan", "index_range"):
        raise E.InvalidCursorMode(str(mode))
    path = value.get("indexPath")
    if (path is None and (mode == "index_range" or "indexPath" in value)) or (path is not None and (not isinstance(path, str) or not path)):
        raise E.MissingCursorIndexPath(mode)
    anchor = value.get("anchor")
    if "anchor" in value:
        if not isinstance(anchor, dict) or "_id" not in anchor:
            raise E.InvalidCursorAnchor("anchor")
        if "docId" in anchor and not isinstance(anchor["docId"], ObjectId):
            raise E.InvalidCursorDocId("docId")
    return Cursor(mode, path, anchor)


def parse_query(document: dict) -> QuerySpec:
    """The checked form of a query document."""
    if not isinstance(document, dict):
        raise E.InvalidQueryRoot("a query is a document")
    projection = parse_projection(document["projection"]) if "projection" in document else None
    filters = parse_filters(document["query"]) if "query" in document else ()
    sort = parse_sort(document["sort"]) if "sort" in document else None
    offset = limit = None
    if "sector" in document:
        sector = document["sector"]
        if not isinstance(sector, dict):
            raise E.InvalidQuerySector("sector is a document")
        offset, limit = _count(sector, "offset", E.OffsetValueNegative), _count(sector, "limit", E.LimitValueNegative)
    cursor = parse_cursor(document["cursor"]) if "cursor" in document else None
    if cursor and (sort or offset is not None or limit is not None):
        raise E.UnsupportedCursorQuery("a cursor goes with neither sort nor sector")
    return QuerySpec(filters, sort, offset, limit, projection, cursor)

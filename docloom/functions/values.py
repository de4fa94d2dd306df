"""Document values: kinds, equality, order and paths.

A document is a dict, an array a list, null None. Python ints are 32-bit where they fit
and 64-bit otherwise; Int32, Int64 and Double fix a kind. Equality asks for one kind,
order ranks kinds first and compares all numbers by value.
"""

from __future__ import annotations

import datetime as dt
import os
import struct
import threading
import time
from typing import Any


class Int32(int):
    """A 32-bit integer."""


class Int64(int):
    """A 64-bit integer."""


class Double(float):
    """A 64-bit float."""


class _Key:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name

    def __reduce__(self) -> str:
        return self.name  # one object of the name in every process


MinKey, MaxKey = _Key("MinKey"), _Key("MaxKey")
MISSING = _Key("MISSING")


class Binary(bytes):
    """Bytes with a subtype."""

    subtype: int

    def __new__(cls, data: bytes = b"", subtype: int = 0) -> Binary:
        self = super().__new__(cls, data)
        self.subtype = subtype
        return self


class ObjectId:
    """Twelve bytes: seconds, machine, counter, all big-endian."""

    __slots__ = ("raw",)
    _lock = threading.Lock()
    _machine = os.urandom(5)
    _counter = int.from_bytes(os.urandom(3), "big")

    def __init__(self, value: bytes | str | None = None):
        if value is None:
            with ObjectId._lock:
                ObjectId._counter = (ObjectId._counter + 1) & 0xFFFFFF
                value = struct.pack(">I", int(time.time())) + self._machine + ObjectId._counter.to_bytes(3, "big")
        raw = bytes.fromhex(value) if isinstance(value, str) else bytes(value)
        if len(raw) != 12:
            raise ValueError("an ObjectId has 12 bytes")
        self.raw = raw

    @property
    def timestamp(self) -> int:
        return int.from_bytes(self.raw[:4], "big")

    def __str__(self) -> str:
        return self.raw.hex()

    def __repr__(self) -> str:
        return f"ObjectId('{self}')"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ObjectId) and self.raw == other.raw

    def __hash__(self) -> int:
        return hash(self.raw)


# Type tags of the BSON format by kind, and the rank of each kind in order.
TAGS = {"minKey": 0xFF, "null": 0x0A, "double": 0x01, "int32": 0x10, "int64": 0x12, "string": 0x02, "document": 0x03, "array": 0x04, "binary": 0x05, "objectId": 0x07, "boolean": 0x08, "datetime": 0x09, "maxKey": 0x7F}
RANKS = {"minKey": 0, "null": 1, "double": 2, "int32": 2, "int64": 2, "string": 3, "document": 4, "array": 5, "binary": 6, "objectId": 7, "boolean": 8, "datetime": 9, "maxKey": 10}


def kind(value: Any) -> str:
    """The kind of a value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Int64):
        return "int64"
    if isinstance(value, int):
        return "int32" if isinstance(value, Int32) or -(1 << 31) <= value < 1 << 31 else "int64"
    for types, name in ((float, "double"), (str, "string"), (dict, "document"), ((list, tuple), "array"), (ObjectId, "objectId"), ((bytes, bytearray), "binary"), (dt.datetime, "datetime")):
        if isinstance(value, types):
            return name
    if value is MinKey or value is MaxKey:
        return "minKey" if value is MinKey else "maxKey"
    raise TypeError(f"no document kind for {type(value).__name__}")


def milliseconds(value: dt.datetime) -> int:
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)


def _same(a: Any, b: Any) -> bool:
    """Equality of two values that are the same bytes when written."""
    k = kind(a)
    if k != kind(b):
        return False
    if k == "array":
        return len(a) == len(b) and all(map(_same, a, b))
    if k == "document":
        return list(a) == list(b) and all(_same(a[x], b[x]) for x in a)
    if k == "binary":
        return bytes(a) == bytes(b) and getattr(a, "subtype", 0) == getattr(b, "subtype", 0)
    return milliseconds(a) == milliseconds(b) if k == "datetime" else a == b or (k == "double" and a != a and b != b)


def equal(stored: Any, operand: Any) -> bool:
    """Whether a stored value equals an operand: documents never do, an array does if it or one of its scalar elements does."""
    if kind(stored) == "array" and kind(operand) not in ("array", "document"):
        return any(kind(x) not in ("array", "document") and _same(x, operand) for x in stored)
    return kind(stored) != "document" and _same(stored, operand)


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1. Ranks first; numbers by value (NaN above all, as in Spark); documents among themselves and arrays are level."""
    ka, kb = kind(a), kind(b)
    if RANKS[ka] != RANKS[kb]:
        return -1 if RANKS[ka] < RANKS[kb] else 1
    if ka in ("document", "array", "null", "minKey", "maxKey"):
        return 0
    if RANKS[ka] == 2:
        if "double" in (ka, kb):
            a, b = float(a), float(b)
            if a != a or b != b:
                return (a != a) - (b != b)
    elif ka == "binary":
        a, b = (len(a), getattr(a, "subtype", 0), bytes(a)), (len(b), getattr(b, "subtype", 0), bytes(b))
    elif ka == "objectId":
        a, b = a.raw, b.raw
    elif ka == "datetime":
        a, b = milliseconds(a), milliseconds(b)
    elif ka == "string":
        a, b = a.encode(), b.encode()
    return (a > b) - (a < b)


def at_path(document: Any, path: str) -> Any:
    """The value at a dotted path, MISSING where there is none. Numbers name array elements."""
    value = document
    for part in path.split("."):
        if isinstance(value, dict):
            value = value.get(part, MISSING)
        elif isinstance(value, (list, tuple)):
            value = value[int(part)] if part.isdecimal() and part == str(int(part)) and int(part) < len(value) else MISSING
        else:
            return MISSING
    return value

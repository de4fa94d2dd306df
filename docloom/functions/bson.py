"""BSON bytes of documents, for buckets of documents without a common schema."""

from __future__ import annotations

import datetime as dt
import struct
from typing import Any

from docloom.errors import InvalidDocument
from docloom.functions.values import TAGS, Binary, Double, Int32, Int64, MaxKey, MinKey, ObjectId, kind, milliseconds

MAX_DEPTH = 100
_EPOCH = dt.datetime(1970, 1, 1)
_NAMES = {t: n for n, t in TAGS.items()}


def _value(value: Any, depth: int) -> bytes:
    k = kind(value)
    if k == "double":
        return struct.pack("<d", value)
    if k == "string":
        raw = value.encode()
        return struct.pack("<i", len(raw) + 1) + raw + b"\0"
    if k in ("document", "array"):
        return encode(value if k == "document" else {str(i): x for i, x in enumerate(value)}, depth + 1)
    if k == "binary":
        return struct.pack("<iB", len(value), getattr(value, "subtype", 0)) + bytes(value)
    if k == "objectId":
        return value.raw
    if k == "boolean":
        return b"\1" if value else b"\0"
    if k == "datetime":
        ms = milliseconds(value)
        if ms < 0:
            raise InvalidDocument("dates before 1970 can't be stored")
        return struct.pack("<Q", ms)
    return {"int32": lambda: struct.pack("<i", value), "int64": lambda: struct.pack("<q", value)}.get(k, lambda: b"")()


def encode(document: dict, depth: int = 1) -> bytes:
    """The BSON form of a document."""
    if depth > MAX_DEPTH:
        raise InvalidDocument("nested too deeply")
    parts = []
    for key, value in document.items():
        raw = key.encode()
        if b"\0" in raw:
            raise InvalidDocument("a key holds a zero byte")
        parts.append(bytes([TAGS[kind(value)]]) + raw + b"\0" + _value(value, depth))
    body = b"".join(parts)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, end: int) -> bytes:
        if n < 0 or self.at + n > end:
            raise InvalidDocument("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def document(self, end: int, depth: int) -> dict:
        if depth > MAX_DEPTH:
            raise InvalidDocument("nested too deeply")
        start = self.at
        (size,) = struct.unpack("<i", self.take(4, end))
        stop = start + size
        if size < 5 or stop > end or self.data[stop - 1] != 0:
            raise InvalidDocument("bad length or terminator")
        out: dict = {}
        while self.at < stop - 1:
            tag = self.take(1, stop)[0]
            zero = self.data.find(b"\0", self.at, stop - 1)
            if zero < 0:
                raise InvalidDocument("key without end")
            key = self.data[self.at : zero].decode()
            self.at = zero + 1
            out[key] = self.value(tag, stop - 1, depth)
        self.at = stop
        return out

    def value(self, tag: int, end: int, depth: int) -> Any:
        name = _NAMES.get(tag)
        if name is None:
            raise InvalidDocument(f"type {tag:#x}")
        if name == "double":
            return Double(struct.unpack("<d", self.take(8, end))[0])
        if name == "int32":
            return Int32(struct.unpack("<i", self.take(4, end))[0])
        if name == "int64":
            return Int64(struct.unpack("<q", self.take(8, end))[0])
        if name == "string":
            (n,) = struct.unpack("<i", self.take(4, end))
            raw = self.take(n, end)
            if not raw or raw[-1]:
                raise InvalidDocument("string without end")
            return raw[:-1].decode()
        if name == "document":
            return self.document(end, depth + 1)
        if name == "array":
            return list(self.document(end, depth + 1).values())
        if name == "binary":
            n, subtype = struct.unpack("<iB", self.take(5, end))
            return Binary(self.take(n, end), subtype)
        if name == "objectId":
            return ObjectId(self.take(12, end))
        if name == "boolean":
            (b,) = self.take(1, end)
            if b > 1:
                raise InvalidDocument("boolean other than 0 and 1")
            return bool(b)
        if name == "datetime":
            return _EPOCH + dt.timedelta(milliseconds=struct.unpack("<Q", self.take(8, end))[0])
        return {"null": None, "minKey": MinKey, "maxKey": MaxKey}[name]


def decode(data: bytes) -> dict:
    """The document of BSON bytes; InvalidDocument where they are not one whole document."""
    reader = _Reader(bytes(data))
    try:
        out = reader.document(len(reader.data), 1)
    except (UnicodeDecodeError, OverflowError) as e:
        raise InvalidDocument(str(e)) from e
    if reader.at != len(reader.data):
        raise InvalidDocument("bytes after the document")
    return out


def from_json(value: Any) -> Any:
    """A parsed JSON value with integers checked to fit 32 bits and decimals as doubles."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        if not -(1 << 31) <= value < 1 << 31:
            raise InvalidDocument("integer beyond 32 bits")
        return Int32(value)
    if isinstance(value, float):
        return Double(value)
    return {k: from_json(v) for k, v in value.items()} if isinstance(value, dict) else [from_json(v) for v in value]

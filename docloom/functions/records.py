"""Python dataclasses as documents and back.

Enums are their names, unions of dataclasses single-key documents named by the class.
A class may bring `to_document()` and `from_document()` of its own.
"""

from __future__ import annotations

import dataclasses
import enum
import math
import types
import typing
from typing import Any

from docloom.errors import DocumentError, IntegerOverflow, InvalidFormat
from docloom.functions.values import Double, kind


class IntegerInvalid(DocumentError):
    """A number that is no integer."""


def to_document(value: Any) -> Any:
    """The document (or value) of a dataclass (or a member of one)."""
    if hasattr(value, "to_document"):
        return value.to_document()
    if dataclasses.is_dataclass(value):
        return {f.name: to_document(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, enum.Enum):
        return value.name
    if isinstance(value, dict):
        return {k: to_document(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_document(v) for v in value]
    return value


def _integer(value: Any) -> int:
    if kind(value) not in ("int32", "int64", "double"):
        raise InvalidFormat(f"{value!r} is no number")
    if isinstance(value, float):
        if math.isnan(value) or not (value.is_integer() or math.isinf(value)):
            raise IntegerInvalid(str(value))
        if not -(2.0**63) <= value < 2.0**63:
            raise IntegerOverflow(str(value))
    return int(value)


def from_document(target: Any, value: Any) -> Any:
    """A value of the target type; missing fields take their defaults, optional ones None."""
    if hasattr(target, "from_document"):
        return target.from_document(value)
    origin, args = typing.get_origin(target), typing.get_args(target)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if value is None and len(rest) < len(args):
            return None
        if len(rest) == 1:
            return from_document(rest[0], value)
        names = {a.__name__: a for a in rest if dataclasses.is_dataclass(a)}
        if isinstance(value, dict) and len(value) == 1 and next(iter(value)) in names:
            ((name, inner),) = value.items()
            return from_document(names[name], inner)
        if isinstance(value, str) and value in names:
            return names[value]()
        raise InvalidFormat(f"{value!r} is none of {sorted(names)}")
    if dataclasses.is_dataclass(target):
        if not isinstance(value, dict):
            raise InvalidFormat(f"{value!r} is no document")
        hints, out = typing.get_type_hints(target), {}
        for f in dataclasses.fields(target):
            if f.name in value:
                out[f.name] = from_document(hints[f.name], value[f.name])
            elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                if type(None) not in typing.get_args(hints[f.name]):
                    raise InvalidFormat(f"{f.name} is missing")
                out[f.name] = None
        return target(**out)
    if isinstance(target, type) and issubclass(target, enum.Enum):
        if value not in target.__members__:
            raise InvalidFormat(f"{value!r} is no {target.__name__}")
        return target[value]
    if origin in (list, tuple):
        if kind(value) != "array":
            raise InvalidFormat(f"{value!r} is no array")
        return origin(from_document(args[0], v) for v in value)
    if target is int:
        return _integer(value)
    if target is float:
        if kind(value) not in ("int32", "int64", "double"):
            raise InvalidFormat(f"{value!r} is no number")
        return Double(value)
    if isinstance(target, type) and not isinstance(value, target):
        raise InvalidFormat(f"{value!r} is no {target.__name__}")
    return value

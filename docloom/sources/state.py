"""One version of a bucket: which files hold its rows and its change log."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from docloom.sources.files import Files

FOLDER = "_versions"


@dataclass
class Segment:
    """Change events seqno first to last, written as one folder."""

    name: str
    first: int
    last: int


@dataclass
class State:
    version: int = 0
    generation: int = 1
    dynamic: bool = False
    schema: str = ""
    files: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    doc_count: int = 0
    deleted_count: int = 0
    next_seq: int = 0
    seqno: int = 0
    oldest_seqno: int = 1
    segments: list[Segment] = field(default_factory=list)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def copy(self, **changes) -> State:
        out = State.loads(self.dumps())
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> State:
        raw = json.loads(text)
        raw["segments"] = [Segment(**s) for s in raw["segments"]]
        return cls(**raw)


def name_of(version: int) -> str:
    return f"{FOLDER}/{version:020d}.json"


def versions(files: Files) -> list[int]:
    return [int(n[:-5]) for n in files.names(FOLDER) if n.endswith(".json")]


def load(files: Files, version: int | None = None) -> State | None:
    known = versions(files)
    if not known:
        return None
    return State.loads(files.read(name_of(known[-1] if version is None else version)))


def commit(files: Files, state: State) -> bool:
    """Makes a version the newest; False where another writer made it first."""
    return files.create(name_of(state.version), state.dumps())

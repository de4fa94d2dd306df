"""Exact token ids of whole texts by a public tokenizer, each distinct piece of text encoded once.

A byte-pair tokenizer never merges across the cuts of its pre-tokenizer. Texts
are cut at blanks where such a cut is certain, and a worker keeps the ids of
each distinct piece it has met, so the library sees every piece once and the
rest is array gathering. The result equals encode() of the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docloom.llm.textvec import Slice, range_hashes, slices
from docloom.llm.worker import keep

SLICE_BYTES = 1 << 18
TABLE_BITS = 21
CACHE_PIECES = 1_000_000
_SLOTS = np.uint64((1 << TABLE_BITS) - 1)
#: First bytes of code points among which Unicode has white space beyond ASCII.
_MAY_BLANK = np.zeros(256, bool)
_MAY_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _word_cuts(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokenizers that drop white space: pieces are the words."""
    return piece.words()


def _byte_cuts(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For byte-level tokenizers: cut before a lone space between visible bytes, and around a lone line feed between them."""
    buf, off = piece.buf, piece.offsets
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        seen = buf > 0x20
        between = seen[:-2] & seen[2:]
        cut[1 : n - 1] |= between & (buf[1:-1] == 0x20)
        feed = between & (buf[1:-1] == 0x0A) & ~_MAY_BLANK[buf[2:]]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        feed &= ~edge[1 : n - 1] & ~edge[2:n]
        cut[1 : n - 1] |= feed
        cut[2:n] |= feed
        # a space that begins or ends a text is cut off by the text's own bounds only
        cut[1 : n - 1] &= ~(edge[2:n] & (buf[1:-1] == 0x20))
    cut[off] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, off)


class _Growing:
    """An array that takes more values at its end; its room doubles, so values are seldom moved."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = values
        self.n = end


class Encoder:
    """Ids of texts, appended with one end id. A Python worker keeps one until a task of another kind runs."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        self.end_id = end_id
        if self.library.normalizer is None:
            self.cuts, separator, self.odd = _byte_cuts, "\n", _MAY_BLANK | (np.arange(256) <= 0x20)
        else:
            self.cuts, separator, self.odd = _word_cuts, " ~ ", np.arange(256) == ord("~")
        self.separator = np.frombuffer(separator.encode(), np.uint8)
        (self.separator_id,) = self.library.encode(separator, add_special_tokens=False).ids
        self._forget()

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return keep((path, end_id), lambda: cls(path, end_id))

    def _forget(self) -> None:
        """An empty open-addressing table: key and entry number per slot; entries hold where ids are and how many."""
        self.slot_key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot_entry = np.full(1 << TABLE_BITS, -1, np.int32)
        self.at, self.size, self.ids = _Growing(np.int64), _Growing(np.int32), _Growing(np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry numbers of keys, -1 where unknown."""
        slot = (keys & _SLOTS).astype(np.int64)
        entry = self.slot_entry[slot]
        astray = np.flatnonzero((entry >= 0) & (self.slot_key[slot] != keys))
        while len(astray):
            step = (slot[astray] + 1) & int(_SLOTS)
            slot[astray] = step
            got = self.slot_entry[step]
            entry[astray] = got
            astray = astray[(got >= 0) & (self.slot_key[step] != keys[astray])]
        return entry

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        slot = (keys & _SLOTS).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slot_entry[slot[todo]] < 0]
            self.slot_entry[slot[free]] = entries[free]  # of keys that want one slot the last stays
            won = free[self.slot_entry[slot[free]] == entries[free]]
            self.slot_key[slot[won]] = keys[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & int(_SLOTS)

    def _sizes_joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of many pieces encoded as a few long texts, a separator that encodes to one known id between them."""
        length = ends - starts + len(self.separator)
        to = np.cumsum(length) - length
        joined = np.tile(self.separator, int(length.sum()) // len(self.separator) + 1)[: int(length.sum())]
        within = np.arange(int((ends - starts).sum())) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        joined[np.repeat(to, ends - starts) + within] = data[np.repeat(starts, ends - starts) + within]
        tail = to + (ends - starts)
        for k, byte in enumerate(self.separator):
            joined[tail + k] = byte
        raw, step, flat = joined.tobytes(), 512, []
        bounds = [*to[::step].tolist(), len(raw)]
        texts = [raw[x:y].decode("utf-8") for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
            flat.append(np.array(e.ids, np.uint32))
        ids = np.concatenate(flat)
        stop = ids == self.separator_id
        if int(stop.sum()) != len(starts):
            return None
        return np.diff(np.flatnonzero(stop), prepend=-1) - 1, ids[~stop]

    def _learn(self, piece: Slice, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes unseen distinct pieces and enters them."""
        odd = np.concatenate([[0], np.cumsum(self.odd[piece.buf])])
        plain = odd[ends] == odd[starts + (piece.buf[starts] == 0x20)]
        done = self._sizes_joined(piece.buf, starts[plain], ends[plain]) if plain.any() else None
        if done is None:
            plain[:] = False
        rest = np.flatnonzero(~plain)
        data = piece.buf.tobytes() if len(rest) else b""
        texts = [data[a:b].decode("utf-8") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        each = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((x for e in each for x in e), np.uint32)
        size, at = np.empty(len(keys), np.int32), np.empty(len(keys), np.int64)
        size[rest] = np.fromiter(map(len, each), np.int64, len(each))
        at[rest] = len(self.ids) + np.cumsum(size[rest], dtype=np.int64) - size[rest]
        if done is not None:
            size[plain] = done[0]
            at[plain] = len(self.ids) + len(flat) + np.cumsum(done[0]) - done[0]
            flat = np.concatenate([flat, done[1]])
        self.ids.add(flat)
        self._insert(keys, np.arange(len(self.at), len(self.at) + len(keys), dtype=np.int32))
        self.at.add(at)
        self.size.add(size)

    def encode(self, piece: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts, end ids included, and the offsets of the texts among them."""
        starts, ends, bounds = self.cuts(piece)
        if len(starts):
            keys = range_hashes(piece.buf, starts, ends)
            if len(self.at) > CACHE_PIECES:
                self._forget()
            entry = self._find(keys)
            unknown = np.flatnonzero(entry < 0)
            for k in range(0, len(unknown), CACHE_PIECES):  # as many as the table takes, even of one very long text
                some = unknown[k : k + CACHE_PIECES]
                some = some[self._find(keys[some]) < 0]
                new, first = np.unique(keys[some], return_index=True)
                self._learn(piece, new, starts[some[first]], ends[some[first]])
            entry[unknown] = self._find(keys[unknown])
            at, size = self.at[entry], self.size[entry].astype(np.int64)
        else:
            at = size = np.zeros(0, np.int64)
        behind = np.concatenate([[0], np.cumsum(size)])
        offsets = behind[bounds] + np.arange(piece.n + 1)
        out = np.empty(int(offsets[-1]), np.uint32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        total = int(behind[-1])
        out[body] = self.ids[np.repeat(at - behind[:-1], size) + np.arange(total)]
        out[~body] = self.end_id
        return out, offsets


def encoded(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, ids, offsets) of each slice of a string column."""
    encoder = Encoder.of(path, end_id)
    for piece in slices(column, SLICE_BYTES):
        yield piece.first, *encoder.encode(piece)

"""Packing token sequences by the sum-of-squares rule.

Documents are taken in the order they come in a partition. What fills whole
windows is cut off at once; the rest, shorter than a window, goes to the fill
level h for which the sum over levels of (number of windows filled to that level) squared becomes
least, counted in a level array of `capacity` entries. At the end of a partition the
windows still open are drained: pieces of the emptiest fill up the fullest, cut
where needed, so one partition leaves at most one window short.

Partitions pack on their own, without a shuffle; sequence ids hold the partition's
number in their upper bits. Memory is the open windows (at most `capacity` levels, a few
windows each) plus one record batch. The result depends on the order of rows in a partition:
give a written table (as the queries do), so a task that runs again packs alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.tokenize import encoded

_ROWS = 4096


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total


class SumOfSquares:
    """Windows of one partition. add() and drain() yield finished windows, each a list of pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[_Piece]]] = [[] for _ in range(capacity + 1)]

    def add(self, piece: _Piece) -> Iterator[list[_Piece]]:
        cap, n = self.capacity, len(piece.ids)
        whole = n - n % cap
        for a in range(0, whole, cap):
            yield [_Piece(piece.doc, piece.start + a, piece.ids[a : a + cap], piece.total)]
        if n == whole:
            return
        rest = _Piece(piece.doc, piece.start + whole, piece.ids[whole:].copy(), piece.total)
        size = n - whole
        # the change of the sum when a window of level h becomes one of level h + size; new and full windows don't count
        after = self.level[size : cap + 1].copy()
        after[-1] = 0
        change = 2 * (after - self.level[: cap + 1 - size]) + 2
        change[-1] -= 1
        change[self.level[: cap + 1 - size] == 0] = 1 << 40
        change[0] = 2 * after[0] + 1
        h = int(change.argmin())
        if h:
            self.level[h] -= 1
            window = self.open[h].pop()
        else:
            window = []
        window.append(rest)
        if h + size == cap:
            yield window
        else:
            self.level[h + size] += 1
            self.open[h + size].append(window)

    def drain(self) -> Iterator[list[_Piece]]:
        rest = [(h, w) for h in range(self.capacity, 0, -1) for w in self.open[h]]
        fills, windows = [h for h, _ in rest], [w for _, w in rest]
        i, j = 0, len(rest) - 1
        while i < j:
            gap, last = self.capacity - fills[i], windows[j][-1]
            if len(last.ids) <= gap:
                windows[j].pop()
                moved = last
            else:
                moved = _Piece(last.doc, last.start, last.ids[:gap], last.total)
                windows[j][-1] = _Piece(last.doc, last.start + gap, last.ids[gap:], last.total)
            windows[i].append(moved)
            fills[i] += len(moved.ids)
            fills[j] -= len(moved.ids)
            if fills[i] == self.capacity:
                yield windows[i]
                i += 1
            if not fills[j]:
                j -= 1
        if i == j and windows[i]:
            yield windows[i]


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked.

    Null or empty text: only the end id. Null id: stays null. Rows that repeat an id are
    documents of their own. Empty table: empty result. Other columns don't matter.
    Sequences are padded to `capacity`, except at a power of two; only a partition's last one can be short.
    """
    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        packer, made, rows, ids = SumOfSquares(capacity), 0, [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32))))
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def put(window: list[_Piece]) -> None:
            nonlocal made
            at = 0
            for p in window:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids, "<u4")), p.total, first + made, at))
                if with_ids:
                    ids.append(p.ids)
                at += len(p.ids)
            made += 1

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, flat, offsets in encoded(batch.column(1), vocabulary, end_id):
                for i in range(len(offsets) - 1):
                    tokens = flat[offsets[i] : offsets[i + 1]]
                    for window in packer.add(_Piece(keys[k + i], 0, tokens, len(tokens))):
                        put(window)
                    if len(rows) >= _ROWS:
                        yield flush()
        for window in packer.drain():
            put(window)
        if rows:
            yield flush()

    return docs.selectExpr(f"cast(`{id_col}` as long) as `{id_col}`", f"`{text_col}`").mapInArrow(run, schema)

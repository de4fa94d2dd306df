"""Counts over whole texts, as arrays with one entry per text of a slice."""

from __future__ import annotations

import numpy as np

from docloom.llm.textvec import BLANK, Slice, mix, range_hashes, windows


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


SYMBOLS = _table("#*$%&|<>")
_UPPER, _LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT, _SHOUT, _BAR, _STOP, _COMMA = _table("0123456789"), _table("!?"), _table("|"), _table("."), _table(",;:")
_OTHER = _table("\"'()[]{}/\\@_^~`=+-")

FEATURES = (
    "log_words word_length upper symbols shout bars digits dup_lines repeat_words distinct_words lines stops commas blanks wide other top_word titled".split()
)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _of_text(piece: Slice, bounds: np.ndarray) -> np.ndarray:
    """The text of each item, for items counted by bounds."""
    return np.repeat(np.arange(piece.n), np.diff(bounds))


def _lines(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines that have a word, their texts, and the number of such lines per text."""
    buf, off = piece.buf, piece.offsets
    feed = np.flatnonzero(buf == 0x0A)
    starts = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], feed + 1]))
    starts = starts[starts < len(buf)]
    # empty texts share an offset with the next text; "right" gives the text that holds the byte
    text = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(np.append(feed, len(buf))[np.searchsorted(feed, starts)], off[text + 1])
    solid = np.concatenate([[0], np.cumsum(~BLANK[buf])])
    wordy = solid[ends] > solid[starts]
    starts, ends, text = starts[wordy], ends[wordy], text[wordy]
    return range_hashes(buf, starts, ends), text, np.bincount(text, minlength=piece.n)


def _keyed(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(keys + mix(text.astype(np.uint64) + np.uint64(1)))


def base_counts(piece: Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    buf, off = piece.buf, piece.offsets
    starts, ends, bounds = piece.words()
    out = {"n_words": np.diff(bounds)}
    out["word_chars"] = sums(((buf & 0xC0) != 0x80) & ~BLANK[buf], off)
    out["n_symbols"] = sums(SYMBOLS[buf], off)
    keys, text, out["n_lines"] = _lines(piece)
    _, first = np.unique(_keyed(keys, text), return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text[first], minlength=piece.n)
    words = piece.hashes(starts, ends, lower=False)
    spans = windows(words, 5)
    owner = _of_text(piece, bounds)
    marked = np.zeros(len(words) + 1, np.int64)
    if len(spans):
        inside = np.flatnonzero(owner[: len(spans)] == owner[4:])
        _, which, count = np.unique(_keyed(spans[inside], owner[inside]), return_inverse=True, return_counts=True)
        again = inside[count[which] > 1]
        np.add.at(marked, again, 1)
        np.add.at(marked, again + 5, -1)
    out["n_repeat_words"] = sums(np.cumsum(marked[:-1]) > 0, bounds)
    return out


def features(piece: Slice) -> np.ndarray:
    """Document statistics, one row per text, columns FEATURES. Empty texts: zeros but for none of them infinite."""
    buf, off = piece.buf, piece.offsets
    starts, ends, bounds = piece.words()
    base = base_counts(piece)
    n = np.maximum(base["n_words"], 1)
    size = np.maximum(np.diff(off), 1)
    owner = _of_text(piece, bounds)
    keys, first, count = np.unique(_keyed(piece.hashes(starts, ends), owner), return_index=True, return_counts=True)
    of = owner[first]
    distinct = np.bincount(of, minlength=piece.n)
    top = np.zeros(piece.n)
    np.maximum.at(top, of, count)
    letters = np.maximum(sums(_LETTER[buf], off), 1)

    def per_word(table: np.ndarray) -> np.ndarray:
        return sums(table[buf], off) / n

    columns = [
        np.log1p(base["n_words"]),
        base["word_chars"] / n,
        sums(_UPPER[buf], off) / letters,
        np.sqrt(base["n_symbols"] / n),
        np.sqrt(per_word(_SHOUT)),
        np.sqrt(per_word(_BAR)),
        np.sqrt(per_word(_DIGIT)),
        base["n_dup_lines"] / np.maximum(base["n_lines"], 1),
        base["n_repeat_words"] / n,
        distinct / n,
        np.sqrt(base["n_lines"] / n),
        np.sqrt(per_word(_STOP)),
        np.sqrt(per_word(_COMMA)),
        sums(BLANK[buf], off) / size,
        sums((buf & 0xC0) == 0xC0, off) / letters,
        np.sqrt(per_word(_OTHER)),
        top / n,
        sums(_UPPER[buf[starts]] if len(starts) else np.zeros(0, bool), bounds) / n,
    ]
    return np.stack(columns, 1).astype(np.float32)

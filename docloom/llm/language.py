"""Language identification by a bit-sliced Bloom filter of n-grams.

One filter serves all languages: every slot holds a bit mask of languages, and the
masks of an n-gram's slots, and-ed, tell which languages have the n-gram. A text's n-grams
are looked up at once; the share found per language, less what false positives alone
would give, decides.

An n-gram is a run of 3 or 5 bytes of the text with letters in lower case and all else
blank. A language has an n-gram when the sample has it `least` times and its rate there is at
least `contrast` of the highest rate in any language. The filter is fitted on at most
`rows_per_language` labelled rows of each language, chosen by a hash of the id; its size is
fixed by `bits`, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.lineage import unused
from docloom.llm.textvec import LOWER, Slice, mix, plain_column, slices
from docloom.llm.worker import fresh

WIDTHS = (3, 5)
_SLICE_BYTES = 1 << 16  # the arrays of a slice stay in a core's cache
_LETTERLIKE = np.zeros(256, bool)
_LETTERLIKE[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def letters(piece: Slice) -> np.ndarray:
    """The bytes in lower case (A-Z and Latin-1 capitals), all but letters and bytes over 0x7F blank."""
    b = LOWER[piece.buf]
    if len(b) > 1:
        capital = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][capital] += 0x20
    return np.where(_LETTERLIKE[b], b, np.uint8(0x20))


def ngrams(piece: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width, hashes of a slice's n-grams in order, and for each text the index of its first one (one more than texts).

    No n-gram crosses texts or has two blanks together.
    """
    b = letters(piece)
    wide = b.astype(np.uint64)
    gap = (b[:-1] == 0x20) & (b[1:] == 0x20)
    inner = piece.offsets[1:-1]
    gap[inner[(inner > 0) & (inner < len(b))] - 1] = True
    crossed = np.concatenate([[0], np.cumsum(gap)])
    for width in WIDTHS:
        n = len(b) - width + 1
        if n <= 0:
            yield np.zeros(0, np.uint64), np.zeros(piece.n + 1, np.int64)
            continue
        packed = np.full(n, width, np.uint64)
        for k in range(width):
            packed <<= np.uint64(8)
            packed |= wide[k : k + n]
        whole = crossed[width - 1 : width - 1 + n] == crossed[:n]
        before = np.concatenate([[0], np.cumsum(whole)])
        yield mix(packed[whole]), before[np.minimum(piece.offsets, n)]


def slots_of(gram: np.ndarray, hashes: int, size: int) -> Iterator[np.ndarray]:
    """The slots of n-grams, by double hashing; size is a power of two."""
    step = (gram >> np.uint64(32)) | np.uint64(1)
    for k in range(hashes):
        yield ((gram + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


# bits 0 and 1 of a number come to bits 0 and 32
_SPREAD, _LANES = np.uint64((1 << 31) + 1), np.uint64((1 << 32) + 1)


class BloomMasks:
    """Slots of language masks; languages in code point order, 64 to a word."""

    def __init__(self, languages: list[str], counts: list[int], masks: np.ndarray, hashes: int):
        self.languages, self.hashes = languages, hashes
        # no wider than the languages need, and word after word: what is looked up at random stays small
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(64, len(languages)))
        self.masks = np.asfortranarray(masks.astype(width))
        self.prior = int(np.argmax(counts)) if counts else -1
        size = len(masks)
        fill = [((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum() / size for k in range(len(languages))]
        self.false_rate = np.clip(np.array(fill) ** hashes, 0, 0.95)

    def shares(self, piece: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Corrected shares (texts x languages) and the number of n-grams of each text."""
        total, found = np.zeros(piece.n), np.zeros((piece.n, len(self.languages)))
        for gram, bounds in ngrams(piece):
            total += np.diff(bounds)
            words: list[np.ndarray] = [np.zeros(0)] * self.masks.shape[1]
            for first, slot in enumerate(slots_of(gram, self.hashes, len(self.masks))):
                for w in range(len(words)):
                    words[w] = words[w] & self.masks[slot, w] if first else self.masks[slot, w]
            for k in range(0, len(self.languages), 2):
                # two languages' bits to one sum, 32 bits each: differences stay right though the sums wrap around
                two = (words[k // 64].astype(np.uint64) >> np.uint64(k % 64)) & np.uint64(3)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((two * _SPREAD) & _LANES)])
                got = sums[bounds[1:]] - sums[bounds[:-1]]
                found[:, k] += got & np.uint64(0xFFFFFFFF)
                if k + 1 < len(self.languages):
                    found[:, k + 1] += got >> np.uint64(32)
        share = found / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1), total


def _count(languages: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([languages[x] for x in batch.column(0).to_pylist()], np.uint64)
            for piece in slices(batch.column(1)):
                for gram, bounds in ngrams(piece):
                    lang = np.repeat(code[piece.first : piece.first + piece.n], np.diff(bounds))
                    for k in np.unique(lang).tolist():
                        value, n = np.unique(gram[lang == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return run


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 4000, bits: int = 21, hashes: int = 3, least: int = 2, contrast: float = 0.1
) -> BloomMasks:
    """The filter of labelled rows with text and language; others are left out. Languages (a few) are listed on the driver."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    names = [x for x, _ in sizes]
    words = max(1, -(-len(names) // 64))
    masks = np.zeros((1 << bits, words), np.uint64)
    if names:
        share = F.create_map(*[F.lit(v) for x, n in sizes for v in (x, min(1.0, rows_per_language / n))])
        chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(1 << 20))
        counted = chosen.select("lang", "text").mapInArrow(fresh(_count({x: k for k, x in enumerate(names)})), "lang int, gram long, n long")
        counted = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
        total = F.create_map(*[F.lit(v) for k, (_, n) in enumerate(sizes) for v in (k, float(max(1, min(n, rows_per_language))))])
        counted = counted.where(F.col("n") >= least).withColumn("rate", F.col("n") / total[F.col("lang")])
        top = F.collect_list(F.struct("lang", "rate"))
        grams = counted.groupBy("gram").agg(top.alias("x"), F.max("rate").alias("most"))
        grams = grams.select("gram", F.transform(F.filter("x", lambda s: s["rate"] >= F.lit(contrast) * F.col("most")), lambda s: s["lang"]).alias("langs"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gram = batch.column(0).to_numpy().view(np.uint64)
                lists = batch.column(1)
                of = np.repeat(np.arange(len(gram)), np.diff(lists.offsets.to_numpy()))
                lang = lists.values.to_numpy()[lists.offsets[0].as_py() :][: len(of)]
                for slot in slots_of(gram, hashes, 1 << bits):
                    yield pa.RecordBatch.from_arrays([pa.array(slot[of]), pa.array(lang // 64), pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "mask"])

        placed = grams.mapInArrow(fresh(place), "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        masks[placed["slot"].to_numpy(), placed["word"].to_numpy()] = placed["mask"].to_numpy().view(np.uint64)
    return BloomMasks(names, [n for _, n in sizes], masks, hashes)


def identify(docs: DataFrame, model: BloomMasks, id_col: str = "doc_id", text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """One row per input row: the columns of `keep` (the id), lang_pred and score.

    lang_pred is `und`, with score 0, for a null text, a text without a letter and where nothing was learned; score is
    the winner's part of all languages' shares. A text with letters too short for an n-gram gets the commonest language.
    Ties go to the first language in code point order. Repeated rows and null ids: each row by itself. Empty table: empty result.
    Kept columns may have any names but those of the two results, which are refused.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(keep or [id_col]))
    fields = [f.name for f in kept.schema.fields]
    if clash := {f.lower() for f in fields} & {"lang_pred", "score"}:
        raise ValueError(f"columns named like the results: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = plain_column(batch.column(len(fields)))
            for piece in slices(texts, _SLICE_BYTES):
                share, total = model.shares(piece) if model.languages else (np.zeros((piece.n, 1)), np.zeros(piece.n))
                best = share.argmax(1)
                score = share[np.arange(piece.n), best] / np.maximum(share.sum(1), 1e-12)
                none = share.max(1) <= 0
                best[none], score[none] = model.prior, 1.0 / max(1, len(model.languages))
                ascii_letters = np.concatenate([[0], np.cumsum(_LETTERLIKE[LOWER[piece.buf]] & (piece.buf < 0x80))])[piece.offsets]
                und = np.diff(ascii_letters) == 0
                for i in np.flatnonzero(und).tolist():
                    und[i] = not any(c.isalpha() for c in texts[piece.first + i].as_py())
                names = ["und" if u or not model.languages else model.languages[b] for u, b in zip(und.tolist(), best.tolist(), strict=True)]
                score[np.array([x == "und" for x in names], bool)] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(piece.first, piece.n) for k in range(len(fields))], pa.array(names, pa.string()), pa.array(score)], [*fields, "lang_pred", "score"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select(*(keep or [id_col]), F.col(text_col).alias(unused(kept, "text"))).mapInArrow(fresh(run), f"{schema}, lang_pred string, score double")


def of_a_language(docs: DataFrame, model: BloomMasks, text_col: str = "text") -> DataFrame:
    """The rows of docs that have a language (lang_pred is not `und`), with their columns, whatever their names."""
    whole = unused(docs, "row")
    judged = identify(docs, model, text_col=text_col, keep=[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole)])
    return judged.where("lang_pred != 'und'").select(*[F.col(whole)[c].alias(c) for c in docs.columns])

"""Quality rules: fixed limits on counts, then perplexity bands under a modified Kneser-Ney model.

The model is one of byte n-grams, order 6 over all 256 bytes, case and scripts as they are. Every
text is counted: tasks ship their distinct n-grams, Spark sums them, and nothing caps the table,
so it grows with what the corpus holds. Each order is a table in the shared folder, cut into ranges of
contexts: n-grams ascending, with their discounted probability and the weight their context leaves
to the next lower order. It is neither collected nor broadcast: tasks gather the distinct n-grams
of some 8 MB of texts and look them up range by range, holding one range at a time.

Bands: for each language (of the language column) and class of length (powers of two of the
number of n-grams, as short texts vary more) the median m of the log perplexities of texts that pass the
base rules and their median deviation d from it give [m - low_width * d, m + high_width * d], both widths
times 1 + 7 / sqrt(texts), as few texts tell d badly. Up to half of a class may be junk without moving m
and d much. Classes of under 50 texts take their language's band. The lower width is the larger: families of copies
are clean and predict each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.lineage import staged
from docloom.llm.textstats import base_counts, sums
from docloom.llm.textvec import Slice, mix, slices
from docloom.llm.worker import fresh

RADIX, DEPTH = 256, 6  # of the model in tables: an n-gram is an integer of DEPTH digits
_RANGE_ROWS, _HELD, _TEXT_BYTES = 1 << 20, 3 << 19, 1 << 23
ALPHABET, ORDER = 40, 4  # of the model in memory


def _codes(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of a slice's texts in order, and bounds of the texts among them."""
    s = piece.buf
    n = len(s) - DEPTH + 1
    lengths = np.maximum(np.diff(piece.offsets) - DEPTH + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    if n <= 0:
        return np.zeros(0, np.int64), bounds
    code = s[:n].astype(np.int64)
    for k in range(1, DEPTH):
        code = code * RADIX + s[k : k + n]
    text_end = np.repeat(piece.offsets[1:], np.diff(piece.offsets))[:n]
    return code[np.arange(n) + DEPTH <= text_end], bounds


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def count_ngrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): occurrences of each n-gram over all whole texts."""

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for code, n in parts:
            for k in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(code[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in slices(batch.column(0)):
                parts.append(np.unique(_codes(piece)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > _HELD:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > _HELD // 2:
                        yield from rows(parts)
                        parts, held = [], 0
        if parts:
            yield from rows([_summed(parts)])

    return docs.select(text_col).mapInArrow(fresh(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(have: list[float]) -> np.ndarray:
    """What n-grams counted 0, 1, 2, 3 or more times lose, from how many are counted 1, 2, 3 and 4 times."""
    have = [float(h) or 1.0 for h in have]
    y = have[0] / (have[0] + 2 * have[1])
    return np.clip([0.0, 1 - 2 * y * have[1] / have[0], 2 - 3 * y * have[2] / have[1], 3 - 4 * y * have[3] / have[2]], [0, 0.1, 0.1, 0.1], [0, 0.9, 1.8, 2.7])


def _order_table(counts: DataFrame, radix: int) -> list[tuple[str, int, int]]:
    """(file, first, last n-gram) of the ranges of one order's table, made from its (code, n)."""
    size, *have = counts.agg(F.count("*"), *[F.count_if(F.col("n") == j) for j in (1, 2, 3, 4)]).first()
    d = _discounts(have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        code, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, context = np.unique(code // radix, return_inverse=True)
        cut = d[np.minimum(c, 3)]
        total, spare = np.bincount(context, c), np.bincount(context, cut)
        p, rest = (c - cut) / total[context], (spare / total)[context]
        for k in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (code, p, rest)], ["code", "p", "rest"])

    # a context's n-grams are in one range
    ranges = counts.withColumn("context", F.expr(f"code div {radix}")).repartitionByRange(-(-size // _RANGE_ROWS), "context").sortWithinPartitions("code")
    table = staged(ranges.select("code", "n").mapInArrow(fresh(run), "code long, p double, rest double"), "ngrams")
    files = table.groupBy(F.input_file_name().alias("file")).agg(F.min("code").alias("first"), F.max("code").alias("last")).collect()
    return sorted((tuple(f) for f in files), key=lambda f: f[1])


class Tables:
    """Interpolated modified Kneser-Ney over tables in the shared folder, one list of ranges per order."""

    def __init__(self, orders: list[list[tuple[str, int, int]]], radix: int):
        self.orders, self.radix = orders, radix

    def _range(self, file: str, code: np.ndarray, lower: np.ndarray) -> np.ndarray:
        system, path = FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            table = pq.ParquetFile(f).read(use_threads=False)
        known, p, rest = (table[c].to_numpy() for c in ("code", "p", "rest"))
        at = np.searchsorted(known, code)
        after, before = np.minimum(at, len(known) - 1), np.maximum(at - 1, 0)
        found = known[after] == code
        # n-grams ascend, so one of a context is beside the place of any other of it
        same_after, same_before = (known[x] // self.radix == code // self.radix for x in (after, before))
        weight = np.where(same_after, rest[after], np.where(same_before, rest[before], 1.0))
        return np.where(found, p[after], 0.0) + weight * lower

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """ln p(last symbol | those before) for ascending distinct codes of full n-grams."""
        shorter, p = np.zeros(1, np.int64), np.full(1, 1.0 / self.radix)
        for k, ranges in enumerate(self.orders, 1):
            gram = np.unique(code % self.radix**k)
            out = p[np.searchsorted(shorter, gram % self.radix ** (k - 1))]  # unseen contexts back off
            for file, first, last in ranges:
                # the n-grams of the range's contexts
                a, b = np.searchsorted(gram, [first // self.radix * self.radix, (last // self.radix + 1) * self.radix])
                if a < b:
                    out[a:b] = self._range(file, gram[a:b], out[a:b])
            shorter, p = gram, out
        return np.log(p)


def tables(counts: DataFrame, radix: int = RADIX, depth: int = DEPTH) -> Tables | None:
    """The model of n-grams of `depth` digits, (code, n). None where there are none. Only ranges' file names reach the driver."""
    counts = staged(counts, "counts")
    if counts.isEmpty():
        return None
    orders = [_order_table(counts, radix)]
    for k in range(depth - 1, 0, -1):  # lower orders count the distinct symbols before an n-gram
        counts = staged(counts.groupBy(F.expr(f"code % {radix**k}").alias("code")).agg(F.count("*").alias("n")), "counts")
        orders.insert(0, _order_table(counts, radix))
    return Tables(orders, radix)


def fit(docs: DataFrame, text_col: str = "text") -> Tables | None:
    """The model of all texts of docs; None where they hold no n-gram."""
    return tables(count_ngrams(docs, text_col))


class KneserNey:
    """Interpolated modified Kneser-Ney in back-off form, an ascending hash array per order, for small alphabets in memory; tests hold Tables against it."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.hashes: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        grams, counts = [code], [n]
        for _ in range(ORDER - 1):  # lower orders count the distinct symbols before an n-gram
            size = ALPHABET ** (ORDER - len(grams))
            shorter, continuation = np.unique(grams[0] % size, return_counts=True)
            grams.insert(0, shorter)
            counts.insert(0, continuation)
        lower = np.full(1, 1.0 / ALPHABET)
        for k in range(ORDER):
            g, c = grams[k], counts[k].astype(np.float64)
            d = _discounts([(c == j).sum() for j in (1, 2, 3, 4)])
            cut = d[np.minimum(c, 3).astype(np.int64)]
            context = g // ALPHABET
            # sums over contexts, of counts and of what is cut off
            total, spare = np.bincount(context, c), np.bincount(context, cut)
            gamma = spare / np.maximum(total, 1e-300)
            p = (c - cut) / total[context] + gamma[context] * (lower[g % ALPHABET**k] if k else lower[0])
            dense = np.zeros(ALPHABET ** (k + 1))
            seen = np.zeros(ALPHABET ** (k + 1), bool)
            dense[g], seen[g] = p, True
            if k:  # unseen n-grams back off
                wide = np.ones(ALPHABET**k)
                wide[: len(gamma)] = np.where(total > 0, gamma, 1.0)
                every = np.flatnonzero(~seen)
                dense[every] = wide[every // ALPHABET] * lower[every % ALPHABET**k]
                contexts = np.flatnonzero(total > 0)
                self.backoff.append(self._stored(contexts, np.log(gamma[contexts].clip(1e-12)), k)[1])
                self.backoff_keys = [*getattr(self, "backoff_keys", []), self._stored(contexts, contexts, k)[0]]
            else:
                dense[~seen] = gamma[0] * lower[0]
            keys, logs = self._stored(g, np.log(p), k + 1)
            self.hashes.append(keys)
            self.logp.append(logs)
            self.unseen = float(np.log(gamma[0] / ALPHABET)) if not k else self.unseen
            lower = dense
        del lower

    @staticmethod
    def _key(gram: np.ndarray, order: int) -> np.ndarray:
        return mix(gram.astype(np.uint64) + np.uint64(order << 40))

    def _stored(self, gram: np.ndarray, value: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        keys = self._key(gram, order)
        at = np.argsort(keys)
        return keys[at], np.asarray(value)[at].astype(np.float32)

    @staticmethod
    def _look(keys: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(stored, keys), max(len(stored) - 1, 0))
        return at, (stored[at] == keys) if len(stored) else np.zeros(len(keys), bool)

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """ln p(last symbol | those before) for codes of full n-grams."""
        out = np.zeros(len(code), np.float32)
        todo = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            gram = code[todo] % ALPHABET**k
            at, found = self._look(self._key(gram, k), self.hashes[k - 1])
            out[todo[found]] += self.logp[k - 1][at[found]]
            todo, gram = todo[~found], gram[~found]
            if k > 1:
                at, found = self._look(self._key(gram // ALPHABET, k - 1), self.backoff_keys[k - 2])
                out[todo[found]] += self.backoff[k - 2][at[found]]
        out[todo] += self.unseen
        return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, model: Tables | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Ids, languages, base counts and log perplexity (null where a text has no n-gram)."""
    schema = "_id long, _lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", n_ngrams long, log_perplexity double"

    def judged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        every = np.unique(np.concatenate([code for _, _, code, _, _ in held]))
        logp = model.log_probability(every) if len(every) else np.zeros(0)
        for columns, base, code, which, bounds in held:
            n = np.diff(bounds)
            value = -sums(logp[np.searchsorted(every, code)][which], bounds) / np.maximum(n, 1)
            counts = [pa.array(base[c].astype(np.int64)) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays([*columns, *counts, pa.array(n.astype(np.int64)), pa.array(value, mask=n == 0)], ["_id", "_lang", *_COUNTS, "n_ngrams", "log_perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch.column(2)):
                codes, bounds = _codes(piece)
                code, which = np.unique(codes, return_inverse=True)
                columns = [batch.column(k).slice(piece.first, piece.n) for k in (0, 1)]
                held.append((columns, base_counts(piece), code, which.astype(np.int32), bounds))
                size += len(piece.buf)
                if size > _TEXT_BYTES:
                    yield from judged(held)
                    held, size = [], 0
        if held:
            yield from judged(held)

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("text"))
    return picked.mapInArrow(fresh(run), schema)


_ALL, _LEAST_TEXTS = -1, 50


def _bands(rows: DataFrame, low_width: float, high_width: float, least_spread: float) -> DataFrame:
    """(_lang, _size, low, high); size _ALL: all lengths of the language."""
    group = ["_lang", "_size"]
    at = rows.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).select("_lang", F.explode(F.array("_size", F.lit(_ALL))).alias("_size"), "log_perplexity")
    middle = at.groupBy(*group).agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("m"), F.count("*").alias("texts"))
    middle = middle.where((F.col("texts") >= _LEAST_TEXTS) | (F.col("_size") == _ALL)).select(F.col("_lang").alias("_of"), F.col("_size").alias("_of_size"), "m", "texts")
    apart = at.join(F.broadcast(middle), F.col("_lang").eqNullSafe(F.col("_of")) & (F.col("_size") == F.col("_of_size")))
    spread = apart.groupBy(*group, "m", "texts").agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("m")), 0.5, 10_000).alias("d"))
    unit = F.greatest("d", F.lit(least_spread)) * (1 + 7 / F.sqrt("texts"))
    return spread.select(*group, (F.col("m") - low_width * unit).alias("low"), (F.col("m") + high_width * unit).alias("high"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 10, max_repeat_percent: int = 20, low_width: float = 10.0, high_width: float = 5.0, least_spread: float = 0.005
) -> DataFrame:
    """One row per input row: id, base counts, base_failed, log_perplexity, perplexity bounds, kept.

    Null text: an empty one, which fails the base rules. Null language: a language of its own.
    Null or repeated ids: kept as they are. Empty table: empty result. Other columns don't matter.
    """
    model = fit(docs, text_col)
    rows = staged(scored(docs, model, id_col, text_col, lang_col), "perplexity")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("_size", F.floor(F.log2(F.col("n_ngrams").cast("double"))).cast("int")).withColumn("_size", F.least(F.greatest("_size", F.lit(7)), F.lit(12)))
    bands = staged(_bands(rows, low_width, high_width, least_spread), "bands")
    joined = rows
    for size, names in ((F.col("_size"), ("_low", "_high")), (F.lit(_ALL), ("_any_low", "_any_high"))):
        band = bands.select(F.col("_lang").alias("_of"), F.col("_size").alias("_of_size"), *[F.col(b).alias(n) for b, n in zip(("low", "high"), names, strict=True)])
        joined = joined.join(F.broadcast(band), joined["_lang"].eqNullSafe(F.col("_of")) & (size == F.col("_of_size")), "left").drop("_of", "_of_size")
    joined = joined.withColumn("band_low", F.coalesce("_low", "_any_low")).withColumn("band_high", F.coalesce("_high", "_any_high"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return joined.select(F.col("_id").alias(id_col), *_COUNTS, "base_failed", "log_perplexity", "band_low", "band_high", (~F.col("base_failed") & inside).alias("kept"))

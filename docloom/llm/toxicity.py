"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; the probability of each goes into the
models of all later ones. In training those inputs are out-of-fold predictions, so a later
model sees earlier probabilities as unsure as they'll be on new texts. The last category decides.

Categories are conditions on columns of the labels, never on what the models read. Inputs of the models are
terms: whole words in lower case, and in words beyond ASCII every run of six bytes (two or three letters) as well, for scripts
without blanks. The `n_terms` terms whose document frequencies differ most between the last category's two classes
are used, chosen anew without each fold for the predictions of that fold. At most `max_rows` labelled rows, chosen by a hash of the id, are
fitted on; terms and models are of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.language import letters
from docloom.llm.lineage import staged
from docloom.llm.textvec import Slice, range_hashes, slices
from docloom.llm.worker import fresh

FOLDS, INNER = 3, 6
CATEGORIES = {"low_quality": "quality = 0", "toxic_prose": "toxic = 1 and quality = 1", "toxic": "toxic = 1"}


def terms_of(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a slice's texts, and their texts. Words are cut at all but letters and bytes over 0x7F."""
    low = Slice(piece.first, letters(piece), piece.offsets)
    starts, ends, bounds = low.words()
    text = np.repeat(np.arange(piece.n), np.diff(bounds))
    lead = np.flatnonzero(low.buf >= 0xC0)  # first bytes of code points beyond ASCII
    if len(lead):
        word = np.searchsorted(starts, lead, "right") - 1
        inside = lead + INNER <= ends[word]
        lead, word = lead[inside], word[inside]
        starts, ends, text = np.concatenate([starts, lead]), np.concatenate([ends, lead + INNER]), np.concatenate([text, text[word]])
    return range_hashes(low.buf, starts, ends), text


def _present(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (term, text) pairs of a slice."""
    gram, text = terms_of(piece)
    pairs = np.unique(np.rec.fromarrays([text, gram])) if len(gram) else np.rec.fromarrays([text, gram])
    return pairs.f1, pairs.f0


@dataclass
class Terms:
    """Term hashes in ascending order, behind a small table that lets most others pass by."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matrix(self, piece: Slice) -> np.ndarray:
        """Which texts have which terms (texts x terms, 0 or 1)."""
        x = np.zeros((piece.n, len(self.hashes)), np.float32)
        gram, text = terms_of(piece)
        if len(gram) and len(self.hashes):
            near = np.flatnonzero(self.maybe[(gram & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, gram[near]), len(self.hashes) - 1)
            hit = self.hashes[at] == gram[near]
            x[text[near[hit]], at[hit]] = 1
        return x


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 10) -> np.ndarray:
    """Weights (last: intercept) of ridge-penalised logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9).astype(x.dtype)[:, None]).T @ x
        move = np.linalg.solve(h.astype(np.float64) + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-4:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    terms: Terms
    categories: list[str]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = _probability(np.column_stack([x, out[:, :k]]), w)
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, used: np.ndarray | None = None) -> list[np.ndarray]:
    """One weight vector per column of y; model k has x and the k earlier categories' out-of-fold probabilities.

    used[j] tells which columns of x the predictions of fold j may rest on, and used[FOLDS] which the chain itself.
    """
    used = np.ones((FOLDS + 1, x.shape[1]), bool) if used is None else used
    weights, earlier = [], np.zeros((len(x), 0))
    for k in range(y.shape[1]):
        inputs = [np.column_stack([x[:, u], earlier]).astype(np.float32) for u in used]
        weights.append(logistic(inputs[FOLDS], y[:, k]))
        unseen = np.zeros(len(x))
        for j in range(FOLDS):
            own = fold == j
            if own.any() and not own.all():
                unseen[own] = _probability(inputs[j][own], logistic(inputs[j][~own], y[~own, k]))
        earlier = np.column_stack([earlier, unseen])
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, str] | None = None, max_rows: int = 16_000, n_terms: int = 224, seed: int = 6
) -> Chain:
    """A chain over categories, names and SQL conditions on columns of labels in order (CATEGORIES by default).

    labels: rows whose id or last condition is null are left out; other conditions count as false where null. An id labelled twice counts
    twice. Labels of one class or none: every probability is that class's rate or 0.
    """
    categories = categories or CATEGORIES
    names = list(categories)
    *earlier, last = [F.expr(c).cast("double") for c in categories.values()]
    known = labels.select(F.col(id_col).cast("long").alias("_lid"), F.array(*[F.coalesce(c, F.lit(0.0)) for c in earlier], last).alias("y"), last.alias("bad"))
    known = known.where("bad is not null and _lid is not null")
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("_lid", F.lit(seed)), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.xxhash64("_lid", F.lit(seed + 1)), F.lit(FOLDS)).cast("int")
    rows = staged(texts.join(known, texts["_id"] == known["_lid"]).select("text", "y", "bad", fold.alias("fold")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, part = batch.column("bad").to_numpy(), batch.column("fold").to_numpy()
            for piece in slices(batch.column("text")):
                gram, text = _present(piece)
                for j in range(FOLDS):
                    mine = part[piece.first + text] == j
                    if mine.any():
                        value, which = np.unique(gram[mine], return_inverse=True)
                        bad, total = np.bincount(which, y[piece.first + text[mine]]), np.bincount(which)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), j, np.int32)), pa.array(value.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(total)], ["fold", "gram", "bad", "n"])

    sizes = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect():
        sizes[r["fold"]] = r["bad"], r["n"] - r["bad"]
    bad, good = sizes.sum(0).tolist()
    if not bad or not good:
        rate = 1e-9 if not bad else 1 - 1e-9
        return Chain(Terms(np.zeros(0, np.uint64)), names, [np.append(np.zeros(k), np.log(rate / (1 - rate))) for k in range(len(names))])
    counted = rows.mapInArrow(fresh(count), "fold int, gram long, bad long, n long")
    sums = [F.sum(F.when(F.col("fold") == j, F.col(c)).otherwise(0)).alias(f"{c}{j}") for j in range(FOLDS) for c in ("bad", "n")]
    counted = staged(counted.groupBy("gram").agg(*sums).where("+".join(f"n{j}" for j in range(FOLDS)) + " >= 3"), "terms")

    def chosen(left_out: int) -> np.ndarray:
        """The terms of most different rates, by the rows of all folds but one."""
        kept = [j for j in range(FOLDS) if j != left_out]
        some_bad, some_good = np.maximum(sizes[kept].sum(0), 1).tolist()
        b, m = (sum((F.col(f"{c}{j}") for j in kept), F.lit(0)) for c in ("bad", "n"))
        rate = m / (some_bad + some_good)
        spread = F.sqrt(rate * (1 - rate) * (1 / some_bad + 1 / some_good) + 1e-12)
        z = F.abs(b / some_bad - (m - b) / some_good) / spread
        return counted.where(m >= 3).select("gram", z.alias("z")).orderBy(F.desc("z"), "gram").limit(n_terms).toArrow()["gram"].to_numpy().view(np.uint64)

    sets = [chosen(j) for j in [*range(FOLDS), -1]]
    terms = Terms(np.unique(np.concatenate(sets)))
    used = np.array([np.isin(terms.hashes, s) for s in sets])
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text")):
                x = np.packbits(shared.value.matrix(piece).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *[batch.column(c).slice(piece.first, piece.n) for c in ("y", "fold")]], ["x", "y", "fold"])

    # at most about max_rows x 4 n_terms bits
    table = rows.mapInArrow(fresh(matrix), "x binary, y array<double>, fold int").toArrow()
    bits = np.frombuffer(b"".join(table["x"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    x = np.unpackbits(bits, axis=1, count=len(terms.hashes)).astype(np.float32)
    y = np.array(table["y"].to_pylist()).reshape(-1, len(names))
    # the chain itself reads the terms chosen by all rows
    return Chain(Terms(terms.hashes[used[FOLDS]]), names, fit_chain(x, y, table["fold"].to_numpy(), used))


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, p_<category> of every category, score (the last one's) and predicted (1 if score >= 0.5).

    Null text: an empty one. Null or repeated ids: kept as they are. Empty table: empty result. Other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    columns = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                p = shared.value.probabilities(shared.value.terms.matrix(piece))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.n), *[pa.array(c) for c in p.T.copy()], pa.array(p[:, -1].copy()), pa.array((p[:, -1] >= 0.5).astype(np.int32))],
                    [id_col, *columns, "score", "predicted"],
                )

    schema = f"{id_col} long, " + ", ".join(f"{c} double" for c in columns) + ", score double, predicted int"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(fresh(run), schema)

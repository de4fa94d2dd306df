"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Document statistics, standardised and clipped, are mapped to cosines whose inner
products approximate a Gaussian kernel. Each task adds up the normal equations of its
rows, one set per fold, and Spark sums the tasks'; the driver solves systems of fixed size. Scores of
rows by the model that didn't see their fold, counted in fixed bins, give the isotonic map.
At most `max_rows` labelled rows, chosen by a hash of the id, are fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.lineage import staged
from docloom.llm.textstats import FEATURES, features
from docloom.llm.textvec import slices
from docloom.llm.worker import fresh

FOLDS, BINS = 3, 2000
_LOW, _HIGH = -0.5, 1.5


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, f): the statistics of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                x = features(piece)
                bounds = np.arange(piece.n + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.ravel()))], ["_id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).mapInArrow(fresh(run), "_id long, f array<float>")


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value in weighted squares (pool adjacent violators)."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        means.append(v)
        weights.append(w)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            w2, w1 = weights.pop(), weights.pop()
            m2, m1 = means.pop(), means.pop()
            k = sizes.pop()
            means.append((m1 * w1 + m2 * w2) / (w1 + w2))
            weights.append(w1 + w2)
            sizes[-1] += k
    return np.repeat(means, sizes)


@dataclass
class RffRidge:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray  # one row per left-out fold, the last of all rows
    knots: np.ndarray
    levels: np.ndarray

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        out = np.empty((len(x), len(self.phase) + 1))
        out[:, :-1] = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        out[:, -1] = 1.0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores in [0, 1]; never falling as the ridge score rises."""
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.phi(x) @ self.weights[-1], self.knots, self.levels), 0, 1)


def _rows(batch: pa.RecordBatch, name: str = "f") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(FEATURES))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 40_000, dimensions: int = 192, ridge: float = 1e-3, seed: int = 5) -> RffRidge:
    """stats as statistics() gives them; labels (id, 0 or 1), others and nulls left out. No labels: every score is 0.5."""
    spark = stats.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("_lid"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1) and _lid is not null")
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("_lid", F.lit(seed)), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    rows = staged(stats.join(known, stats["_id"] == known["_lid"]).select("f", "y", F.pmod(F.xxhash64("_lid", F.lit(seed + 1)), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    d = len(FEATURES)
    moments = rows.agg(*[F.avg(F.col("f")[k]) for k in range(d)], *[F.stddev_pop(F.col("f")[k]) for k in range(d)]).first()
    draw = np.random.Generator(np.random.PCG64(seed))
    blank = RffRidge(np.zeros(d), np.ones(d), np.zeros((d, dimensions)), np.zeros(dimensions), np.zeros((FOLDS + 1, dimensions + 1)), np.zeros(0), np.zeros(0))
    if moments[0] is None:
        return blank
    blank.mean, blank.scale = np.array(moments[:d]), np.maximum(np.array(moments[d:]), 1e-6)
    blank.omega, blank.phase = draw.normal(0, 1 / (0.7 * np.sqrt(d)), (d, dimensions)), draw.uniform(0, 2 * np.pi, dimensions)
    width = dimensions + 1
    model = spark.sparkContext.broadcast(blank)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, count = np.zeros((FOLDS, width, width + 1)), np.zeros(FOLDS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                phi, y, fold = model.value.phi(_rows(part)), part.column("y").to_numpy(), part.column("fold").to_numpy()
                for j in range(FOLDS):
                    p = phi[fold == j]
                    a[j, :, :-1] += p.T @ p
                    a[j, :, -1] += p.T @ y[fold == j]
                    count[j] += len(p)
        for j in np.flatnonzero(count).tolist():
            cell = np.arange(width * (width + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), j, np.int32)), pa.array(cell.astype(np.int32)), pa.array(a[j].ravel())], ["fold", "cell", "v"])

    sums = rows.mapInArrow(fresh(add_up), "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toArrow()
    a = np.zeros((FOLDS, width * (width + 1)))
    a[sums["fold"].to_numpy(), sums["cell"].to_numpy()] = sums["v"].to_numpy()
    a = a.reshape(FOLDS, width, width + 1)
    for j in range(FOLDS + 1):
        m = a.sum(0) - (a[j] if j < FOLDS else 0)
        penalty = ridge * max(m[-1, width - 1], 1.0) * np.eye(width)
        penalty[-1, -1] = 1e-9
        blank.weights[j] = np.linalg.solve(m[:, :-1] + penalty, m[:, -1])
    model = spark.sparkContext.broadcast(blank)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (model.value.phi(_rows(batch)) * model.value.weights[batch.column("fold").to_numpy()]).sum(1)
            at = np.clip((raw - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    bins = rows.mapInArrow(fresh(binned), "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).toArrow()
    order = np.argsort(bins["bin"].to_numpy())
    raw, y, n = (bins[c].to_numpy()[order].astype(float) for c in ("raw", "y", "n"))
    level = isotonic(y, n)
    # each level stands at the middle of its block; between blocks the map is linear, so scores keep the ridge order
    block = np.concatenate([[0], np.cumsum(np.diff(level) > 0)])
    blank.knots = np.bincount(block, raw * n) / np.bincount(block, n)
    blank.levels = np.bincount(block, level * n) / np.bincount(block, n)
    return blank


def score(stats: DataFrame, model: RffRidge, id_col: str = "doc_id") -> DataFrame:
    """id, score and predicted (1 if score >= 0.5) of every row of stats."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                s = shared.value.score(_rows(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return stats.select("_id", "f").mapInArrow(fresh(run), f"{id_col} long, score double, predicted int")

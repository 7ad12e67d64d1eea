"""k-means from many starts at once: one aggregate an iteration moves the centres of all (k, seed) starts.

Rows are standardised and held as blocks of whole numbers (2^-24 of a deviation),
so sums, centres and costs do not depend on the partitioning. A start's first
centres are drawn by k-means++ from a bounded sample (the ``sample_rows`` rows
with the smallest hash). An iteration is one pass: every task assigns its rows for
each start still moving and sends number, sum and squared distance by (start,
cell); a start whose centres stay has ended. What the driver gets is bounded by
the starts' number of centres. ``silhouettes`` rates the best start of every k in
one more pass by the squared-Euclidean closed form.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import materialize

WHOLE = float(1 << 24)
BLOCK_ROWS = 8192
TASK_ROWS = 1 << 17  # rows a task holds; the result does not depend on it
SAMPLE_ROWS = 4096


@dataclass
class Centres:
    """Fitted centres in standardised space with what standardises a row."""

    features: list[str]
    means: list[float]
    deviations: list[float]
    centres: np.ndarray
    cost: float = 0.0

    def scaled(self) -> list[Column]:
        return [(F.col(f).cast("double") - F.lit(m)) / F.lit(d) if d > 0 else F.lit(0.0)
                for f, m, d in zip(self.features, self.means, self.deviations)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``cluster_id``, the nearest centre (ties: the lowest), and ``scaled``, the standardised features; expressions only."""
        rows = df.withColumn("scaled", F.array(*self.scaled()))
        gaps = [sum(((F.col("scaled")[k] - F.lit(float(x))) * (F.col("scaled")[k] - F.lit(float(x))) for k, x in enumerate(c)), F.lit(0.0)) for c in self.centres]
        rows = rows.withColumn("__gaps", F.array(*gaps))
        return rows.withColumn("cluster_id", (F.array_position("__gaps", F.array_min("__gaps")) - 1).cast("int")).drop("__gaps")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a centre and feature, and the features' mean and deviation (centre -1)."""
        rows = [(-1, k, f, float(m), float(d)) for k, (f, m, d) in enumerate(zip(self.features, self.means, self.deviations))]
        rows += [(c, k, f, float(self.centres[c, k]), None) for c in range(len(self.centres)) for k, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "centre int, place int, feature string, value double, deviation double")

    @classmethod
    def of_table(cls, table: DataFrame) -> "Centres":
        rows = sorted(table.collect(), key=lambda r: (r.centre, r.place))
        own = [r for r in rows if r.centre < 0]
        centres = np.array([r.value for r in rows if r.centre >= 0]).reshape(-1, len(own))
        return cls([r.feature for r in own], [r.value for r in own], [r.deviation for r in own], centres)


class Points:
    """Standardised rows of ``df`` without NULLs, as blocks; release with ``close``."""

    def __init__(self, df: DataFrame, features: Sequence[str], sample_rows: int = SAMPLE_ROWS):
        self.features = list(features)
        rows = materialize(df.dropna(subset=self.features).select(*[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(self.features)]), "kmeans-rows")
        xs = rows.columns
        stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in xs], *[F.stddev_samp(x).alias(f"s_{x}") for x in xs]).first()
        self.n = stats.n
        self.means = [round(stats[f"m_{x}"] or 0.0, 12) for x in xs]
        self.deviations = [round(stats[f"s_{x}"] or 0.0, 12) for x in xs]
        scale = [(F.col(x) - F.lit(m)) / F.lit(d) if d > 0 else F.lit(0.0) for x, m, d in zip(xs, self.means, self.deviations)]
        whole = rows.select(F.array(*[F.round(c * WHOLE).cast("long") for c in scale]).alias("p"))
        sample = whole.orderBy(F.xxhash64("p"), "p").limit(sample_rows).collect()
        self.sample = np.array([r.p for r in sample], "f8").reshape(len(sample), len(xs)) / WHOLE
        width = len(xs)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    flat = batch.column("p").slice(at, BLOCK_ROWS).flatten().to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["points"])

        self.width = width
        self.blocks = whole.repartition(max(1, -(-self.n // TASK_ROWS))).mapInArrow(blocks, "points binary").persist(StorageLevel.MEMORY_AND_DISK)

    def first_centres(self, k: int, seed: int) -> np.ndarray:
        """k-means++ over the sample: each next centre with the chance of its squared distance to the nearest one so far."""
        draw = np.random.default_rng([seed, k])
        x = self.sample
        chosen = [x[draw.integers(len(x))]]
        gap = ((x - chosen[0]) ** 2).sum(1)
        for _ in range(1, k):
            total = gap.sum()
            at = int(np.searchsorted(np.cumsum(gap), draw.random() * total)) if total > 0 else int(draw.integers(len(x)))
            chosen.append(x[min(at, len(x) - 1)])
            gap = np.minimum(gap, ((x - chosen[-1]) ** 2).sum(1))
        return np.array(chosen)

    def close(self) -> None:
        self.blocks.unpersist()


def gap_to(columns: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance of each point to a centre; columns: features x points."""
    total = np.square(columns[0] - centre[0])
    for x, c in zip(columns[1:], centre[1:]):
        total += np.square(x - c)
    return total


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point (ties: the lowest) and its squared distance; a feature at a time."""
    columns = np.ascontiguousarray(x.T)
    best, least = np.zeros(len(x), "i8"), gap_to(columns, centres[0])
    for k, c in enumerate(centres[1:], 1):
        gap = gap_to(columns, c)
        nearer = gap < least
        best[nearer] = k
        np.minimum(least, gap, out=least)
    return best, least


def sums_by_cell(values: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Sums of whole numbers (points x columns) by cell."""
    if float(np.abs(values).max(initial=0)) * len(values) < 2.0 ** 53:  # exact in doubles
        return np.stack([np.bincount(cell, v, cells) for v in values.T], 1).astype("i8")
    out = np.zeros((cells, values.shape[1]), "i8")
    np.add.at(out, cell, values)
    return out


def _moved(centres: dict[int, np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros((len(c), width + 2), "i8") for s, c in centres.items()}
        for batch in batches:
            for block in batch.column("points"):
                whole = np.frombuffer(block.as_buffer(), "i8").reshape(-1, width)
                x = whole / WHOLE
                for s, c in centres.items():
                    best, gap = nearest(x, c)
                    total[s][:, :width] += sums_by_cell(whole, best, len(c))
                    total[s][:, width] += np.bincount(best, minlength=len(c))
                    total[s][:, width + 1:] += sums_by_cell(np.rint(gap * WHOLE).astype("i8")[:, None], best, len(c))
        rows = [(s, c, t[c].tolist()) for s, t in total.items() for c in range(len(t)) if t[c, width]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["start", "cell", "sums"])

    return run


def _pass(points: Points, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """start -> (cells x (sums, number, squared distances)) of all rows: one job."""
    sums = points.blocks.mapInArrow(_moved(centres, points.width), "start int, cell int, sums array<long>")
    found = (sums.groupBy("start", "cell").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(points.width + 2)])).collect()
    out = {s: np.zeros((len(c), points.width + 2), "i8") for s, c in centres.items()}
    for r in found:
        out[r.start][r.cell] = [r[f"s{k}"] for k in range(points.width + 2)]
    return out


def fit_starts(points: Points, starts: Sequence[tuple[int, int]], max_iter: int) -> list[Centres]:
    """Lloyd's iterations for all (k, seed) starts together; an empty cell keeps its centre."""
    centres = {i: points.first_centres(k, s) for i, (k, s) in enumerate(starts)} if points.n else {}
    cost = dict.fromkeys(centres, 0.0)
    moving = dict(centres)
    for _ in range(max_iter):
        if not moving:
            break
        for i, sums in _pass(points, moving).items():
            n = sums[:, points.width]
            cost[i] = float(sums[:, -1].sum() / WHOLE)
            new = np.where(n[:, None] > 0, sums[:, :points.width] / WHOLE / np.maximum(n, 1)[:, None], centres[i])
            if np.array_equal(new, centres[i]):
                moving.pop(i)
            centres[i] = new
            if i in moving:
                moving[i] = new
    if moving:  # the iterations have run out: the cost of the last centres
        for i, sums in _pass(points, moving).items():
            cost[i] = float(sums[:, -1].sum() / WHOLE)
    return [Centres(points.features, points.means, points.deviations, centres[i], cost[i]) for i in sorted(centres)]


def best_start(fits: Sequence[Centres], starts: Sequence[tuple[int, int]], k: int) -> Centres:
    """The fit of ``k`` with the lowest cost (ties: the lowest seed)."""
    return min((f.cost, seed, n, f) for n, (f, (own, seed)) in enumerate(zip(fits, starts)) if own == k)[3]


def silhouettes(points: Points, fits: Sequence[Centres]) -> list[float | None]:
    """Mean squared-Euclidean silhouette of each fit: two passes for all of them."""
    width = points.width
    centres = {i: f.centres for i, f in enumerate(fits)}
    cells = {}
    for i, sums in _pass(points, centres).items():
        n = sums[:, width]
        mean = sums[:, :width] / WHOLE / np.maximum(n, 1)[:, None]
        # mean squared distance to a cell's members = squared distance to their mean + their own spread
        spread = sums[:, -1] / WHOLE / np.maximum(n, 1) - ((mean - centres[i]) ** 2).sum(1)
        cells[i] = (n, mean, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(cells, 0)
        for batch in batches:
            for block in batch.column("points"):
                x = np.frombuffer(block.as_buffer(), "i8").reshape(-1, width) / WHOLE
                for i, (n, mean, spread) in cells.items():
                    own, _ = nearest(x, centres[i])
                    d = np.stack([((x - m) ** 2).sum(1) for m in mean], 1) + spread
                    d[:, n == 0] = np.inf
                    a = d[np.arange(len(x)), own] * n[own] / np.maximum(n[own] - 1, 1)
                    d[np.arange(len(x)), own] = np.inf
                    b = d.min(1)
                    top = np.maximum(a, b)
                    s = np.where((n[own] > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
                    total[i] += int(np.rint(s * WHOLE).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["fit", "s"])

    found = {r.fit: r.s for r in points.blocks.mapInArrow(run, "fit int, s long").groupBy("fit").agg(F.sum("s").alias("s")).collect()}
    return [found[i] / WHOLE / points.n if points.n else None for i in range(len(fits))]

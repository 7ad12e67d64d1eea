"""Gradient-boosted trees for a binary target, from histograms of gradients and curvatures.

Each feature is cut into at most ``bins`` ranges at the quantiles of a bounded sample
(the ``sample_rows`` rows with the smallest hash); a missing value is a range of
its own. The rows are held as blocks of range numbers. A tree grows a level at a
time by one aggregate over all blocks: every task adds up gradient and curvature by
(node, feature, range), and the best split of each (node, feature) is taken from
the sums -- the ranges up to one go left, missing values to the side that gains
more. Beyond DIRECT_TASKS tasks the sums meet by (node, feature) in tasks of their
own first, so that what the driver gets is bounded. Before a tree's first level every
block adds the last trees to its margins and keeps its sampled rows with their gradients
and curvatures; the levels read those, so a level costs its sums alone.

Sums are whole numbers (2^-28 of a gradient), row sampling is a hash of the row
and the tree, feature sampling a seeded draw: the trees do not depend on the
partitioning or on the number of rows in a task. Margins are written every
``write_every`` trees; in between, they are held in the cached blocks.

A model is a table with one row a node (``BoostedTrees.table``); scoring walks all
trees over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import materialize

MISSING = 255
WHOLE = float(1 << 28)
BLOCK_ROWS = 8192
TASK_ROWS = 1 << 18   # rows a task holds; the trees do not depend on it
CHAIN = 5             # so many trees are added to one another's cached blocks, then all since the last write anew: Spark's plans stay short
DIRECT_TASKS = 4      # so many tasks send their sums to the driver directly


@dataclass(frozen=True)
class BoostParams:
    trees: int = 200
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8           # share of the rows in a tree
    features: float = 0.8       # share of the features in a tree
    l2: float = 1.0
    min_curvature: float = 1.0  # of a child
    bins: int = 64
    seed: int = 42
    sample_rows: int = 16_384
    write_every: int = 25


@dataclass
class Tree:
    """Nodes in heap order (children of k: 2k + 1, 2k + 2); feature -1 is a leaf, -2 no node."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -2), np.zeros(n, "i8"), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after ``levels`` steps; bins: features x rows."""
        at = np.zeros(bins.shape[1], "i8")
        every = np.arange(bins.shape[1])
        for _ in range(levels):
            f = self.feature[at]
            b = bins[np.maximum(f, 0), every]
            left = np.where(b == MISSING, self.missing_left[at], b <= self.bin[at])
            at = np.where(f >= 0, 2 * at + np.where(left, 1, 2), at)
        return at

    def margins(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.value[self.nodes(bins, depth)]


@dataclass
class BoostedTrees:
    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    depth: int = 4

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Range numbers (features x rows) of a matrix of values (rows x features)."""
        out = np.empty(values.shape[::-1], "u1")
        for k, cuts in enumerate(self.cuts):
            out[k] = np.where(np.isnan(values[:, k]), MISSING, np.searchsorted(cuts, values[:, k], "left"))
        return out

    def probability(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        margin = np.zeros(len(values))
        for tree in self.trees:
            margin += tree.margins(bins, self.depth)
        return _sigmoid(margin)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (probability of class 1) and ``prediction`` (class at 0.5); NULL or NaN features count as missing."""
        model = self

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(model.probability(rows.to_numpy(dtype="f8", na_value=np.nan)))

        columns = [(F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")).alias(f) for f in self.features]
        return df.withColumn("score", score(F.struct(*columns))).withColumn("prediction", (F.col("score") >= 0.5).cast("double"))

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain of each feature's splits as a share of all (XGBoost's default kind), largest first."""
        gain, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(gain, tree.feature[split], tree.gain[split])
            np.add.at(n, tree.feature[split], 1)
        mean = gain / np.maximum(n, 1)
        share = mean / mean.sum() if mean.sum() > 0 else mean
        return sorted(zip(self.features, share.tolist()), key=lambda r: (-r[1], r[0]))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a node, and one a cut point (tree -1)."""
        rows = [(-1, k, i, f, float(c), None, None, None) for k, f in enumerate(self.features) for i, c in enumerate(self.cuts[k])]
        rows += [(-1, k, -1, f, None, None, None, None) for k, f in enumerate(self.features)]
        rows += [(t, int(n), int(tree.bin[n]), self.features[tree.feature[n]] if tree.feature[n] >= 0 else None,
                  float(self.cuts[tree.feature[n]][tree.bin[n]]) if tree.feature[n] >= 0 and tree.bin[n] < len(self.cuts[tree.feature[n]]) else None,
                  bool(tree.missing_left[n]), float(tree.value[n]), float(tree.gain[n]))
                 for t, tree in enumerate(self.trees) for n in np.nonzero(tree.feature > -2)[0]]
        return spark.createDataFrame(rows, "tree int, node int, bin int, feature string, cut double, missing_left boolean, value double, gain double")

    @classmethod
    def of_table(cls, table: DataFrame) -> "BoostedTrees":
        """A model has a bounded number of rows: trees x 2^(depth + 1) and features x bins."""
        rows = table.collect()
        of_feature = {r.node: r.feature for r in rows if r.tree == -1}
        features = [of_feature[k] for k in sorted(of_feature)]
        cuts = [np.array([r.cut for r in sorted((r for r in rows if r.tree == -1 and r.node == k and r.bin >= 0), key=lambda r: r.bin)]) for k in range(len(features))]
        number = max((r.tree for r in rows), default=-1) + 1
        depth = max(1, int(max((r.node for r in rows if r.tree >= 0), default=0) + 1).bit_length() - 1)
        trees = [Tree.empty(depth) for _ in range(number)]
        for r in rows:
            if r.tree >= 0:
                t = trees[r.tree]
                t.feature[r.node] = features.index(r.feature) if r.feature is not None else -1
                t.bin[r.node], t.missing_left[r.node], t.value[r.node], t.gain[r.node] = r.bin, r.missing_left, r.value, r.gain
        return cls(features, cuts, trees, depth)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _mixed(x: np.ndarray, number: int) -> np.ndarray:
    """A 64-bit hash of a row's hash and a number (splitmix's finaliser)."""
    x = x.view("u8") + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def in_tree(row_hash: np.ndarray, number: int, seed: int, share: float) -> np.ndarray:
    return _mixed(_mixed(row_hash, seed), number) < np.uint64(min(int(share * 2.0 ** 64), (1 << 64) - 1))


def tree_features(n: int, number: int, p: BoostParams) -> np.ndarray:
    return np.sort(np.random.default_rng([p.seed, number]).choice(n, max(1, int(p.features * n)), replace=False))


def cut_points(sample: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per column at most ``bins - 1`` cuts between ranges of about as many sample values each."""
    out = []
    for column in sample.T:
        values = np.sort(column[~np.isnan(column)])
        distinct = np.unique(values)
        if len(distinct) > bins:
            distinct = np.unique(values[(np.arange(1, bins) * len(values)) // bins])
            out.append(distinct)
        else:
            out.append(distinct[:-1] if len(distinct) else distinct)
    return out


def best_split(g: np.ndarray, h: np.ndarray, p: BoostParams) -> tuple[float, int, bool, float, float]:
    """(gain, range, whether missing values go left, G and H of the left side); the last entry of g and h is the missing range."""
    parent = g.sum() ** 2 / (h.sum() + p.l2)
    best = (0.0, -1, False, 0.0, 0.0)
    for left in (False, True):
        gl, hl = np.cumsum(g[:-1]), np.cumsum(h[:-1])
        if left:
            gl, hl = gl + g[-1], hl + h[-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= p.min_curvature) & (hr >= p.min_curvature), 0.5 * (gl ** 2 / (hl + p.l2) + gr ** 2 / (hr + p.l2) - parent), 0.0)
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > best[0]:
            best = (float(gain[at]), at, left, float(gl[at]), float(hl[at]))
    return best


def _blocks(model: BoostedTrees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(at, BLOCK_ROWS)
                x = np.column_stack([rows.column(f"x{k}").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in range(len(model.features))])
                bins = model.bins(x)
                pack = lambda v: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.num_rows], pa.int32()), pack(bins), pack(rows.column("y").to_numpy()), pack(rows.column("w").to_numpy()),
                     pack(rows.column("h").to_numpy()), pack(np.zeros(rows.num_rows))], names=["n", "bins", "y", "w", "h", "margin"])

    return run


BLOCK = "n int, bins binary, y binary, w binary, h binary, margin binary"


def _block(batch: pa.RecordBatch, row: int):
    n = batch.column("n")[row].as_py()
    read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)
    return read("bins", "u1").reshape(-1, n), read("y", "f8"), read("w", "f8"), read("h", "i8"), read("margin", "f8")


def _with_margins(new: list[Tree], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bins, _, _, _, margin = _block(batch, row)
                margin = margin + sum(t.margins(bins, depth) for t in new)
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("n", "bins", "y", "w", "h")), pa.array([margin.tobytes()], pa.binary())],
                                                 names=["n", "bins", "y", "w", "h", "margin"])

    return run


READY = f"{BLOCK}, kept binary, g binary, c binary"


def _ready(new: list[Tree], number: int, p: BoostParams):
    """The blocks with ``new`` added to their margins, and the bins, gradients and curvatures of the rows in tree ``number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bins, y, w, h, margin = _block(batch, row)
                for t in new:
                    margin = margin + t.margins(bins, p.depth)
                stay = in_tree(h, number, p.seed, p.rows)
                prob = _sigmoid(margin[stay])
                g = np.rint(w[stay] * (prob - y[stay]) * WHOLE)
                c = np.rint(w[stay] * prob * (1 - prob) * WHOLE)
                one = batch.slice(row, 1)
                pack = lambda v: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(one.column(k) for k in ("n", "bins", "y", "w", "h")), pack(margin), pack(bins[:, stay]), pack(g), pack(c)],
                                                 names=["n", "bins", "y", "w", "h", "margin", "kept", "g", "c"])

    return run


def _level_sums(tree: Tree, level: int, chosen: np.ndarray, widths: list[int]):
    """Sums of a level by (node, feature): slot = node of the level * features + feature."""
    first, many = 2 ** level - 1, 2 ** level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros((2, many, widths[f] + 1), "i8") for f in chosen.tolist()}
        for batch in batches:
            for row in range(batch.num_rows):
                g, c = (np.frombuffer(batch.column(k)[row].as_buffer(), "f8") for k in ("g", "c"))
                bins = np.frombuffer(batch.column("kept")[row].as_buffer(), "u1").reshape(-1, len(g)) if len(g) else np.zeros((len(widths), 0), "u1")
                node = tree.nodes(bins, level) - first
                here = node >= 0  # rows in a leaf of an earlier level stay there
                if not here.all():
                    bins, g, c, node = bins[:, here], g[here], c[here], node[here]
                for f in chosen.tolist():
                    width = widths[f] + 1
                    at = node * width + np.where(bins[f] == MISSING, width - 1, bins[f])
                    for k, v in enumerate((g, c)):  # a block's sums are far below 2^53
                        total[f][k] += np.bincount(at, v, many * width).astype("i8").reshape(many, width)
        slots, gs, hs = [], [], []
        for f, (g, c) in total.items():
            for n in np.nonzero(c.any(1))[0]:
                slots.append(int(n) * len(widths) + f)
                gs.append(g[n])
                hs.append(c[n])
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(gs, pa.list_(pa.int64())), pa.array(hs, pa.list_(pa.int64()))], names=["slot", "g", "h"])

    return run


_BEST = pa.schema([("slot", pa.int32()), ("gain", pa.float64()), ("bin", pa.int32()), ("missing_left", pa.bool_()), ("gl", pa.float64()),
                   ("hl", pa.float64()), ("g", pa.float64()), ("h", pa.float64())])


def best_of_slots(batches: Iterator[pa.RecordBatch], p: BoostParams) -> list[dict]:
    """The best split of each (node, feature) from all of its sums."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, slot in enumerate(batch.column("slot").to_pylist()):
            own = np.stack([batch.column(c)[row].values.to_numpy() for c in ("g", "h")])
            total[slot] = total[slot] + own if slot in total else own
    return [dict(zip(_BEST.names, (slot, *best_split(*(s / WHOLE), p), *(float(x) for x in s.sum(1) / WHOLE)))) for slot, s in total.items()]


def grow(ready: DataFrame, tasks: int, number: int, widths: list[int], p: BoostParams) -> Tree:
    """The next tree: one aggregate a level over blocks that ``_ready`` made for it."""
    chosen = tree_features(len(widths), number, p)
    tree = Tree.empty(p.depth)
    tree.feature[0] = -1
    for level in range(p.depth):
        sums = ready.select("kept", "g", "c").mapInArrow(_level_sums(tree, level, chosen, widths), "slot int, g array<long>, h array<long>")
        if tasks > DIRECT_TASKS:
            met = sums.repartition("slot").mapInArrow(lambda batches: iter([pa.RecordBatch.from_pylist(best_of_slots(batches, p), _BEST)]),
                                                      "slot int, gain double, bin int, missing_left boolean, gl double, hl double, g double, h double")
            found = [r.asDict() for r in met.collect()]
        else:
            found = best_of_slots(sums.toArrow().to_batches(), p)
        first = 2 ** level - 1
        of_node: dict[int, list] = {}
        for r in found:
            of_node.setdefault(first + r["slot"] // len(widths), []).append(r)
        if level == 0 and of_node:
            root = of_node[0][0]
            tree.value[0] = -p.rate * root["g"] / (root["h"] + p.l2)
        grown = False
        for node, rows in of_node.items():
            best = max(rows, key=lambda r: (r["gain"], -r["slot"]))
            if best["gain"] <= 0:
                continue
            grown = True
            tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = (
                best["slot"] % len(widths), best["bin"], best["missing_left"], best["gain"])
            gl, hl = best["gl"], best["hl"]
            for child, g, h in ((2 * node + 1, gl, hl), (2 * node + 2, best["g"] - gl, best["h"] - hl)):
                tree.feature[child], tree.value[child] = -1, -p.rate * g / (h + p.l2)
        if not grown:
            break
    return tree


def fit(df: DataFrame, features: Sequence[str], label: str, weight: str, params: BoostParams = BoostParams()) -> BoostedTrees:
    """Boosted trees over all rows of ``df``; NULL and NaN features are missing values, rows without a label are left out."""
    p, features = params, list(features)
    rows = df.where(F.col(label).isNotNull()).select(
        *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    rows = rows.withColumn("h", F.xxhash64(*rows.columns))
    rows = materialize(rows, "boost-rows")
    xs = [f"x{k}" for k in range(len(features))]
    sample = rows.orderBy("h", *xs).limit(p.sample_rows).select(*xs).toPandas().to_numpy(dtype="f8", na_value=np.nan).reshape(-1, len(xs))
    model = BoostedTrees(features, cut_points(sample, p.bins), depth=p.depth)
    widths = [len(c) + 1 for c in model.cuts]
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    blocks = rows.repartition(tasks).mapInArrow(_blocks(model), BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    written, ready = 0, None
    for number in range(p.trees):
        again = (number - written) % CHAIN == 0
        before, new = (blocks, model.trees[written:]) if again else (ready, model.trees[-1:])
        latest = before.select("n", "bins", "y", "w", "h", "margin").mapInArrow(_ready(new, number, p), READY).persist(StorageLevel.MEMORY_AND_DISK)
        model.trees.append(grow(latest, tasks, number, widths, p))
        if ready is not None:
            ready.unpersist()
        ready = latest
        if len(model.trees) - written >= p.write_every and number + 1 < p.trees:
            newer = materialize(blocks.mapInArrow(_with_margins(model.trees[written:], p.depth), BLOCK), "boost-margins")
            newer = newer.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
            blocks.unpersist()
            ready.unpersist()
            blocks, written, ready = newer, len(model.trees), None
    if ready is not None:
        ready.unpersist()
    blocks.unpersist()
    return model

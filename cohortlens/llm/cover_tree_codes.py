"""Product-quantised vector codes by Lloyd rounds over partition-local cover trees, in integers throughout.

A component x becomes floor(1024 x); a vector is cut into PARTS equal parts, each
with a codebook of its own that starts as that part of the ENTRIES smallest vec_ids.

``plant`` builds the trees once: each task turns TREE_ROWS vectors at a time into
one cover tree a part, over the distinct points, in pre-order, so that a subtree is
a range. A node holds its point, the distance to its farthest descendant and the
cumulative sum and number of its subtree. The trees are written to the shared
folder, one row a group of vectors; the rounds move no vectors, only read them.

A round walks each tree from the root. With d1 and d2 the distances of a node's
point to its nearest and second nearest entry and r its radius, d1 + r < d2 - r
puts the whole subtree into the nearest entry (triangle inequality) by its
cumulative sum. Any other node is ambiguous: its own point is placed by exact
comparison and its children are visited. Tasks send a sum and a number for each
entry; the new entries are floor(sum / number), unused ones stay. The last walk
gives each vector its code and its exact error.

Nulls and edges: rows whose vector is null, empty, holds a null or non-finite
component or one of 2^17 or more (its squares would leave a long) are left out, as
are those of another length than most rows have (of equally frequent lengths the
shortest counts). A length that PARTS does not divide is filled up with zeros. Null vec_ids come last among the
smallest, repeated ones in the order of their components, and every row gets a
code; fewer than ENTRIES rows make smaller codebooks; an empty table gives no
rows; labels of any type, nulls together; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 17
TREE_ROWS = 1024
_STRIP = 1 << 20  # distances held at once


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components (v) of the vectors that can be coded."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST))
    rows = (vectors.select("vec_id", "label", "embedding").filter((F.size("embedding") > 0) & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v")))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return rows
    fill = -length.n % PARTS
    rows = rows.filter(F.size("v") == length.n)
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("int"), fill))) if fill else rows


class Tree:
    """A cover tree in pre-order over distinct integer points with their numbers.

    At scale s, points within s of a node stay below it; those beyond are covered by
    children that are more than s apart, each with the points within s of itself.
    """

    def __init__(self, points: np.ndarray, weight: np.ndarray):
        self.made: list[int] = []  # points in pre-order
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.radius: list[float] = []
        self.end: list[int] = []
        exact = 4 * points.shape[1] * int(np.abs(points).max(initial=0)) ** 2 < 1 << 53
        self._x = points.astype("f8") if exact else points.astype("i8")
        if len(points):
            rest = np.arange(1, len(points))
            self._grow(0, rest, self._far(0, rest), -1, 0)
        order = np.array(self.made, "i8")
        self.order, self.points, self.weight = order, points[order], weight[order]

    def _far(self, node: int, others: np.ndarray) -> np.ndarray:
        gap = self._x[others] - self._x[node]
        return np.einsum("ij,ij->i", gap, gap)

    def _grow(self, node: int, below: np.ndarray, gaps: np.ndarray, parent: int, depth: int) -> None:
        me = len(self.made)
        self.made.append(node)
        self.parent.append(parent)
        self.depth.append(depth)
        self.radius.append(float(np.sqrt(gaps.max(initial=0))))
        self.end.append(0)
        while len(below):
            scale = 0.25  # of squared distances: the power of four next below the farthest point's
            while scale * 4 < gaps.max():
                scale *= 4
            beyond = gaps > scale
            far, below, gaps = below[beyond], below[~beyond], gaps[~beyond]
            while len(far):
                own = self._far(far[0], far)
                near = own <= scale
                near[0] = False
                took, took_gaps = far[near], own[near]
                stay = ~near
                stay[0] = False
                child, far = int(far[0]), far[stay]
                self._grow(child, took, took_gaps, me, depth + 1)
        self.end[me] = len(self.made)


def cumulative(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of every node's subtree."""
    end = np.array(tree.end, "i8")
    at = np.arange(len(end))
    sums = np.concatenate([np.zeros((1, tree.points.shape[1]), "i8"), np.cumsum(tree.points.astype("i8") * tree.weight[:, None], 0)])
    n = np.concatenate([[0], np.cumsum(tree.weight)])
    return sums[end] - sums[at], n[end] - n[at]


NODE = "points array<int>, sums array<long>, numbers array<long>, radius array<double>, parent array<int>, depth array<int>, ends array<int>, member array<int>"


def _plant(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def planted(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, PARTS, width)
            parts = []
            for p in range(PARTS):
                points, member, weight = np.unique(v[:, p], axis=0, return_inverse=True, return_counts=True)
                tree = Tree(points.astype("i8"), weight)
                sums, numbers = cumulative(tree)
                place = np.empty(len(points), "i4")
                place[tree.order] = np.arange(len(points))
                parts.append({"points": tree.points.ravel().astype("i4"), "sums": sums.ravel(), "numbers": numbers, "radius": np.array(tree.radius),
                              "parent": np.array(tree.parent, "i4"), "depth": np.array(tree.depth, "i4"), "ends": np.array(tree.end, "i4"),
                              "member": place[member.ravel()]})
            one = pa.array([0, rows.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(one, rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
            kinds = {"points": pa.int32(), "sums": pa.int64(), "numbers": pa.int64(), "radius": pa.float64(), "parent": pa.int32(), "depth": pa.int32(), "ends": pa.int32(), "member": pa.int32()}
            for p in parts:
                columns.append(pa.StructArray.from_arrays([pa.array([p[k]], pa.list_(t)) for k, t in kinds.items()], names=list(kinds)))
            return pa.RecordBatch.from_arrays(columns, names=["vec_ids", "labels", *(f"tree{p}" for p in range(PARTS))])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, TREE_ROWS - n)
                held.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == TREE_ROWS:
                    yield planted(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield planted(pa.Table.from_batches(held))

    return run


def plant(rows: DataFrame, width: int) -> DataFrame:
    """One row for TREE_ROWS vectors of ``whole_numbers``: their ids and labels and a tree for each part."""
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_ids array<long>, labels array<{label}>, " + ", ".join(f"tree{p} struct<{NODE.replace(' array', ': array')}>" for p in range(PARTS))
    return rows.mapInArrow(_plant(width), schema)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per point: nearest entry (the lowest index of ties), its squared distance and that of the second nearest (-1: none); exact."""
    high = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    found, least, second = np.empty(len(points), "i8"), np.empty(len(points), "i8"), np.full(len(points), -1, "i8")
    step = max(1, _STRIP // len(entries))
    floats = 4 * points.shape[1] * high * high < 1 << 53  # every number below is then a whole one that a double holds
    c = entries.astype("f8" if floats else "i8")
    for at in range(0, len(points), step):
        x = points[at:at + step].astype(c.dtype)
        if floats:
            d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
        else:
            d = np.stack([((x - e) ** 2).sum(1) for e in c], 1)
        best = d.argmin(1)
        found[at:at + step], least[at:at + step] = best, d[np.arange(len(d)), best]
        if d.shape[1] > 1:
            second[at:at + step] = np.partition(d, 1, axis=1)[:, 1]
    return found, least, second


def walk(tree: dict[str, np.ndarray], width: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nodes, their entry, whether the entry holds for the whole subtree, nodes not visited): the decisions of one walk, level by level."""
    points, radius, parent, depth, ends = tree["points"].reshape(-1, width), tree["radius"], tree["parent"], tree["depth"], tree["ends"]
    open_ = np.zeros(len(parent), bool)
    nodes, placed, whole = [], [], []
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=-1)) + 2))
    for level, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        here = by_depth[a:b]
        if level:
            here = here[open_[parent[here]]]
        if not len(here):
            break
        best, least, second = nearest(points[here], entries)
        r = radius[here] * (1 + 1e-9) + 1e-6  # rounding must not settle a tie
        sure = (second < 0) | (np.sqrt(least) + r < np.sqrt(np.maximum(second, 0)) - r) | (ends[here] == here + 1)
        open_[here[~sure]] = True
        nodes.append(here)
        placed.append(best)
        whole.append(sure)
    if not nodes:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, bool), 0
    n = np.concatenate(nodes)
    return n, np.concatenate(placed), np.concatenate(whole), len(parent) - len(n)


def _tree(column: pa.StructArray, row: int) -> dict[str, np.ndarray]:
    return {column.type.field(k).name: np.asarray(column.field(k)[row].values) for k in range(column.type.num_fields)}


def _round(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), width + 1), "i8") for b in books]
        for batch in batches:
            for p, entries in enumerate(books):
                column = batch.column(f"tree{p}")
                for row in range(batch.num_rows):
                    tree = _tree(column, row)
                    node, entry, whole, _ = walk(tree, width, entries)
                    sums, n = tree["sums"].reshape(-1, width), tree["numbers"]
                    np.add.at(total[p], entry[whole], np.column_stack([sums[node[whole]], n[node[whole]]]))
                    alone = node[~whole]  # an ambiguous node's own point: its subtree's sum without those of its children
                    own = n[alone].copy()
                    own_sums = sums[alone].copy()
                    place = np.full(len(n), -1)
                    place[alone] = np.arange(len(alone))
                    child = np.nonzero((tree["parent"] >= 0) & (place[tree["parent"]] >= 0))[0]
                    np.subtract.at(own, place[tree["parent"][child]], n[child])
                    np.subtract.at(own_sums, place[tree["parent"][child]], sums[child])
                    np.add.at(total[p], entry[~whole], np.column_stack([own_sums, own]))
        for p, sums in enumerate(total):
            used = np.nonzero(sums[:, -1])[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, "i4")), pa.array(used.astype("i4")),
                                              pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    return run


def lloyd_round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks. What tasks send is bounded by the codebooks' size."""
    width = books[0].shape[1]
    sums = (trees.select(*(f"tree{p}" for p in range(PARTS))).mapInArrow(_round(books, width), "part int, entry int, sums array<long>")
            .select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x")))
    total = [np.zeros((len(b), width + 1), "i8") for b in books]
    for r in sums.collect():
        total[r.part][r.entry, r.at] = r.x
    return [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), b) for t, b in zip(total, books)]


def _coder(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, error = [], 0
                for p, entries in enumerate(books):
                    tree = _tree(batch.column(f"tree{p}"), row)
                    node, entry, whole, _ = walk(tree, width, entries)
                    code = np.zeros(len(tree["parent"]), "i8")
                    code[node[~whole]] = entry[~whole]
                    for a, e in zip(node[whole], entry[whole]):
                        code[a:tree["ends"][a]] = e
                    gap = tree["points"].reshape(-1, width).astype("i8") - entries[code]
                    codes.append(code[tree["member"]])
                    error = error + (gap * gap).sum(1)[tree["member"]]
                hexed = [bytes(x).hex() for x in np.stack(codes, 1).astype("u1")]
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, batch.column("labels")[row].values,
                                                  pa.array(hexed, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Trees over ``rows`` (``whole_numbers``) and the codebooks after the rounds; none for an empty table."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return plant(rows, 0), []
    start = np.array([r.v for r in first], "i8")
    width = start.shape[1] // PARTS
    trees = materialize(plant(rows, width), "cover-trees")
    books = [start[:, p * width:(p + 1) * width] for p in range(PARTS)]
    for _ in range(rounds):
        books = lloyd_round(trees, books)
    return trees, books


def encode(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and squared error of every vector in ``trees``."""
    label = trees.schema["labels"].dataType.elementType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    if not books:
        return trees.sparkSession.createDataFrame([], schema)
    return trees.mapInArrow(_coder(books, books[0].shape[1]), schema)


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (of all rows with the label) and the digest of the final codebooks."""
    trees, books = train(whole_numbers(vectors), rounds)
    coded = materialize(encode(trees, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")))

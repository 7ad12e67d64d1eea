"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them, one representative a group.

Equal vectors are one vector with a number of copies from here on. ``fit`` runs
spherical k-means with about the square root of their number of cells on a
sample that grows with the cells (SAMPLE_PER_CELL hash-ordered vectors for
each); sums are whole numbers, so the cells do not depend on the partitioning.

Every vector goes to its nearest cell, its home. A pair's homes differ where a
cell border runs between them, so a vector is also a guest in cells whose border
is near: the partner of x at the threshold's angle t stands at cos t x + sin t u
and lies beyond the border of homes a and b only if u points there by
h / tan t, h being the distance of x from the border. That needs h <= tan t, for
certain; with u in no particular direction of d dimensions, u points there by
more than REACH / sqrt(d - 1) with the chance of a normal value above REACH, so
guests are those with h <= tan t min(1, REACH / sqrt(d - 1)). For d <= 1 + REACH^2
no link is missed; above it the recall is measured (README, tests). Two cells are
compared in one of them alone, dealt evenly, so no pair meets twice.

A cell over TILE members or guests is dealt into tiles, and each pair of tiles is
a block of its own, so a hot group is spread. A block sends each vector's number
of links and a spanning forest instead of its pairs.

Nulls and edges: a vector that is null, empty, zero or holds a null or non-finite
component links with nothing, nor do vectors of different length; null vec_ids
take part but name no component (one of null ids alone has a null id) and are not
kept; repeated vec_ids are vectors of their own, kept alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, smallest
from .graph import components

THRESHOLD = 0.95
REACH = 3.0
SAMPLE_PER_CELL = 64
MOST_CELLS = 8192  # what tasks get of the cells is bounded by this and the vectors' length
ROUNDS = 6
TILE = 4096
_WHOLE = 1 << 30  # components of unit vectors as whole numbers, for sums without an order
_STRIP = 1 << 20  # products held at once


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their scale."""
    x = vectors.astype("f8")
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the lists."""
    offsets, flat = column.offsets.to_numpy().astype("i8"), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        rows = np.nonzero(sizes == n)[0]
        yield rows, flat[offsets[rows][:, None] + np.arange(n)]


def _products(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cosines of unit rows with unit cells; shorter rows count as filled up with zeros, longer ones as cut."""
    n = min(x.shape[1], cells.shape[1])
    return x[:, :n] @ cells[:, :n].T


def usable(column: str = "embedding"):
    """Whether a vector can link at all."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """uid, embedding, copies and smallest vec_id of the vectors that can link."""
    rows = vectors.filter(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    groups = rows.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return materialize(groups.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")


def _sums(cells: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cells), cells.shape[1]), "i8")
        for batch in batches:
            for _, vectors in _by_length(batch.column("embedding")):
                x = unit(vectors)
                n = min(x.shape[1], cells.shape[1])
                np.add.at(total[:, :n], _products(x, cells).argmax(1), np.rint(x[:, :n] * _WHOLE).astype("i8"))
        used = np.nonzero(total.any(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cell", "sums"])

    return run


def fit(distinct: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of spherical k-means over a sample of SAMPLE_PER_CELL vectors a cell, spread by hash."""
    hashed = distinct.select("embedding", F.xxhash64("embedding").alias("_h"))
    sample = materialize(smallest(hashed, "_h", SAMPLE_PER_CELL * cells, "embedding"), "cell-sample")
    first = sample.orderBy("_h", "embedding").limit(cells).collect()
    width = max(len(r.embedding) for r in first)
    centres = np.zeros((len(first), width))
    for k, r in enumerate(first):
        centres[k, :len(r.embedding)] = unit(np.array([r.embedding]))[0]
    sample = sample.repartition(max(1, min(sample.sparkSession.sparkContext.defaultParallelism, cells)))
    for _ in range(rounds):
        found = (sample.select("embedding").mapInArrow(_sums(centres), "cell int, sums array<long>")
                 .select("cell", F.posexplode("sums").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x")).collect())
        total = np.zeros_like(centres)
        for r in found:
            total[r.cell, r.at] = r.x
        length = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(length > 0, total / np.where(length > 0, length, 1), centres)  # an unused centre stays
    return centres


def places(x: np.ndarray, cells: np.ndarray, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of each unit row, and (row, cell) where it is a guest."""
    between = np.sqrt(np.maximum(2 - 2 * cells @ cells.T, 1e-30))
    slope = math.tan(math.acos(threshold)) if threshold > 0 else math.inf
    near = slope * min(1.0, reach / math.sqrt(max(1, x.shape[1] - 1)))
    home, rows, guests = np.empty(len(x), "i8"), [], []
    step = max(1, _STRIP // len(cells))
    every = np.arange(len(cells))
    for at in range(0, len(x), step):
        s = _products(x[at:at + step], cells)
        own = s.argmax(1)
        home[at:at + step] = own
        border = (s[np.arange(len(s)), own][:, None] - s) / between[own]
        both = own[:, None] + every[None]
        hosts = np.where(both % 2 == 0, own[:, None] > every[None], own[:, None] < every[None])  # two cells meet in the smaller or the larger
        r, c = np.nonzero(hosts & (border <= near + 1e-12))
        rows.append(r + at)
        guests.append(c)
    return home, np.concatenate(rows), np.concatenate(guests)


def _assigner(cells: np.ndarray, threshold: float, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_length(batch.column("embedding")):
                home, row, guest = places(unit(vectors), cells, threshold, reach)
                at = np.searchsorted(row, np.arange(len(rows) + 1)).astype("i4")
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("uid", "embedding", "copies")), pa.array(np.full(len(rows), vectors.shape[1], "i4")),
                     pa.array(home.astype("i4")), pa.ListArray.from_arrays(pa.array(at), pa.array(guest.astype("i4")))],
                    names=["uid", "embedding", "copies", "length", "home", "guests"])

    return run


def forest(x: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of ``len(x)`` members joined by ``pairs``."""
    root = np.arange(len(x))
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def linked(x: np.ndarray, raw: np.ndarray, homes: int, inner: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j at the threshold or above, a strip of products at a time: homes with guests, and with each other if ``inner``.

    A product next to the threshold is decided by the vectors' own components.
    """
    low = 0 if inner else homes
    step = max(1, _STRIP // max(1, len(x)))
    for at in range(0, homes, step):
        to = min(homes, at + step)
        start = max(low, at)
        s = x[at:to] @ x[start:].T
        i, j = np.nonzero(s >= threshold - 1e-9)
        value = s[i, j]
        i, j = i + at, j + start
        keep = i < j
        i, j, value = i[keep], j[keep], value[keep]
        close = np.nonzero(np.abs(value - threshold) < 1e-9)[0]
        if len(close):
            a, b = raw[i[close]], raw[j[close]]
            value[close] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        keep = value >= threshold
        yield i[keep], j[keep]


def _blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(key: tuple, rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            guest = rows.column("guest").to_numpy()
            order = np.argsort(guest, kind="stable")
            homes = int((~guest).sum())
            uid, copies = rows.column("uid").to_numpy()[order], rows.column("copies").to_numpy()[order]
            column = rows.column("embedding").chunk(0)
            raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(uid), -1).astype("f8")[order]
            raw = raw / np.abs(raw).max(1, keepdims=True)
            x = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
            links = np.zeros(len(uid), "i8")

            def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j in linked(x, raw, homes, key[2] == key[3], threshold):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    yield i, j

            root = forest(x, counted())
            child, some = np.nonzero(root != np.arange(len(root)))[0], np.nonzero(links)[0]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([uid[child], uid[some]])),
                 pa.array(np.concatenate([uid[root[child]], np.zeros(len(some), "i8")]), mask=np.concatenate([np.zeros(len(child), bool), np.ones(len(some), bool)])),
                 pa.array(np.concatenate([np.zeros(len(child), "i8"), links[some]]))], names=["u", "v", "n"])

        key, held = None, []
        names = ("cell", "length", "i", "j")
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in names]) if batch.num_rows else np.zeros((0, 4), "i8")
            cuts = [*np.nonzero((np.diff(keys, axis=0) != 0).any(1))[0] + 1, batch.num_rows] if batch.num_rows else []
            at = 0
            for to in cuts:
                own = tuple(keys[at].tolist())
                if own != key and held:
                    yield compared(key, pa.Table.from_batches(held))
                    held = []
                key = own
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield compared(key, pa.Table.from_batches(held))

    return run


def links(assigned: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(u, v, 0): edges that join what all found links join; (uid, null, n): the links of a vector found in one block, copies counted."""
    cells = assigned.select("uid", "copies", "embedding", "length", F.explode(F.concat(F.array("home"), "guests")).alias("cell"), (F.col("cell") != F.col("home")).alias("guest"))
    sizes = (cells.groupBy("cell", "length").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("visits"))
             .filter((F.col("homes") > tile) | (F.col("visits") > tile))
             .select("cell", "length", F.ceil(F.col("homes") / tile).cast("int").alias("h"), F.ceil(F.col("visits") / tile).cast("int").alias("g")))
    own = F.pmod(F.xxhash64("uid"), F.when(F.col("guest"), F.greatest("g", F.lit(1))).otherwise(F.greatest("h", F.lit(1)))).cast("int")
    tiles = F.sequence(F.lit(0), F.col("h") - 1)
    visits = F.when(F.col("g") > 0, F.transform(F.sequence(F.lit(0), F.greatest("g", F.lit(1)) - 1), lambda t: F.struct(F.col("own").alias("i"), (F.col("h") + t).alias("j"))))
    met = (F.when(F.col("h").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
           .when(F.col("h") < 1, F.array().cast("array<struct<i:int,j:int>>"))
           .when(F.col("guest"), F.transform(tiles, lambda t: F.struct(t.alias("i"), (F.col("h") + F.col("own")).alias("j"))))
           .otherwise(F.concat(F.transform(tiles, lambda t: F.struct(F.least(t, F.col("own")).alias("i"), F.greatest(t, F.col("own")).alias("j"))),
                               F.coalesce(visits, F.array().cast("array<struct<i:int,j:int>>")))))
    dealt = (cells.join(sizes, ["cell", "length"], "left").withColumn("own", own).withColumn("met", F.explode(met))
             .select("cell", "length", "met.i", "met.j", ((F.col("guest")) | (F.col("h").isNotNull() & (F.col("met.i") != F.col("own")))).alias("guest"), "uid", "copies", "embedding"))
    return dealt.repartition("cell", "length", "i", "j").sortWithinPartitions("cell", "length", "i", "j").mapInArrow(_blocks(threshold), "u long, v long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, tile: int = TILE, cells: int | None = None) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept, whether it stands for its group."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    spark = vectors.sparkSession
    distinct = distinct_vectors(vectors)
    n = distinct.count()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", usable().alias("_usable"))
    if n:
        centres = fit(distinct, cells or max(1, min(MOST_CELLS, math.isqrt(n))))
        assigned = materialize(distinct.select("uid", "embedding", "copies").mapInArrow(
            _assigner(centres, threshold, reach),
            f"uid long, embedding {distinct.schema['embedding'].dataType.simpleString()}, copies long, length int, home int, guests array<int>"), "vector-cells")
        found = materialize(links(assigned, threshold, tile), "vector-links")
    else:
        found = spark.createDataFrame([], "u long, v long, n long")
    joined = components(found.filter("v is not null").select("u", "v")).withColumnRenamed("node", "uid")
    counts = found.filter("v is null").groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("n"))
    rooted = distinct.join(joined, "uid", "left").join(counts, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_vector = rooted.join(named, "root").select(F.col("embedding").alias("_e"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked_rows = rows.filter("_usable").join(of_vector, F.col("embedding") == F.col("_e")).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not _usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

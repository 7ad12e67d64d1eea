"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

``pieces`` encodes whole documents and cuts only those longer than a sequence:
every piece is a full sequence except the first, which holds the remainder.
Full pieces are sequences as they stand; ``pack`` places the rest.

A chromosome is a packing, its genes are whole sequences (bins). Pieces are
dealt at random into islands of a bounded number of pieces. An island starts
from best-fit-decreasing packings and evolves them: crossover injects well-filled
bins of one parent into another, the bins that share a piece with them are
removed, and the pieces thereby displaced are put back by best fit. Islands
hold different pieces, so an elite travels as the piece lengths of its fullest
bins: the neighbour on the ring builds those bins from its own pieces of the
same lengths and takes them in by the same crossover. After the epochs, each
island gives up its worst-filled bins; their pieces form fewer islands, which
evolve again, until one island is left. Every level keeps a fixed share of
the pieces, so the work of all levels is bounded by a constant times the first.
An island whose number of bins equals the lower bound stops at once.

Nulls and edges: a null or empty text is a piece holding the separator alone;
null and repeated doc_ids are packed row by row; a document of exactly one
sequence is one full piece; an empty table gives no piece; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, texts
from .word_memo import tokenizer_path, worker_memo

CAPACITY = 2048
SEPARATOR = 0
ISLAND_PIECES = 4096
ISLAND_SEQUENCES = 32  # an island's pieces fill so many sequences at least, unless it is the only one
POPULATION = 6
GENERATIONS = 24
EPOCHS = 2
MIGRANTS = 32
WORST_SHARE = 0.125
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "island long, kind int, uid long, length int, bin int, place int, pattern array<int>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _cutter(path: str, capacity: int, separator: int):
    def make():
        from pyspark import TaskContext

        memo, sep = worker_memo(path), np.array([separator], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 40

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal uid
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), memo.packed_batch(texts(batch.column("text")))):
                ids += sep
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((uid, doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                    uid += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    return make


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); ``uid`` numbers the pieces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, _cutter(tokenizer or tokenizer_path(), capacity, separator), PIECES)


class Packing:
    """Bins of item numbers, found by best fit through a bit set of the free spaces in use."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.by_free: dict[int, set[int]] = {}
        self.used = 0  # bit f is set if a bin has f free
        self.next = 0

    def _file(self, b: int, free: int) -> None:
        self.free[b] = free
        self.by_free.setdefault(free, set()).add(b)
        self.used |= 1 << free

    def _unfile(self, b: int) -> int:
        free = self.free.pop(b)
        self.by_free[free].discard(b)
        if not self.by_free[free]:
            self.used &= ~(1 << free)
        return free

    def add_bin(self, items: list[int]) -> None:
        self.bins[self.next] = list(items)
        self._file(self.next, self.capacity - int(self.sizes[items].sum()))
        self.next += 1

    def remove_bin(self, b: int) -> list[int]:
        self._unfile(b)
        return self.bins.pop(b)

    def best_fit(self, items: list[int]) -> None:
        for i in items:
            size = int(self.sizes[i])
            fitting = self.used >> size
            if fitting:
                free = size + (fitting & -fitting).bit_length() - 1
                b = min(self.by_free[free])
                self._unfile(b)
                self.bins[b].append(i)
                self._file(b, free - size)
            else:
                self.add_bin([i])

    def copy(self) -> Packing:
        other = Packing(self.sizes, self.capacity)
        other.bins = {b: list(x) for b, x in self.bins.items()}
        other.next = self.next
        for b, f in self.free.items():
            other._file(b, f)
        return other

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the more uneven filling (sum of squared fills)."""
        fills = self.capacity - np.fromiter(self.free.values(), "i8", len(self.free))
        return -len(self.bins), float((fills.astype("f8") ** 2).sum())


def crossover(child: Packing, injected: list[list[int]], rng: np.random.Generator) -> None:
    """Put whole bins into ``child``, remove its bins that share an item, best-fit the displaced items."""
    taken = {i for bin_ in injected for i in bin_}
    hit = [b for b, items in child.bins.items() if not taken.isdisjoint(items)]
    displaced = [i for b in hit for i in child.remove_bin(b) if i not in taken]
    for bin_ in injected:
        child.add_bin(bin_)
    _refill(child, displaced, rng)


def _refill(packing: Packing, items: list[int], rng: np.random.Generator) -> None:
    packing.best_fit(sorted(items, key=lambda i: (-packing.sizes[i], i)))


def _mutate(child: Packing, rng: np.random.Generator) -> None:
    """Empty some of the worst-filled bins and a few others, and best-fit their items."""
    order = sorted(child.free, key=lambda b: -child.free[b])
    few = max(2, len(order) // 50)
    chosen = set(order[:few]) | set(rng.choice(list(child.bins), min(few, len(child.bins)), replace=False).tolist())
    loose = [i for b in sorted(chosen) for i in child.remove_bin(b)]
    rng.shuffle(loose)
    keep = len(loose) // 4
    child.best_fit(loose[:keep])
    _refill(child, loose[keep:], rng)


def _from_patterns(packing: Packing, patterns: list[list[int]]) -> list[list[int]]:
    """Bins of the travelled lengths, built from items in bins that are not full."""
    stock: dict[int, list[int]] = {}
    for b, f in packing.free.items():
        if f:
            for i in packing.bins[b]:
                stock.setdefault(int(packing.sizes[i]), []).append(i)
    out = []
    for lengths in patterns:
        got: list[int] = []
        for s in lengths:
            if not stock.get(s):
                break
            got.append(stock[s].pop())
        if len(got) == len(lengths):
            out.append(got)
        else:
            for i in got:
                stock[int(packing.sizes[i])].append(i)
    return out


def evolve(sizes: np.ndarray, start: list[list[int]] | None, patterns: list[list[int]], capacity: int, seed: int,
           population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing that an island finds for its items."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // capacity)
    people: list[Packing] = []
    if start is not None:
        elite = Packing(sizes, capacity)
        for bin_ in start:
            elite.add_bin(bin_)
        people.append(elite)
    else:
        first = Packing(sizes, capacity)
        _refill(first, list(range(len(sizes))), rng)
        people.append(first)
    if len(people[0].bins) <= bound:
        return people[0]
    if patterns and (brought := _from_patterns(people[0], patterns)):
        child = people[0].copy()
        crossover(child, brought, rng)
        people.append(child)
    while len(people) < population:
        if len(people) % 2:
            child = people[0].copy()
            _mutate(child, rng)
        else:
            child = Packing(sizes, capacity)
            child.best_fit(rng.permutation(len(sizes)).tolist())
        people.append(child)
    for _ in range(generations):
        people.sort(key=Packing.fitness, reverse=True)
        if len(people[0].bins) <= bound:
            break
        a, b = (int(rng.integers(0, population - 1)) for _ in range(2))
        child, giver = people[min(a, b)].copy(), people[int(rng.integers(0, population))]
        full = sorted(giver.free, key=lambda x: giver.free[x])
        full = full[: max(1, len(full) // 2)]
        chosen = rng.choice(full, max(1, len(full) // 3), replace=False).tolist()
        crossover(child, [list(giver.bins[x]) for x in chosen], rng)
        _mutate(child, rng)
        people[-1] = child
    return max(people, key=Packing.fitness)


def _island(capacity: int, migrants: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        island = int(key[0])
        items = rows[rows["kind"] == 0].sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        patterns = [list(map(int, p)) for p in rows.loc[rows["kind"] == 1, "pattern"]]
        patterns.sort()
        if items.empty:
            return pd.DataFrame({"island": [], "kind": [], "uid": [], "length": [], "bin": [], "place": [], "pattern": []})
        sizes = items["length"].to_numpy("i8")
        start = None
        if (items["bin"] >= 0).all():
            start = [list(g) for g in items.groupby("bin", sort=True).indices.values()]
        best = evolve(sizes, start, patterns, capacity, seed + island)
        n = len(items)
        bins, place = np.zeros(n, "i4"), np.zeros(n, "i4")
        for k, b in enumerate(sorted(best.bins)):
            at = 0
            for i in best.bins[b]:
                bins[i], place[i] = k, at
                at += sizes[i]
        out = pd.DataFrame({"island": island, "kind": 0, "uid": items["uid"], "length": items["length"], "bin": bins, "place": place, "pattern": None})
        fullest = sorted(best.free, key=lambda b: (best.free[b], b))[:migrants]
        sent = pd.DataFrame([{"island": island, "kind": 1, "uid": -1, "length": 0, "bin": -1, "place": 0,
                              "pattern": sorted((int(sizes[i]) for i in best.bins[b]), reverse=True)} for b in fullest if best.free[b] == 0],
                            columns=out.columns)
        return pd.concat([out, sent], ignore_index=True) if len(sent) else out

    return run


def _evolved(state: DataFrame, islands: int, capacity: int, epochs: int, migrants: int, seed: int) -> DataFrame:
    """Epochs on all islands; between two, each island's elite bins move on to the next island of the ring."""
    for epoch in range(epochs):
        sent = migrants if epoch < epochs - 1 and islands > 1 else 0
        state = materialize(state.groupBy("island").applyInPandas(_island(capacity, sent, seed + 1000 * epoch), _STATE), "islands")
        if sent:
            state = state.withColumn("island", F.when(F.col("kind") == 1, (F.col("island") + 1) % islands).otherwise(F.col("island")))
    return state.filter("kind = 0")


def pack(items: DataFrame, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES, epochs: int = EPOCHS,
         migrants: int = MIGRANTS, worst_share: float = WORST_SHARE, seed: int = 7) -> DataFrame:
    """Place pieces (uid, length) into sequences; returns uid, sequence_id, offset."""
    full = items.filter(F.col("length") == capacity).select("uid", F.struct(F.lit(-1).alias("level"), F.col("uid").alias("a"), F.lit(0).alias("b")).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") != capacity).select("uid", F.col("length").cast("int").alias("length"))
    placed, level, before = full, 0, None
    n, total = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    while n:
        # an island holds some sequences' worth of pieces, and there are at most half as many as a level before
        islands = max(1, min(-(-n // island_pieces), total // (ISLAND_SEQUENCES * capacity), n if before is None else before // 2))
        before = islands
        state = rest.select((F.abs(F.xxhash64("uid", F.lit(level))) % islands).alias("island"), F.lit(0).alias("kind"), "uid", "length",
                            F.lit(-1).alias("bin"), F.lit(0).alias("place"), F.lit(None).cast("array<int>").alias("pattern"))
        state = _evolved(state, islands, capacity, epochs, migrants, seed + level)
        if islands > 1:
            fills = state.groupBy("island", "bin").agg(F.sum("length").alias("fill"))
            order = fills.withColumn("_k", F.row_number().over(_by_island()))
            share = order.groupBy("island").agg(F.count("*").alias("_bins"))
            given = (order.join(share, "island").filter((F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_bins") * worst_share))) & (F.col("fill") < capacity))
                     .select("island", "bin", F.lit(True).alias("_given")))
            state = materialize(state.join(given, ["island", "bin"], "left"), "levels")
            rest = state.filter("_given").select("uid", "length")
            state = state.filter("_given is null")
            n, total = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        else:
            n = 0
        placed = placed.unionByName(state.select("uid", F.struct(F.lit(level).alias("level"), F.col("island").alias("a"), F.col("bin").alias("b")).alias("sequence"), F.col("place").cast("long").alias("offset")))
        level += 1
    # a sequence's number: level, island and bin side by side in 64 bits (full pieces: their uid, negative)
    number = F.when(F.col("sequence.level") < 0, -F.col("sequence.a") - 1).otherwise(
        F.shiftleft(F.col("sequence.level").cast("long"), 56) + F.shiftleft(F.col("sequence.a"), 16) + F.col("sequence.b"))
    return placed.select("uid", number.alias("sequence_id"), "offset")


def _by_island():
    from pyspark.sql import Window

    return Window.partitionBy("island").orderBy("fill", "bin")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``docs`` with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = materialize(pieces(docs, capacity, SEPARATOR, tokenizer), "pieces")
    return cut_up.join(pack(cut_up, capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""SimHash near-duplicates through a segment-popcount embedding.

``fingerprints``: 64-bit SimHash of whole texts over word shingles.

``links``: the fingerprint is cut into 32 segments of two bits and embedded as
the vector of their bit counts. Flipping a bit moves one count by one, so the
Manhattan distance of two vectors never exceeds the fingerprints' bit distance.
The grid range-join finds all vectors within that Manhattan radius r: the
segments form b > r blocks (more of them the more fingerprints there are), a cell is the vector's exact value on b - r of them,
and since at most r blocks can differ, two vectors in range share the cell of
at least one choice of blocks. Pairs in a cell are checked for the Manhattan
distance, then for the bit distance. Each count is held in unary (0, 1, 2 as
00, 01, 11), so a Manhattan distance is the number of differing bits of two
embedded words.

The join works on distinct fingerprints, so copies cost nothing. A cell emits
a spanning forest of its links instead of its pairs; a cell over TILE members
is dealt into tiles and each pair of tiles is a cell of its own.

Nulls and edges: a null, empty or blank text has fingerprint zero and is
linked like any other; null doc_ids get a fingerprint and a component but are
never its id (a component of null ids alone has a null id); rows with one
doc_id are separate documents; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, texts
from .graph import components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
#: (distinct fingerprints, blocks): a cell fixes about 21, 27 or 32 bits, so that few others share it by chance; the links are the same.
BLOCKS = ((1 << 20, 6), (1 << 25, 7), (1 << 62, 8))
TILE = 8192
_STRIP = 1 << 20  # pairs compared at once
_EVEN = 0x5555555555555555


def simhash(text: str, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint; bytes' lower() and split() are exactly A-Z and the six ASCII spaces."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(line, HASH_SEED)]
    else:
        ends = [e + k for k, e in enumerate(accumulate(map(len, tokens)))]
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], HASH_SEED) for a, b in zip(starts, ends[words - 1:])]
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at:at + 65536], "<u8")
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_step(words: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([simhash(t, words) for t in texts(batch.column("text"))], "u8").view("i8")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return step


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, a hash of the text, and its fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    return arrow_map(rows, lambda: _fingerprint_step(words), "doc_id long, text_hash long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in unary."""
    even = np.uint64(_EVEN)
    high, low = (fp >> np.uint64(1)) & even, fp & even
    return (high | low) | ((high & low) << np.uint64(1))


def cell_masks(blocks: int, radius: int) -> list[int]:
    """Bits of the embedded word that a cell fixes, for every choice of ``blocks - radius`` blocks."""
    cuts = [round(k * 32 / blocks) for k in range(blocks + 1)]
    one = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(one[k] for k in choice) for choice in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fp: np.ndarray, em: np.ndarray, a: slice, b: slice, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j, i in a, within the radius: Manhattan distance of the embeddings first, then the bits themselves."""
    i, j = np.nonzero(np.bitwise_count(em[a, None] ^ em[None, b]) <= radius)
    i, j = i + a.start, j + b.start
    keep = i < j
    i, j = i[keep], j[keep]
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[keep], j[keep]


def spanning_forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same fingerprints as all links within ``fp``, at most one per fingerprint."""
    n, em = len(fp), embed(fp)
    root = np.arange(n)
    strip = max(1, _STRIP // n)
    for at in range(0, n, strip):
        i, j = _near(fp, em, slice(at, min(n, at + strip)), slice(at, n), radius)
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
        while len(i):
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root = up
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
    child = np.nonzero(root != np.arange(n))[0]
    return fp[root[child]], fp[child]


def _cells(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_key, left_fp = np.zeros(0, "i8"), np.zeros(0, "i8")

        def forest(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """Links inside every cell of complete, sorted cells; cells of two are compared all at once."""
            us, vs = [], []
            if len(key):
                fp = fp.view("u8")
                first = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
                size = np.diff(np.concatenate([first, [len(key)]]))
                for n in range(2, 9):
                    heads = first[size == n]
                    for x, y in combinations(range(n), 2) if len(heads) else ():
                        a, b = fp[heads + x], fp[heads + y]
                        close = np.bitwise_count(embed(a) ^ embed(b)) <= radius
                        close[close] = np.bitwise_count(a[close] ^ b[close]) <= radius
                        us.append(a[close])
                        vs.append(b[close])
                for at, n in zip(first[size > 8], size[size > 8]):
                    u, v = spanning_forest(fp[at:at + n], radius)
                    us.append(u)
                    vs.append(v)
            u, v = (np.concatenate(x).view("i8") if x else np.zeros(0, "i8") for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            key = np.concatenate([left_key, batch.column("cell").to_numpy()])
            fp = np.concatenate([left_fp, batch.column("fp").to_numpy()])
            done = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last cell may go on
            yield forest(key[:done], fp[:done])
            left_key, left_fp = key[done:], fp[done:]
        yield forest(left_key, left_fp)

    return run


def blocks_for(distinct: int) -> int:
    return next(blocks for most, blocks in BLOCKS if distinct <= most)


def links(distinct: DataFrame, radius: int = MAX_BITS, blocks: int = BLOCKS[0][1], tile: int = TILE) -> DataFrame:
    """Edges (u, v) joining exactly the ``distinct`` fingerprints (fp) that chains of links within ``radius`` join."""
    masks = cell_masks(blocks, radius)
    high, low = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_EVEN)), F.col("fp").bitwiseAND(F.lit(_EVEN))
    embedded = high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))
    members = (distinct.withColumn("em", embedded)
               .select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("em").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)))).alias("cell")))
    large = (members.groupBy("cell").count().filter(F.col("count") > tile)
             .select("cell", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                        lambda t: F.xxhash64("cell", F.least(t, F.col("own")), F.greatest(t, F.col("own"))))
    dealt = (members.join(large, "cell", "left").withColumn("own", own)
             .select("fp", F.explode(F.when(F.col("tiles").isNull(), F.array("cell")).otherwise(pairs)).alias("cell")))
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(radius), "u long, v long").distinct()


def grouped(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """``fingerprints`` with each row's group: root (a fingerprint) and component_id."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    joined = components(links(distinct.select("fp"), radius, blocks or blocks_for(distinct.count())))
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return prints.join(of_print, "fp")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable through links)."""
    return grouped(docs, words, radius, blocks).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """One row of each group: the smallest doc_id (null ids last), then the smallest hash of the text; identical rows count as one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    stay = grouped(docs, words, radius).groupBy("root").agg(first).select(F.col("first.doc_id").alias("__first_id"), F.col("first.text_hash").alias("__first_hash"))
    kept = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__first_id")) & (_text_hash() == F.col("__first_hash")), "left_semi")
    again = Window.partitionBy("doc_id", _text_hash()).orderBy(F.lit(0))
    return kept.withColumn("__again", F.row_number().over(again)).filter("__again = 1").drop("__again")

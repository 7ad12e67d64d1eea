"""Near-duplicate line removal by a deletion-neighbourhood join.

A line is its words between ASCII spaces. Lines are near when so many word edits
(insertions, deletions, substitutions) as their bound turn one into the other; equal lines are
near at any length. The bound is one edit if the longer has MIN_WORDS words or more, and with ``share``
floor(share * its words) where that is more: EDIT_SHARE, which the registered query and the
pipeline give, is a similarity of 0.8 or more at every length. A line goes if an earlier line is near
it; the order is by doc_id, then the hash of the document's text, then the line's number.

1. Every line is hashed (128 bits) and written with its keys (2.), as read; equal lines leave one row with the earliest place, and a number in that order.
2. One edit leaves the first or the second half of a line as it is, so only
   lines that share a half with another can have a line at one edit. For more edits, of lines of
   ``least_words`` words or more: a gram is a run of q words (two; one with a share over a third; the k-th copy of a gram
   counts as a gram of its own). An edit takes away q grams at most, so with all grams in one order the first q * k + 2 of lines
   at k edits have two in common, of which a pair is made later (``common_grams``: one where a share leaves no two). These are a line's keys, for the
   largest number that it needs with any other line (``prefix_sizes``). The order is by frequency, rarest first, in a table of fixed size counted from
   a sixteenth of the documents; any order finds the same lines, a good one compares fewer.
   Lines that share neither are settled. The keys are counted in KEY_PARTS parts, one after another; only the numbers of lines that share a key go on,
   and the words of a line are read from the documents when it is to be compared: a bit map of fixed size (MAP_BITS) over the hashes of
   these lines picks them out; it may let others through, which a join then removes.
3. Lines that share a half emit all variants with one word deleted, as hashed keys: with the
   word's place (equal keys: one substitution) and without (equal to a whole
   shorter line: one deletion). Gram keys that lines share are known from step 2. Every variant key needs only the earliest line that has it,
   so a variant shared by any number of lines costs one row each.
4. Each line and the earliest line of its keys are compared word by
   word; a line with a confirmed earlier neighbour goes. A line that is left is then compared with every earlier line that
   shares two gram keys with it and whose length allows it, so no near line is missed, one edit or more. A key of fewer than
   OFTEN lines (or of a fixed share of the lines, ``often_from``) makes that many pairs a line at most. Each line carries its more frequent keys: by these a pair is made once,
   at the second that the two have in common, and not at all if they have no second. Lines that share many grams, but are not
   near, meet by these keys, but few of them are compared: a line's sketch is the parity of its numbers of words in each of
   SKETCH_BITS classes, of which an edit changes two at most, and a pair is made only if the sketches differ in no more than its bound allows.

Variant keys and halves come from prefix sums, so a line costs as much as its words. The tables on the way are
deleted, and their shuffle files with each, once the kept lines are written.

Nulls and edges: blank lines are never removed; a null or empty text is left as
it is; a document whose every line with words goes is left out by
``remaining``, one that had none stays; null doc_ids come last in the order;
identical rows (doc_id and text) count as one document and keep the same lines; an
empty table gives no rows; other columns are passed through, but for those that ``dedup`` counts into.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import Scratch, arrow_map, materialize, texts

MIN_WORDS = 5
EDIT_SHARE = 0.2
RANK_BITS = 18  # the table of frequencies has 2^18 counts
RANK_SHARE = 16  # one document of so many is counted
BLOCK_WORDS = 1 << 17  # words whose hashes are worked on at once
MAP_BITS = 1 << 25
KEY_MAP_BITS = 1 << 27
OFTEN = 32  # a key of so many lines is carried along with its lines
OFTEN_SHARE = 14  # or of 1 / 2^14 of the lines, where that is more
SKETCH_BITS = 256  # classes of words in a line's sketch
KEY_PARTS = 4  # the keys are counted, and joined to pairs, in so many parts one after another, which bounds the shuffle files
_PAGE = 32768  # bits in a page of Spark's bitmap functions
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACES = " \t\n\r\x0b\x0c"  # what bytes.split() splits at
_SKETCH = [f"sketch_{k}" for k in range(SKETCH_BITS // 64)]
_KEYS = [f"keys_{k}" for k in range(KEY_PARTS)]
_PLACE = ("no_id", "doc_id", "text_hash", "line")


def line_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def line_hash(words: list[bytes]) -> tuple[int, int]:
    """128 bits as two signed longs."""
    x = xxhash.xxh3_128_intdigest(b" ".join(words))
    return tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & (1 << 64) - 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def word_hashes(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one line after another, and the lines' numbers of words; polynomials over the words' bytes."""
    sizes = np.array([len(x) for x in lines], "i8")
    data = np.frombuffer(b" ".join([w for x in lines for w in x]), "u1")
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    spans = np.diff(np.append(starts, len(data)))  # a word with the space after it, which counts as zero
    within = np.arange(len(data)) - np.repeat(starts, spans)
    power = np.multiply.accumulate(np.full(spans.max(), _BASE, "u8"))
    return _mixed(np.add.reduceat(np.where(data == 32, 0, data).astype("u8") * power[within], starts)), sizes


def _blocks(lines: list[list[bytes]]):
    """(first, lines) of runs of lines with BLOCK_WORDS words or few more, or of a single longer line."""
    first, n = 0, 0
    for k, words in enumerate(lines):
        if n and n + len(words) > BLOCK_WORDS:
            yield first, lines[first:k]
            first, n = k, 0
        n += len(words)
    if lines:
        yield first, lines[first:]


def half_keys(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, even hash of a half): both halves, as a line of n words among lines of n, and as the longer of lines of n - 1 and n."""
    starts = np.cumsum(sizes) - sizes
    power = np.multiply.accumulate(np.full(sizes.max(), _BASE, "u8"))
    inverse = np.multiply.accumulate(np.full(sizes.max() + 1, _INVERSE, "u8")) * _BASE
    sums = np.append(np.uint64(0), np.add.accumulate(w * power[np.arange(len(w)) - np.repeat(starts, sizes)]))
    rows, keys = [], []
    for less in (0, 1):
        row = np.flatnonzero((sizes >= MIN_WORDS - 1) & (sizes - less >= MIN_WORDS - 1))
        n, start, short = sizes[row], starts[row], sizes[row] - less
        half = short // 2
        tail = n - (short - half)
        for side, part in ((1, sums[start + half] - sums[start]), (2, (sums[start + n] - sums[start + tail]) * inverse[tail])):
            rows.append(row)
            keys.append((_mixed(part + (short.astype("u8") * np.uint64(4) + np.uint64(side)) * _BASE) & ~np.uint64(1)).view("i8"))
    return np.concatenate(rows), np.concatenate(keys)


def bound(size: np.ndarray | int, share: float) -> np.ndarray:
    """The edits that two lines may differ by, the longer having ``size`` words."""
    return np.floor(share * np.asarray(size) + 1e-9).astype("i8")


def least_words(share: float) -> int:
    """The words of the shortest line that can have a line at two edits or more."""
    longer = max(1, int(2 / share))
    while bound(longer, share) < 2:
        longer += 1
    return max(gram_words(share), longer - 2)


def gram_words(share: float) -> int:
    """The words of a gram: two, if lines within two edits or more share such a gram in any case. Of runs of three, nearly all would be keys."""
    return 2 if share <= 1 / 3 else 1


def common_grams(share: float) -> int:
    """How many grams are asked in common: two, if lines at two edits or more have so many at any length, else one."""
    q = gram_words(share)
    longer = np.arange(1, 8 * q + int(8 / share))
    common = longer - q + 1 - q * bound(longer, share)
    return int(np.clip(common[bound(longer, share) >= 2].min(), 1, 2))


def prefix_sizes(sizes: np.ndarray, share: float) -> np.ndarray:
    """So many first grams has a line: all but q * k of the longer's grams are common at k edits, for the shorter the more the lengths differ, the fewer."""
    q, common = gram_words(share), common_grams(share)
    return np.max([q * bound(sizes + more, share) + common - more for more in range(int(q / share) + 2)], axis=0)


def grams(w: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, 48-bit hash) of the runs of ``gram_words`` words, sorted; lines have so many words or more."""
    q = gram_words(share)
    of_run = w[:len(w) - q + 1]
    for k in range(1, q):
        of_run = of_run * _BASE + w[k:len(w) - q + 1 + k]
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = row[:len(of_run)] == row[q - 1:]
    row, gram = row[:len(of_run)][inside], _mixed(of_run[inside]) >> np.uint64(16)
    order = np.lexsort((gram, row))
    return row[order], gram[order]


def prefixes(w: np.ndarray, sizes: np.ndarray, share: float, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(line, odd key): the first grams of each line by frequency, so many that lines within their bound of edits share one."""
    row, gram = grams(w, sizes, share)
    place = np.arange(len(gram))
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])
    copy = (place - np.maximum.accumulate(np.where(new, place, 0))).astype("u8")
    key = _mixed(_mixed((gram + copy * np.uint64(0xC2B2AE3D27D4EB4F)) * _BASE)) | np.uint64(1)
    often = ranks[(gram & np.uint64(len(ranks) - 1)).astype("i8")] if ranks is not None else np.zeros(len(gram), "i8")
    order = np.lexsort((key, often, row))
    starts = np.searchsorted(row, np.arange(len(sizes)))
    keep = place - starts[row] < prefix_sizes(sizes, share)[row]
    return row[order][keep], key[order][keep].view("i8")


def _parities(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    bit, word = np.uint64(1) << w % np.uint64(64), (w >> np.uint64(6)) % np.uint64(len(_SKETCH))
    return np.stack([np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts) for k in range(len(_SKETCH))], axis=1).view("i8")


def sketches(lines: list[list[bytes]]) -> np.ndarray:
    """Lines by SKETCH_BITS bits: those of the classes of which a line has an odd number of words."""
    out = np.zeros((len(lines), len(_SKETCH)), "i8")
    for first, block in _blocks(lines):
        out[first:first + len(block)] = _parities(*word_hashes(block))
    return out


def filter_keys(lines: list[list[bytes]], share: float = 0, ranks: np.ndarray | None = None, sketched: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(line, key), by line: the keys of the halves (even) and, with ``share``, of the first grams (odd). ``sketched`` gets the sketches of lines with grams."""
    rows, keys = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for first, block in _blocks(lines):
        w, sizes = word_hashes(block)
        row, key = half_keys(w, sizes)
        rows.append(row + first)
        keys.append(key)
        long = sizes >= least_words(share) if share else np.zeros(len(sizes), bool)
        if long.any():
            of_long = w[np.repeat(long, sizes)]
            row, key = prefixes(of_long, sizes[long], share, ranks)
            rows.append(np.flatnonzero(long)[row] + first)
            keys.append(key)
            if sketched is not None:
                sketched[first + np.flatnonzero(long)] = _parities(of_long, sizes[long])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))


def _gram_counts(batch: pa.RecordBatch, share: float) -> pa.RecordBatch:
    total = np.zeros(1 << RANK_BITS, "i8")
    lines = (words for text in texts(batch.column("text")) for line in text.split("\n") if len(words := line_words(line)) >= least_words(share))
    for _, block in _blocks(list(lines)):
        _, gram = grams(*word_hashes(block), share)
        total += np.bincount((gram & np.uint64(len(total) - 1)).astype("i8"), minlength=len(total))
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], names=["place", "n"])


def frequencies(docs: DataFrame, share: float) -> np.ndarray:
    """How often the grams occur in a sixteenth of the documents, in a table of fixed size; only the order of a line's grams depends on it."""
    counted = _source(docs).filter(F.pmod("text_hash", F.lit(RANK_SHARE)) == 0).select("text")
    found = arrow_map(counted, lambda: partial(_gram_counts, share=share), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    ranks = np.zeros(1 << RANK_BITS, "i8")
    ranks[found["place"].to_numpy()] = found["n"].to_numpy()
    return ranks


def key_part(key: np.ndarray) -> np.ndarray:
    return (key >> 1) % KEY_PARTS


def _hash_lines(share: float = 0, shared=None):
    def make():
        ranks = shared.value if shared is not None else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs, text_hashes, lines, highs, lows, said = [], [], [], [], [], []
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts(batch.column("text"))):
                for k, line in enumerate(text.split("\n")):
                    if words := line_words(line):
                        high, low = line_hash(words)
                        docs.append(doc_id)
                        text_hashes.append(text_hash)
                        lines.append(k)
                        highs.append(high)
                        lows.append(low)
                        said.append(words)
            sketched = np.zeros((len(said), len(_SKETCH)), "i8")
            row, key = filter_keys(said, share, ranks, sketched)
            keys = []
            for part in range(KEY_PARTS):
                of_part = key_part(key) == part
                ends = np.cumsum(np.bincount(row[of_part], minlength=len(said)))
                keys.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("i4")), pa.array(key[of_part])))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            sizes = [len(words) for words in said]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip((docs, text_hashes, lines, highs, lows, sizes), kinds)),
                                               *(pa.array(np.ascontiguousarray(x)) for x in sketched.T), *keys],
                                              names=["doc_id", "text_hash", "line", "high", "low", "size", *_SKETCH, *_KEYS])

        return step

    return make


def hashed_lines(docs: DataFrame, share: float = 0) -> DataFrame:
    """Every line with words: its place, 128-bit hash, size (words), sketch, and its keys in KEY_PARTS lists."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, share)) if share else None
    schema = ["doc_id long, text_hash long, line int, high long, low long, size int", *(f"{c} long" for c in _SKETCH), *(f"{c} array<long>" for c in _KEYS)]
    return arrow_map(_source(docs), _hash_lines(share, shared), ", ".join(schema))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """high, low, size, sketch and the earliest place of every distinct line, and a number that follows the places."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "line")
    found = lines.groupBy("high", "low").agg(F.min(place).alias("place"), *(F.first(c).alias(c) for c in ("size", *_SKETCH))).select("high", "low", "size", *_SKETCH, "place.*")
    return found.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE).withColumn("number", F.monotonically_increasing_id())


def bit_map(values: DataFrame, column: str, bits: int = MAP_BITS, saved: Scratch | None = None) -> np.ndarray:
    """A map of fixed size in which every value's bit is set; with ``saved``, its pages are written first, so that their shuffle files go at once."""
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    pages = values.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    if saved is not None:
        pages = saved.table(pages, name := f"bits-{uuid.uuid4().hex[:12]}")
    out = np.zeros(bits // 8, "u1")
    for r in pages.collect():
        k = (r["page"] - 1) * _PAGE // 8
        out[k:k + _PAGE // 8] = np.frombuffer(r["bits"], "u1")
    if saved is not None:
        saved.drop(name)
    return out


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, len(bits) * 8)
    return bits[at >> 3] >> (at & 7).astype("u1") & 1 == 1


def _held_keys(shared):
    def make():
        bits = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = batch.column(2)
            row, key = pc.list_parent_indices(keys).to_numpy(), keys.flatten().to_numpy()
            keep = in_map(bits, key)
            held, sizes = np.unique(row[keep], return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("i4")), pa.array(key[keep]))
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(held)) for c in range(2)), lists], names=["high", "low", "keys"])

        return step

    return make


def shared_keys(lines: DataFrame, places: DataFrame, saved: Scratch) -> DataFrame:
    """key, number, often: the keys that a line shares with another, and whether as many lines have it as ``often_from`` says.
    A part of the keys after another; copies of a line, which have its hash, are counted apart from other lines only in ``often``."""
    parts, least = [], often_from(places.count())
    for k, column in enumerate(_KEYS):
        keys = lines.select("high", F.explode(column).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("high").alias("least"), F.max("high").alias("most"))
        shared = saved.table(keys.filter("least < most").select("key", (F.col("n") >= least).alias("often")), f"shared-keys/part={k}")
        bits = lines.sparkSession.sparkContext.broadcast(bit_map(shared, "key", KEY_MAP_BITS, saved))
        held = arrow_map(lines.select("high", "low", column), _held_keys(bits), "high long, low long, keys array<long>").groupBy("high", "low").agg(F.first("keys").alias("keys"))
        numbered = held.join(places.select("high", "low", "number"), ["high", "low"]).select("number", F.explode("keys").alias("key"))
        parts.append(saved.table(numbered.join(shared, "key").select("key", "number", "often"), f"held-keys/part={k}"))
        saved.drop(f"shared-keys/part={k}")
        bits.destroy()  # a file on every machine
    return reduce(DataFrame.unionByName, parts)


def often_from(lines: int) -> int:
    """The number of lines from which a key is carried along: OFTEN, and in larger tables the same share of the lines, so that what is carried grows with them."""
    return max(OFTEN, lines >> OFTEN_SHARE)


def often_keys(held: DataFrame) -> DataFrame:
    """number and the sorted gram keys that are often, of the lines with any."""
    return held.filter("often and key % 2 <> 0").groupBy("number").agg(F.array_sort(F.collect_list("key")).alias("often_keys"))


def _read_lines(shared):
    def make():
        bits = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[tuple[int, int], bytes] = {}
            for text in texts(batch.column("text")):
                for line in text.split("\n"):
                    if len(words := line_words(line)) >= MIN_WORDS - 1:
                        found.setdefault(line_hash(words), b" ".join(words))
            high = np.array([h for h, _ in found], "i8")
            keep = in_map(bits, high) if len(high) else np.zeros(0, bool)
            rows = [(h, low, words) for (h, low), words, k in zip(found, found.values(), keep) if k]
            cols = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["high", "low", "words"])

        return step

    return make


def numbered_lines(docs: DataFrame, numbers: DataFrame, saved: Scratch) -> DataFrame:
    """``numbers`` (high, low, number, and more) with the lines' words, which are read from the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(numbers, "high", saved=saved))
    read = arrow_map(_source(docs).select("text"), _read_lines(shared), "high long, low long, words binary")
    return read.join(numbers, ["high", "low"]).dropDuplicates(["high", "low"])


def _of_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("number").unionByName(pairs.select(F.col("earlier").alias("number"))).distinct()


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles): 0 a substitution's, 1 the whole line's, 2 a deletion's."""
    n = len(words)
    power = np.full(n + 1, _BASE, "u8")
    power[0] = 1
    power = np.multiply.accumulate(power)
    w = np.array([xxhash.xxh64_intdigest(x) for x in words], "u8")
    sums = np.concatenate([np.zeros(1, "u8"), np.add.accumulate(w * power[:n])])
    without = sums[:n] + (sums[n] - sums[1:]) * _INVERSE
    mix = lambda x, kind, k: (x + np.uint64(kind)) * _BASE ^ (np.asarray(k, "u8") + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole, deleted = mix(sums[n:], 1, [n]), np.unique(mix(without, 1, [n - 1]))
    substituted = mix(without, 2, np.arange(n) * (1 << 32) + n) if n >= MIN_WORDS else without[:0]
    deleted = deleted if n >= MIN_WORDS else deleted[:0]
    keys = np.concatenate([substituted, whole, deleted]).view("i8")
    roles = np.repeat(np.array([0, 1, 2], "i4"), [len(substituted), 1, len(deleted)])
    return keys, roles


def _emit(shared=None):
    def make():
        bits = shared.value if shared is not None else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, roles, numbers = [np.zeros(0, "i8")], [np.zeros(0, "i4")], [np.zeros(0, "i8")]
            for words, number in zip(batch.column("words").to_pylist(), batch.column("number").to_pylist()):
                k, r = variants(words.split(b" "))
                if bits is not None:
                    keep = in_map(bits, k)
                    k, r = k[keep], r[keep]
                keys.append(k)
                roles.append(r)
                numbers.append(np.full(len(k), number, "i8"))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, roles, numbers)], names=["key", "role", "number"])

        return step

    return make


_VARIANT = "key long, role int, number long"


def variant_neighbours(numbered: DataFrame, saved: Scratch) -> DataFrame:
    """(number, earlier): each line with the earliest line of each deletion variant that makes it a neighbour."""
    rows = numbered.filter("half").select("words", "number")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("number")))
    keys = saved.table(arrow_map(rows, _emit(), _VARIANT).groupBy("key").agg(
        F.count("*").alias("n"), least(0).alias("substituted"), least(1).alias("whole"), least(2).alias("deleted"))
        .filter("n > 1 and (substituted is not null or (whole is not null and deleted is not null))").drop("n"), "variant-keys")
    shared = numbered.sparkSession.sparkContext.broadcast(bit_map(keys, "key", saved=saved))
    again = arrow_map(rows, _emit(shared), _VARIANT).join(keys, "key")
    earlier = F.when(F.col("role") == 0, F.col("substituted")).when(F.col("role") == 1, F.col("deleted")).otherwise(F.col("whole"))
    return again.select("number", earlier.alias("earlier")).filter("earlier < number")


def keyed_lines(places: DataFrame, held: DataFrame) -> DataFrame:
    """key, often, number, size, often_keys: the lines of each gram key."""
    numbers = places.select("number", "size").join(often_keys(held), "number", "left")
    return held.filter("key % 2 <> 0").join(numbers, "number").select("key", "often", "number", "size", "often_keys")


def _alike(share: float, sketched: bool):
    """(bound, whether the lengths of a row's two lines, and the sketches, allow so many edits or one)."""
    most = F.floor(F.greatest("size", "earlier_size") * F.lit(float(share)) + F.lit(1e-9))
    longer = F.abs(F.col("size") - F.col("earlier_size"))
    # a word more or less changes one bit, another word two
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"earlier_{c}"))) for c in _SKETCH * sketched), F.lit(0))
    bound = F.greatest(most, F.lit(1))
    return most, (longer <= bound) & (differ <= 2 * bound - longer)


def _as_earlier(lines: DataFrame) -> DataFrame:
    return lines.select(*(F.col(c).alias("earlier" if c == "number" else f"earlier_{c}") for c in lines.columns))


def first_neighbours(keyed: DataFrame, share: float, sketched: DataFrame) -> DataFrame:
    """(number, earlier): each line with the earliest line of its gram keys, if the two share as many as near lines do and their sketches (number, size,
    sketch) allow it."""
    keyed = keyed.select("key", "number")
    pairs = keyed.join(keyed.groupBy("key").agg(F.min("number").alias("earlier")), "key").filter("earlier < number")
    pairs = pairs.groupBy("number", "earlier").count().filter(F.col("count") >= common_grams(share)).select("number", "earlier")
    return pairs.join(sketched, "number").join(_as_earlier(sketched), "earlier").filter(_alike(share, True)[1]).select("number", "earlier")


def _pair_rows(keyed: DataFrame, gone: DataFrame, share: float, sketched: DataFrame | None = None) -> DataFrame:
    """number, earlier, n (1 for a key of fewer than OFTEN lines), n_often (the keys of OFTEN lines or more that the two have in common)."""
    if sketched is not None:
        keyed = keyed.join(sketched, "number")
    earlier = _as_earlier(keyed.drop("often")).withColumnRenamed("earlier_key", "key")
    most, alike = _alike(share, sketched is not None)
    common = F.array_intersect("often_keys", "earlier_often_keys")  # in the order of the first
    made = ~F.col("often") | (F.get(common, F.lit(common_grams(share) - 1)) == F.col("key"))
    pairs = keyed.join(gone, "number", "left_anti").join(earlier, "key").filter((F.col("earlier") < F.col("number")) & (most >= 2) & alike & made)
    return pairs.select("number", "earlier", (~F.col("often")).cast("int").alias("n"), F.coalesce(F.size(common), F.lit(0)).alias("n_often"))


def all_neighbours(keyed: DataFrame, gone: DataFrame, share: float, saved: Scratch | None = None, sketched: DataFrame | None = None) -> DataFrame:
    """(number, earlier): lines that are not ``gone`` (number) with all earlier lines that share as many gram keys as near lines do, as far as the
    lengths allow two edits or more. Of the keys of OFTEN lines or more, only the last that is needed makes a pair; the others count by the lines' lists.
    With ``saved``, the keys are joined in KEY_PARTS parts one after another; with ``sketched``, pairs whose sketches differ in too much are left out."""
    if saved is None:
        rows = _pair_rows(keyed, gone, share, sketched)
    else:
        rows = reduce(DataFrame.unionByName, [
            saved.table(_pair_rows(keyed.filter(F.pmod(F.shiftright("key", 1), F.lit(KEY_PARTS)) == k), gone, share, sketched), f"pair-rows/part={k}") for k in range(KEY_PARTS)])
    return (rows.groupBy("number", "earlier").agg((F.sum("n") + F.max("n_often")).alias("n"))
            .filter(F.col("n") >= common_grams(share)).select("number", "earlier"))


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word edit, or none, makes the two equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    most = min(len(a), len(b))
    head = next((k for k in range(most) if a[k] != b[k]), most)
    tail = next((k for k in range(most - head) if a[-1 - k] != b[-1 - k]), most - head)
    return head + tail >= max(len(a), len(b)) - 1


def edits(a: list[bytes], b: list[bytes]) -> int:
    """Word edits from one to the other (bit-parallel)."""
    n = len(a)
    if not n:
        return len(b)
    masks: dict[bytes, int] = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    for w in b:
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return score


def near(a: list[bytes], b: list[bytes], share: float = 0) -> bool:
    """Whether the two are equal or within their bound of word edits."""
    most = max(len(a), len(b))
    bound = int(share * most + 1e-9)
    if bound < 2 or one_edit(a, b):
        return a == b or most >= MIN_WORDS and one_edit(a, b)
    # every edit leaves all but one of the longer's words
    return sum((Counter(a) & Counter(b)).values()) >= most - bound and edits(a, b) <= bound


def _confirm(batch: pa.RecordBatch, share: float = 0) -> pa.RecordBatch:
    confirmed = [near(a.split(b" "), b.split(b" "), share) for a, b in zip(batch.column("words").to_pylist(), batch.column("earlier_words").to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column("high"), batch.column("low"), batch.column("number"), pa.array(confirmed, pa.bool_())], names=["high", "low", "number", "near"])


def confirmed_lines(numbered: DataFrame, pairs: DataFrame, share: float = 0) -> DataFrame:
    """high, low, number of the lines with a near line among ``pairs``."""
    earlier = numbered.select(F.col("number").alias("earlier"), F.col("words").alias("earlier_words"))
    both = numbered.join(pairs, "number").join(earlier, "earlier").select("high", "low", "number", "words", "earlier_words")
    return arrow_map(both, lambda: partial(_confirm, share=share), "high long, low long, number long, near boolean").filter("near").select("high", "low", "number").distinct()


def near_lines(docs: DataFrame, places: DataFrame, held: DataFrame, saved: Scratch, share: float = 0) -> DataFrame:
    """high, low of the lines that have a near line before them; ``held`` is deleted on the way."""
    half = saved.table(held.filter("key % 2 = 0").select("number").distinct().withColumn("half", F.lit(True)), "half-lines")
    wanted = half
    if share:
        sketched = places.select("number", "size", *_SKETCH)
        keyed = saved.table(keyed_lines(places, held), "gram-keys")
        first = saved.table(first_neighbours(keyed, share, sketched), "first-pairs")
        wanted = half.join(_of_pairs(first), "number", "full")
    saved.drop("held-keys")
    placed = places.select("high", "low", "number")
    numbered = saved.table(numbered_lines(docs, saved.table(placed.join(wanted, "number"), "wanted-lines"), saved), "numbered-lines")
    pairs = variant_neighbours(numbered, saved)
    pairs = saved.table((pairs.unionByName(first) if share else pairs).distinct(), "pairs")
    saved.drop("variant-keys", "half-lines", "wanted-lines")
    found = confirmed_lines(numbered, pairs, share)
    if share:
        found = saved.table(found, "first-near-lines")
        saved.drop("pairs", "first-pairs", "numbered-lines")
        more = all_neighbours(keyed, found.select("number"), share, saved, sketched.drop("size"))
        more = saved.table(more, "all-pairs")
        saved.drop("gram-keys", "pair-rows")
        numbered = saved.table(numbered_lines(docs, saved.table(placed.join(_of_pairs(more), "number"), "more-lines"), saved), "more-numbered-lines")
        found = found.unionByName(confirmed_lines(numbered, more, share))
    return found.select("high", "low").distinct()


def kept_lines(docs: DataFrame, share: float = 0) -> DataFrame:
    """__id, __hash and the numbers of the lines that stay, by document; a written table, while those on the way to it are deleted."""
    with Scratch(docs.sparkSession, "line-dedup") as saved:
        lines = saved.table(hashed_lines(docs, share), "lines")
        places = saved.table(distinct_lines(lines), "places")
        held = shared_keys(lines, places, saved)
        saved.drop("lines")
        near_ = saved.table(near_lines(docs, places, held, saved, share), "near-lines")
        stay = places.join(near_, ["high", "low"], "left_anti")
        return materialize(stay.groupBy("no_id", "doc_id", "text_hash").agg(F.collect_list("line").alias("__lines"))
                           .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__lines"), "kept-lines")


def dedup(docs: DataFrame, before: str = "n_lines", after: str = "n_kept", share: float = 0) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and the number of its lines with words, before and after; columns of these two names are replaced."""
    docs = docs.drop(before, after)
    kept = kept_lines(docs, share)
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.withColumn("__h", text_hash).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    names = docs.columns
    where = names.index("text")
    schema = StructType([*docs.schema.fields, StructField(before, IntegerType()), StructField(after, IntegerType())])

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, had, have = [], [], []
        for text, lines_ in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
            parts = (text or "").split("\n")
            worded = [bool(x.strip(_SPACES)) for x in parts]
            kept_ = set(lines_ or ())
            out.append(text if text is None else "\n".join(x for k, x in enumerate(parts) if not worded[k] or k in kept_))
            had.append(sum(worded))
            have.append(len(kept_))
        columns = [pa.array(out, batch.schema.field(where).type) if k == where else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(had, pa.int32()), pa.array(have, pa.int32())], names=[*names, before, after])

    return arrow_map(joined.select(*(docs[c] for c in names), "__lines"), lambda: rebuild, schema)


def remaining(docs: DataFrame, share: float = 0) -> DataFrame:
    """``docs`` after ``dedup``, without documents that lost every line with words; the columns are those of ``docs``."""
    return dedup(docs, "__before", "__after", share).filter("__before = 0 or __after > 0").select(*docs.columns)

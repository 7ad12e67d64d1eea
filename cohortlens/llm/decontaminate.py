"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are word sequences (letters and digits, lower case; each character is a
word in scripts written without spaces: Chinese, Japanese, Thai, Lao, Khmer, Burmese). An item
of n words is found in a document if some window lies within
``floor(EDIT_SHARE * n)`` word edits of it (a similarity of 0.8 or more).

The CGK embedding is a random walk over a sequence: step j writes the current
word and stays on it or moves on, by a random bit of (j, word). Sequences a few
edits apart write mostly the same, so their edit distance becomes a Hamming
distance, and equal sampled coordinates are an LSH key. Each repetition has its
own bits, its own coordinates, and an anchor: how far into the item its walk
starts, so that the repetitions together cover the whole item-sized window
wherever the edits are. Walks start at every word of every document. The number
of repetitions is the least that finds ``recall`` of simulated copies with
as many random edits as the bound allows (``search_plan``). Item lengths whose own
copies it finds less often than that are also searched exactly: an item is cut into one piece
more than its bound, so one piece must occur unchanged.

A key that agrees is a candidate; the exact distance decides (bit-parallel
approximate matching over the window and as many words around it as may have
been inserted), so no reported match is wrong.

Words outside the benchmark's vocabulary all count as one word that equals no
item word, which leaves every distance as it is. Items are taken in blocks of
at most ITEMS_AT_ONCE, each block against all documents; a block is what the
driver and each task hold.

Nulls and edges: null or empty texts and items match nothing; items under
MIN_WORDS words (ordinary text holds them by chance) are searched from ``least`` words on, exactly: their
bound is no edit; the registered query and the pipeline search all; null
doc_ids are searched and reported; repeated items are separate items; repeated
rows are searched one by one; empty tables give no rows; other columns are
ignored (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import arrow_map, texts

MIN_WORDS = 5
EDIT_SHARE = 0.2
RECALL = 0.99
SAMPLED = 5  # coordinates of a key
WALK = 12  # steps that coordinates are sampled from
MOST_REPETITIONS = 48
TRIALS = 1000
TRIALS_A_LENGTH = 300
ITEMS_AT_ONCE = 2000
# letters, digits and vowel signs of scripts without spaces between words, without their punctuation
_SPACELESS = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0ebd\u0ec0-\u0ece\u0ed0-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17d7\u17dc-\u17e9"
    "\u3005-\u3007\u3021-\u3029\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
_WORD = re.compile(rf"[{_SPACELESS}]|[^\W_{_SPACELESS}]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def within(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and the end of the first such part (bit-parallel)."""
    n = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for at, w in enumerate(text):
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if score < best:
            best, end = score, at + 1
    return best, end


def best_window(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the best part of ``text``: the first end, then the longest... shortest start for it."""
    edits, end = within(item, text)
    _, size = within(item[::-1], text[:end][::-1])
    return edits, end - size, end


class Finder:
    """Candidate search and verification for one block of items."""

    def __init__(self, items: list[tuple[int, str]], repetitions: int, seed: int = 5, exact: frozenset[int] = frozenset(), least: int = MIN_WORDS):
        """``exact``: length classes (``length_class``) that are searched exactly as well, as items under MIN_WORDS words are."""
        self.ids, self.items = [], []
        self.vocabulary: dict[str, int] = {}
        for item_id, text in items:
            ws = words(text or "")
            if ws and len(ws) >= least:
                self.ids.append(item_id)
                self.items.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws])
        self.bound = [int(EDIT_SHARE * len(x)) for x in self.items]
        self.tables = [self._table(r, np.random.default_rng([seed, r])) for r in range(repetitions)]
        self.pieces = self._pieces([k for k, x in enumerate(self.items) if len(x) < MIN_WORDS or length_class(len(x)) in exact])

    def _table(self, r: int, rng: np.random.Generator) -> list[tuple]:
        """For short and long items: bits of every word, coordinates, and the items' keys with their anchors."""
        bits = rng.integers(0, 1 << 63, len(self.vocabulary) + 1, dtype="u8")
        share = float(rng.random())
        out = []
        for low, high in ((MIN_WORDS, WALK), (WALK, 1 << 60)):
            # the first word is always sampled, so most windows are settled at once
            at = [0, *sorted((1 + rng.choice(low - 1, SAMPLED - 1, replace=False)).tolist())]
            keys: list[list[int]] = []
            for k, item in enumerate(self.items):
                if low <= len(item) < high:
                    anchor = round(share * (len(item) - low))
                    p, key = anchor, []
                    for j in range(low):
                        if j in at:
                            key.append(item[p])
                        p += int(bits[item[p]]) >> j & 1
                    keys.append([*key, k, anchor])
            if keys:
                found = np.array(keys, "i8")
                packed = self._pack(list(found[:, :SAMPLED].T))
                order = np.argsort(packed, kind="stable")
                first = np.zeros(len(self.vocabulary) + 1, bool)
                first[found[:, 0]] = True
                out.append((bits, at, low, first, packed[order], found[order, SAMPLED], found[order, SAMPLED + 1]))
        return out

    def _pieces(self, chosen: list[int]) -> list[tuple]:
        """By piece length: the pieces' first words, keys, items and places in the item."""
        rows: dict[int, list[list[int]]] = {}
        for k in chosen:
            item, parts = self.items[k], self.bound[k] + 1
            cuts = [len(item) * j // parts for j in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                rows.setdefault(b - a, []).append([*item[a:b], k, a])
        out = []
        for size, found in sorted(rows.items()):
            table = np.array(found, "i8")
            packed = self._pack(list(table[:, :size].T))
            order = np.argsort(packed, kind="stable")
            first = np.zeros(len(self.vocabulary) + 1, bool)
            first[table[:, 0]] = True
            out.append((size, first, packed[order], table[order, size], table[order, size + 1]))
        return out

    def _pack(self, columns: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(columns[0]), "u8")
        for c in columns:
            key = key * np.uint64(0x9E3779B97F4A7C15) + c.astype("u8") + np.uint64(1)
        return key

    def _agreeing(self, columns: list[np.ndarray], keys: np.ndarray, item: np.ndarray, anchor: np.ndarray, start: np.ndarray) -> np.ndarray:
        packed = self._pack(columns)
        low, high = np.searchsorted(keys, packed, "left"), np.searchsorted(keys, packed, "right")
        hit = np.flatnonzero(high > low)
        n = (high - low)[hit]
        which = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        walk = np.repeat(start[hit], n)
        return np.column_stack([item[which], walk - anchor[which], walk])

    def candidates(self, symbols: np.ndarray, tables: list | None = None) -> np.ndarray:
        """(item, place where the item would start, walk's start) of all agreeing keys; ``symbols`` ends in WALK zeros."""
        found = []
        for table in self.tables if tables is None else tables:
            for bits, at, steps, first, keys, item, anchor in table:
                start = np.flatnonzero(first[symbols])
                start = start[start < len(symbols) - steps]
                p, columns = start.copy(), [symbols[start]]
                for j in range(at[-1]):
                    p += (bits[symbols[p]] >> np.uint64(j) & np.uint64(1)).astype("i8")
                    if j + 1 in at:
                        columns.append(symbols[p])
                found.append(self._agreeing(columns, keys, item, anchor, start))
        for size, first, keys, item, at in self.pieces:
            start = np.flatnonzero(first[symbols])
            start = start[start + size <= len(symbols)]
            found.append(self._agreeing([symbols[start + j] for j in range(size)], keys, item, at, start))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), "i8")

    def symbols(self, batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as numbers, zeros between texts, and where each text begins."""
        get, flat, starts = self.vocabulary.get, [], []
        for ws in batch:
            starts.append(len(flat))
            flat.extend([get(w, 0) for w in ws])
            flat.extend([0] * WALK)
        return np.array(flat, "i4"), np.array(starts, "i8")

    def matches(self, batch: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start word, end word): the best window of each item found in each text."""
        split = [words(t) for t in batch]
        symbols, starts = self.symbols(split)
        if not len(symbols) or not self.items:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        looked: dict[tuple[int, int], int] = {}
        for item, place, walk in self.candidates(symbols).tolist():
            words_, bound = self.items[item], self.bound[item]
            text = int(np.searchsorted(starts, walk, "right")) - 1
            if looked.get((text, item), place - 1) >= place:
                continue  # the last look at this pair has covered this place
            a = max(int(starts[text]), place - 2 * bound)
            b = min(int(starts[text]) + len(split[text]), place + len(words_) + 4 * bound)
            looked[text, item] = place + bound
            edits, start, end = best_window(words_, symbols[a:b].tolist())
            if edits <= bound:
                found = (edits, a + start - int(starts[text]), a + end - int(starts[text]))
                best[text, item] = min(best.get((text, item), found), found)
        return [(t, self.ids[i], *v) for (t, i), v in sorted(best.items())]


def edited(item: list[str], edits: int, rng: random.Random) -> list[str]:
    out = list(item)
    for k in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not out:
            out.insert(at, f"+{k}")
        elif kind == 1:
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = f"+{k}"
    return out


def length_class(n: int) -> int:
    """The length itself up to 64 words, above that the power of two below it."""
    return n if n <= 64 else 1 << n.bit_length() - 1


def search_plan(items: list[tuple[int, str]], recall: float = RECALL, trials: int = TRIALS, seed: int = 5) -> tuple[int, frozenset[int]]:
    """Least number of repetitions that find ``recall`` of copies with as many random edits as the bound allows, and
    the length classes that miss it at that number."""
    finder = Finder(items, MOST_REPETITIONS, seed)  # without the short items, which need no repetition
    rng = random.Random(seed)
    missed = _missed(finder, [rng.randrange(len(finder.items)) for _ in range(trials if finder.items else 0)], rng)
    repetitions = next((r for r, open_ in enumerate(missed, 1) if len(open_) <= (1 - recall) * trials), MOST_REPETITIONS)
    classes: dict[int, list[int]] = {}
    for k, item in enumerate(finder.items):
        classes.setdefault(length_class(len(item)), []).append(k)
    finder.tables = finder.tables[:repetitions]
    chosen = [rng.choice(classes[c]) for c in sorted(classes) for _ in range(TRIALS_A_LENGTH)]
    *_, open_ = _missed(finder, chosen, rng)
    lost = Counter(length_class(len(finder.items[chosen[t]])) for t in open_)
    return repetitions, frozenset(c for c, n in lost.items() if n > (1 - recall) * TRIALS_A_LENGTH)


def _missed(finder: Finder, chosen: list[int], rng: random.Random):
    """After each of the finder's repetitions: the places in ``chosen`` of the items whose edited copies none has found."""
    names = {v: k for k, v in finder.vocabulary.items()}
    copies = [edited([names[w] for w in finder.items[k]], finder.bound[k], rng) for k in chosen]
    symbols, starts = finder.symbols(copies)
    open_ = set(range(len(chosen)))
    for table in finder.tables:
        for item, place, walk in finder.candidates(symbols, [table]).tolist() if open_ else ():
            t = int(np.searchsorted(starts, walk, "right")) - 1
            if chosen[t] == item and abs(place - int(starts[t])) <= finder.bound[item]:
                open_.discard(t)
        yield open_


def item_blocks(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE):
    """Lists of (item_id, text), each of about ``at_once`` items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    blocks = -(-rows.count() // at_once)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for k in range(blocks):
        block = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows.filter(part == k).collect())
        if block:
            yield block


def _places(text: str, start: int, end: int) -> tuple[int, int]:
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    return spans[start][0], spans[end - 1][1]


def find(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, edits, start_char, end_char: the best window of each item in each document that holds it."""
    schema = "doc_id long, item_id long, edits int, start_char int, end_char int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        out = out.unionByName(arrow_map(rows, _reporter(block, *search_plan(block, recall), least), schema))
    return out


def _reporter(block: list[tuple[int, str]], repetitions: int, exact: frozenset[int], least: int):
    def make():
        finder = Finder(block, repetitions, exact=exact, least=least)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines, ids = texts(batch.column("text")), batch.column("doc_id").to_pylist()
            rows = [(ids[t], item, edits, *_places(lines[t], start, end)) for t, item, edits, start, end in finder.matches(lines)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "edits", "start_char", "end_char"])

        return step

    return make


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, least: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    for block in item_blocks(benchmark):
        schema = StructType([*docs.schema.fields, StructField("__leaks", BooleanType())])
        marked = arrow_map(docs.withColumn("__text", F.col("text").cast("string")), _marker(block, *search_plan(block, recall), least, docs.columns), schema)
        docs = marked.filter("not __leaks").drop("__leaks")
    return docs


def _marker(block: list[tuple[int, str]], repetitions: int, exact: frozenset[int], least: int, names: list[str]):
    def make():
        finder = Finder(block, repetitions, exact=exact, least=least)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            leaks = np.zeros(batch.num_rows, bool)
            leaks[[m[0] for m in finder.matches(texts(batch.column("__text")))]] = True
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(leaks)], names=[*names, "__leaks"])

        return step

    return make

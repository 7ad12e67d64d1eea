"""Cross-tokenizer alignment: token groups of two tokenizers over one text, and corpus-wide counts of linked id pairs.

``align`` encodes space+text with a byte-level BPE (A) and a sentencepiece BPE
(B, which puts the space itself). Byte offsets at which tokens of both end cut
the tokens into groups; the two tokens that end there are a link. Both
tokenizers cut before a single space and before a line break between two other
characters, so a text's groups are those of its chunks in order; chunks recur
and each is encoded and aligned once per worker.

``score`` counts every linked id pair over the whole corpus by external spill
counting. Map tasks gather (pair, document, number) records into runs, sort a
run side-major (B id, then A id), cut it by radix buckets of B ids and write
each piece as zstd blocks to the shared folder. A bucket's task merges the
pieces of all runs with a heap, a block of each at a time: equal pairs meet and
are counted, and since all pairs of a B id stand together its highest count is
known when the next B id comes. The blocks then stream their documents'
contributions back to the run they came from, where they are added up.

A B id with more records than a bucket holds gets several buckets, dealt by
run and document; its pairs' counts are then sums over these buckets, made
before the merge from the pieces' own sums (``_hot_totals``). A bucket's size is
a constant, so tasks grow in number, not in size.

Nulls and edges: a null or empty text, and one whose joined token bytes of
either tokenizer differ from space+text, has no tokens: zeros and ''. Null and
repeated doc_ids are documents of their own, identical rows count each; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, texts
from .word_memo import _CUT, _RUNS, WordMemo, tokenizer_path

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
KEY_BITS = 24  # a pair is B id << KEY_BITS | A id
MEMO_CHARS = 8_000_000  # characters of chunks kept in a worker before the memo starts anew
RUN_RECORDS = 1 << 20  # records that a map task sorts at once
BLOCK_RECORDS = 1 << 14  # records of a zstd block, at least one pair
BUCKET_RECORDS = 1 << 21  # records that one merge takes


def _byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary_a(tokenizer) -> list[bytes]:
    byte = _byte_level()
    vocabulary = tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def vocabulary_b(model) -> list[bytes]:
    def of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return [of(i) for i in range(model.get_piece_size())]


class Aligner:
    """Chunks and their alignments. A chunk is a text's part without its leading space; one after a line break keeps the break."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = WordMemo(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = vocabulary_a(self.a.whole), vocabulary_b(self.b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the second vocabulary spans a space or a line break")
        self.space_b = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (np.array([len(x) for x in v], "i8") for v in (self.bytes_a, self.bytes_b))
        # id and the mark after it, inside a group and at the end of its A or B ids
        self.said = ([b"%d%c" % (i, mark) for i in range(len(self.bytes_a)) for mark in b",|"]
                     + [b"%d%c" % (i, mark) for i in range(len(self.bytes_b)) for mark in b",;"])
        self.forget()

    def forget(self) -> None:
        self.memo: dict = {}
        self.chars = 0
        self.groups: list[bytes] = []
        self.n_a, self.n_b, self.n_links = (np.zeros(0, "i8") for _ in range(3))
        self.good, self.at, self.keys = np.zeros(0, bool), np.zeros(1, "i8"), np.zeros(0, "i8")

    def _encode(self, new: list) -> tuple[list[np.ndarray], list[list[int]], list[bytes]]:
        """A ids, B ids and bytes of new chunks; a text's head is a tuple that holds all its characters."""
        said = [c[0] if isinstance(c, tuple) else c if c[0] == "\n" else " " + c for c in new]
        learnt = self.a._learn([c for c in new if isinstance(c, str)])
        heads = [c for c in new if isinstance(c, tuple)]
        learnt |= {c: x.tobytes() for c, x in zip(heads, self.a._ids(self.a.whole, [c[0] for c in heads]))}
        ids_b = self.b.encode([s if s[0] == "\n" else s[1:] for s in said], num_threads=1)
        for k, s in enumerate(said):
            if s[0] == "\n":
                if ids_b[k][:1] != [self.space_b]:
                    raise ValueError("the second tokenizer puts no space of its own before a line break")
                ids_b[k] = ids_b[k][1:]
        return [np.frombuffer(learnt[c], "<u4") for c in new], ids_b, [s.encode() for s in said]

    def learn(self, new: list) -> None:
        ids_a, ids_b, said = self._encode(new)
        byte_a, byte_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = np.array([b"".join(map(byte_a, a.tolist())) == s == b"".join(map(byte_b, b)) for a, b, s in zip(ids_a, ids_b, said)], bool)
        n_a, n_b = (np.array([len(x) for x in ids], "i8") * good for ids in (ids_a, ids_b))
        a = np.concatenate([np.zeros(0, "i8"), *(x for x, g in zip(ids_a, good) if g)]).astype("i8")
        b = np.fromiter(chain.from_iterable(x for x, g in zip(ids_b, good) if g), "i8")
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # of all chunks one after the other
        if len(a) and not (self.size_a[a].all() and self.size_b[b].all()):
            raise ValueError("a token without bytes")
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        keys = b[last_b] << KEY_BITS | a[last_a]
        # tokens in the order in which they are said: a group's A ids, then its B ids
        own_a, own_b = np.nonzero(last_a)[0] + 1, np.nonzero(last_b)[0] + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.zeros(len(a) + len(b), "i8")
        order[np.arange(len(a)) + np.concatenate([[0], own_b])[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + own_a[group_b]] = 2 * (b + len(self.bytes_a)) + last_b
        parts = list(map(self.said.__getitem__, order.tolist()))
        links = np.diff(np.concatenate([[0], np.cumsum(last_a)])[np.concatenate([[0], np.cumsum(n_a)])])
        ends = np.cumsum(n_a + n_b).tolist()
        self.groups += [b"".join(parts[x:y]) for x, y in zip([0, *ends], ends)]
        self.memo.update(zip(new, range(len(self.good), len(self.good) + len(new))))
        self.chars += sum(map(len, said))
        self.n_a, self.n_b, self.n_links = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, links)))
        self.good, self.keys = np.concatenate([self.good, good]), np.concatenate([self.keys, keys])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(links)])

    @staticmethod
    def chunks(text: str) -> list:
        if not text:
            return []
        said = " " + text
        if _RUNS.search(said):
            head, *rest = _CUT.split(said)
            return [(head,), *rest]
        return said.replace("\n", " \n").split(" ")[1:]

    def __call__(self, many: list[str]):
        """Per text: n_a, n_b, n_links, group text in bytes (None without tokens); and (text, pair, number) of the links, sorted."""
        cut = [self.chunks(t) for t in many]
        if self.chars > MEMO_CHARS:
            self.forget()
        if new := list(set().union(*cut).difference(self.memo)):
            self.learn(new)
        rows = [list(map(self.memo.__getitem__, c)) for c in cut]
        n = np.array([len(r) for r in rows], "i8")
        flat = np.fromiter(chain.from_iterable(rows), "i8", int(n.sum()))
        text = np.repeat(np.arange(len(many)), n)
        whole = np.bincount(text[~self.good[flat]], minlength=len(many)) == 0
        stay = whole[text]
        flat, text = flat[stay], text[stay]
        sums = [np.bincount(text, x[flat], len(many)).astype("i8") for x in (self.n_a, self.n_b, self.n_links)]
        groups = [b"".join(map(self.groups.__getitem__, r))[:-1] if r and w else None for r, w in zip(rows, whole)]
        size = self.n_links[flat]
        before = np.cumsum(size) - size
        pair = self.keys[np.repeat(self.at[flat] - before, size) + np.arange(int(size.sum()))]
        text = np.repeat(text, size)
        both = np.sort(text << 2 * KEY_BITS | pair)  # a call has at most ROWS_AT_ONCE texts
        first = np.nonzero(np.diff(both, prepend=-1))[0]
        n = np.diff(np.concatenate([first, [len(both)]]))
        both = both[first]
        return sums, groups, both >> 2 * KEY_BITS, both & ((1 << 2 * KEY_BITS) - 1), n


@cache
def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """The one aligner of this Python worker, which serves many tasks."""
    return Aligner(path_a, path_b)


def _align_step(path_a: str, path_b: str, say: bool):
    def make():
        from pyspark import TaskContext

        aligner, done = worker_aligner(path_a, path_b), TaskContext.get().partitionId() << 40

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal done
            (n_a, n_b, n_links), groups, text, pair, n = aligner(texts(batch.column("text")))
            at = pa.array(np.searchsorted(text, np.arange(len(groups) + 1)).astype("i4"))
            columns = {
                "uid": pa.array(np.arange(done, done + len(groups))), "doc_id": batch.column("doc_id"),
                "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_links), "n_links": pa.array(n_links),
                "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g is not None else "" for g in groups], pa.string()),
                "pairs": pa.ListArray.from_arrays(at, pa.array(pair)), "numbers": pa.ListArray.from_arrays(at, pa.array(n.astype("i4")))}
            if say:
                columns["groups"] = pa.array([(g or b"").decode() for g in groups], pa.string())
            done += len(groups)
            return pa.RecordBatch.from_pydict(columns)

        return step

    return make


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, groups: bool = False) -> DataFrame:
    """Per document: uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct linked pairs and how often it has each.

    With ``groups`` also the group text, ``a1,a2|b1;a3|b2,b3``. uid numbers the rows of one run of the job: write the result before it is used twice.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _align_step(tokenizer_a or tokenizer_path(TOKENIZER_A), tokenizer_b or tokenizer_path(TOKENIZER_B), groups),
                     "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, numbers array<int>"
                     + ", groups string" * groups)


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, "i8")
    for batch in batches:
        found = np.bincount(batch.column("pairs").flatten().to_numpy() >> KEY_BITS)
        total, found = (np.pad(x, (0, max(len(total), len(found)) - len(x))) for x in (total, found))
        total = total + found
    b = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total[b])], names=["b", "n"])


class Buckets:
    """B id -> its first bucket and how many it has, from the records of each B id.

    B ids go into buckets in order; one that would fill more than a bucket by itself gets buckets of its own.
    """

    def __init__(self, loads: list[tuple[int, int]], parallel: int, most: int):
        total = sum(n for _, n in loads)
        size = max(1, min(most, -(-total // max(1, parallel))))
        self.first, self.split = (np.full(max((b for b, _ in loads), default=0) + 1, x, "i4") for x in (0, 1))
        bucket, held = -1, size
        for b, n in sorted(loads):
            if n > size:
                self.first[b], self.split[b] = bucket + 1, -(-n // size)
                bucket, held = bucket + int(self.split[b]), size
                continue
            if held + n > size:
                bucket, held = bucket + 1, 0
            self.first[b] = bucket
            held += n
        self.number = bucket + 1

    def of(self, b: np.ndarray, uid: np.ndarray) -> np.ndarray:
        return self.first[b] + (uid * 0x9E3779B1 >> 7) % self.split[b]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _blocks(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A sorted piece as zstd blocks that cut no pair: sizes, pairs by difference, documents and numbers of each."""
    first = np.nonzero(np.concatenate([[True], np.diff(key) != 0]))[0]
    cuts = np.unique(np.concatenate([[0], np.searchsorted(first, np.arange(BLOCK_RECORDS, len(key), BLOCK_RECORDS), "right") - 1, [len(first)]]))
    first = np.concatenate([first, [len(key)]])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        x, y = first[a], first[b]
        out.append(_pack(np.concatenate([[b - a], np.diff(key[first[a:b]], prepend=0), np.diff(first[a:b + 1]), doc[x:y], n[x:y]]).astype("<i8")))
    return out


class _Block:
    """A block read back; ``count`` and ``best`` of each pair are filled in by the merge."""

    def __init__(self, packed: bytes):
        x = _unpack(packed, "<i8")
        k = int(x[0])
        self.sizes = x[1 + k:1 + 2 * k]
        self.doc, self.n = np.split(x[1 + 2 * k:], 2)
        self.keys = np.cumsum(x[1:1 + k]).tolist()
        self.sums = np.add.reduceat(self.n, np.cumsum(self.sizes) - self.sizes).tolist()
        self.count, self.best, self.open = [0] * k, [False] * k, k

    def contribute(self, best: np.ndarray, total: np.ndarray) -> None:
        np.add.at(best, self.doc, self.n * np.repeat(self.best, self.sizes))
        np.add.at(total, self.doc, self.n * np.repeat(np.array(self.count, "i8"), self.sizes))


#: A run's uids (bucket null), its piece for a bucket (n: the run's documents), and a pair's count over several buckets (run null).
RUNS = "bucket int, run long, hot boolean, key long, n long, uids binary, blocks array<binary>"
_RUNS_ARROW = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("hot", pa.bool_()), ("key", pa.int64()), ("n", pa.int64()),
                         ("uids", pa.binary()), ("blocks", pa.list_(pa.binary()))])


def _run_writer(buckets: Buckets, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            uid, size, key, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            doc = np.repeat(np.arange(len(uid)), size)
            b = key >> KEY_BITS
            bucket = buckets.of(b, uid[doc])
            order = np.lexsort((key, bucket))  # documents stay in order
            bucket, key, doc, n = bucket[order], key[order], doc[order], n[order]
            cuts = np.nonzero(np.diff(bucket, prepend=-1))[0].tolist()
            rows = [{"run": number, "uids": _pack(uid)}]
            for x, y in zip(cuts, [*cuts[1:], len(key)]):
                rows.append({"bucket": int(bucket[x]), "run": number, "hot": bool(buckets.split[key[x] >> KEY_BITS] > 1),
                             "n": len(uid), "blocks": _blocks(key[x:y], doc[x:y], n[x:y])})
            number += 1
            return pa.RecordBatch.from_pylist(rows, _RUNS_ARROW)

        records = 0
        for batch in batches:
            pairs, numbers, uids = batch.column("pairs"), batch.column("numbers"), batch.column("uid").to_numpy()
            at, key, n = pairs.offsets.to_numpy(), pairs.values.to_numpy(), numbers.values.to_numpy()
            x = 0
            while x < len(uids):  # as many documents as the run has room for, one at least
                y = min(len(uids), max(x + 1, int(np.searchsorted(at, at[x] + most - records, "right")) - 1))
                if at[y] > at[x]:
                    held.append((uids[x:y], np.diff(at[x:y + 1]), key[at[x]:at[y]], n[at[x]:at[y]].astype("i8")))
                    records += int(at[y] - at[x])
                x = y
                if records >= most:
                    yield flush()
                    records = 0
        if held:
            yield flush()

    return run


def _piece_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blocks in batch.column("blocks"):
            for packed in blocks:
                block = _Block(packed.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block.keys, pa.int64()), pa.array(block.sums, pa.int64())], names=["key", "n"])


def merge(pieces: list[tuple[int, int, list[bytes]]], totals: dict[int, int], pairs: bool = False) -> Iterator[tuple]:
    """k-way heap merge of a bucket's pieces (run, documents, zstd blocks), each sorted by B id, then A id.

    ``totals`` has the counts of pairs whose B id has other buckets, too. Yields (run, best, sum) when a piece is through: the
    contributions to its run's documents; with ``pairs`` lists of (pair, count, whether it is the highest of its B id) instead.
    """
    best, total = ([np.zeros(n, "i8") for _, n, _ in pieces] for _ in range(2))
    blocks, cursor, place = [_Block(x[0]) for _, _, x in pieces], [0] * len(pieces), [0] * len(pieces)
    through = [0] * len(pieces)  # blocks of a piece whose pairs are all counted
    heap = [(block.keys[0], k) for k, block in enumerate(blocks)]
    heapq.heapify(heap)
    elsewhere: dict[int, int] = {}  # the highest count of a B id that has other buckets
    for key, n in totals.items():
        elsewhere[key >> KEY_BITS] = max(n, elsewhere.get(key >> KEY_BITS, 0))
    waiting: list[tuple[int, int, list[tuple[int, _Block, int]]]] = []  # of one B id: pair, count, where it stands

    def settle() -> Iterator[tuple]:
        high = max(elsewhere.get(waiting[0][0] >> KEY_BITS, 0), max(count for _, count, _ in waiting))
        if pairs:
            yield [(key, count, count == high) for key, count, _ in waiting]
        for _, count, places in waiting:
            for k, block, at in places:
                block.count[at], block.best[at] = count, count == high
                block.open -= 1
                if not block.open:
                    block.contribute(best[k], total[k])
                    through[k] += 1
                    if through[k] == len(pieces[k][2]) and not pairs:
                        yield pieces[k][0], best[k], total[k]
                        best[k] = total[k] = None
        waiting.clear()

    while heap:
        key = heap[0][0]
        if waiting and waiting[0][0] >> KEY_BITS != key >> KEY_BITS:
            yield from settle()
        count, places = 0, []
        while heap and heap[0][0] == key:
            k = heap[0][1]
            block, at = blocks[k], place[k]
            count += block.sums[at]
            places.append((k, block, at))
            if at + 1 < len(block.keys):
                place[k] = at + 1
            elif cursor[k] + 1 < len(pieces[k][2]):
                cursor[k] += 1
                blocks[k], place[k] = _Block(pieces[k][2][cursor[k]]), 0
            else:
                heapq.heappop(heap)
                continue
            heapq.heapreplace(heap, (blocks[k].keys[place[k]], k))
        waiting.append((key, totals.get(key, count), places))
    if waiting:
        yield from settle()


def _merger(pairs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, pieces, totals = None, [], {}

        def out() -> Iterator[pa.RecordBatch]:
            for found in merge(pieces, totals, pairs) if pieces else ():
                if pairs:
                    key, count, high = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(count, pa.int64()), pa.array(high)], names=["key", "count", "best"])
                else:
                    number, best, total = found
                    yield pa.RecordBatch.from_pydict({"run": [number], "best": [_pack(best)], "total": [_pack(total)]})

        for batch in batches:
            for row in range(batch.num_rows):
                at, number, key, n, blocks = (batch.column(c)[row].as_py() for c in ("bucket", "run", "key", "n", "blocks"))
                if at != bucket:
                    yield from out()
                    bucket, pieces, totals = at, [], {}
                if number is None:
                    totals[key] = n
                else:
                    pieces.append((number, n, blocks))
        yield from out()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by run, its uids first: the sums of the contributions to each document."""
    uids, best, total = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(uids), pa.array(best), pa.array(total)], names=["uid", "n_best", "count_sum"])

    for batch in batches:
        for own, more, sums in zip(*(batch.column(c) for c in ("uids", "best", "total"))):
            if own.is_valid:
                yield out()
                uids = _unpack(own.as_py(), "<i8")
                best, total = np.zeros(len(uids), "i8"), np.zeros(len(uids), "i8")
            else:
                best += _unpack(more.as_py(), "<i8")
                total += _unpack(sums.as_py(), "<i8")
    yield out()


def spilled_runs(aligned: DataFrame, run_records: int = RUN_RECORDS, bucket_records: int = BUCKET_RECORDS) -> tuple[DataFrame, Buckets]:
    """The pair-document records of ``aligned`` as runs in the shared folder, and the buckets they are cut into."""
    loads = aligned.select("pairs").mapInArrow(_loads, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    buckets = Buckets([(r.b, r.n) for r in loads.collect()], aligned.sparkSession.sparkContext.defaultParallelism, bucket_records)
    runs = aligned.select("uid", "pairs", "numbers").mapInArrow(_run_writer(buckets, run_records), RUNS)
    return materialize(runs, "pair-runs"), buckets


def _merged(runs: DataFrame, buckets: Buckets, pairs: bool) -> DataFrame:
    split = np.nonzero(buckets.split > 1)[0]
    rows = runs.filter("bucket is not null")
    if len(split):  # at most as many B ids as there are buckets
        spark = runs.sparkSession
        places = spark.createDataFrame([(int(b), int(buckets.first[b]), int(buckets.first[b] + buckets.split[b] - 1)) for b in split], "b int, low int, high int")
        hot = (runs.filter("hot").select("blocks").mapInArrow(_piece_sums, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
               .withColumn("b", F.shiftright("key", KEY_BITS).cast("int")).join(F.broadcast(places), "b")
               .select(F.explode(F.sequence("low", "high")).alias("bucket"), "key", "n"))
        rows = rows.unionByName(hot, allowMissingColumns=True)
    dealt = rows.repartitionById(max(1, buckets.number), F.col("bucket")).sortWithinPartitions(F.col("bucket"), F.col("run").asc_nulls_first())
    return dealt.select("bucket", "run", "key", "n", "blocks").mapInArrow(_merger(pairs), "key long, count long, best boolean" if pairs else "run long, best binary, total binary")


def pair_counts(aligned: DataFrame, **sizes: int) -> DataFrame:
    """(a, b, count, best) of every linked id pair of the corpus; best: no pair of that B id has a higher count."""
    found = _merged(*spilled_runs(aligned, **sizes), pairs=True).distinct()
    return found.select(F.col("key").bitwiseAND(F.lit((1 << KEY_BITS) - 1)).cast("int").alias("a"), F.shiftright("key", KEY_BITS).cast("int").alias("b"), "count", "best")


def score(aligned: DataFrame, **sizes: int) -> DataFrame:
    """``aligned`` (written before) with n_best, the links whose pair's count is the highest of its B id, and count_sum, the sum of the links' counts."""
    runs, buckets = spilled_runs(aligned, **sizes)
    back = _merged(runs, buckets, pairs=False)
    together = (runs.filter("bucket is null").select("run", "uids").unionByName(back, allowMissingColumns=True)
                .repartition("run").sortWithinPartitions(F.col("run"), F.col("uids").isNull()))
    sums = together.mapInArrow(_add_up, "uid long, n_best long, count_sum long")
    return aligned.join(sums, "uid", "left").fillna(0, ["n_best", "count_sum"])


def aligned_scores(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, **sizes: int) -> DataFrame:
    """Both steps: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = materialize(align(docs, tokenizer_a, tokenizer_b), "aligned")
    return score(aligned, **sizes).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

import zlib

import numpy as np
import pytest
from conftest_llm import clashing, sentence

from cohortlens.llm import bin_packing as B


def _check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_are_full_but_the_first():
    assert B.cut(2048, 2048) == [(0, 2048)]
    assert B.cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert B.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_packing_of_documents(spark, rng):
    rows = [(k % 37, sentence(rng, rng.randint(0, 30))) for k in range(300)] + [(None, None), (None, ""), (900, sentence(rng, 900)), (901, "y" * 5000)]
    found = B.packed_documents(clashing(spark, rows, "doc_id long, text string"), capacity=128).collect()
    assert len({(r.doc_id, r.ids_crc32, r.piece) for r in found}) <= len(found)
    total = sum(r.length for r in found)
    assert _check(found, 128) <= -(-total // 128) + 1
    big = sorted((r for r in found if r.doc_id == 900), key=lambda r: r.piece)
    assert [r.length for r in big[1:]] == [128] * (len(big) - 1)
    assert [r.start for r in big] == [0, *np.cumsum([r.length for r in big])[:-1].tolist()]


def test_islands_and_levels_place_every_piece_once(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 900, 1500).tolist() + [1000] * 40
    items = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "uid long, length long")
    placed = B.pack(items, capacity=1000, island_pieces=300).join(items, "uid").collect()
    assert sorted(r.uid for r in placed) == list(range(len(sizes)))
    n = _check(placed, 1000)
    assert n <= -(-sum(sizes) // 1000) * 1.03 + 1


def test_crossover_keeps_whole_bins_and_every_item():
    rng = np.random.default_rng(1)
    sizes = np.array([6, 5, 5, 4, 4, 3, 3, 2, 2, 1], "i8")
    child = B.Packing(sizes, 10)
    child.best_fit(list(range(10)))
    B.crossover(child, [[0, 3], [1, 2]], rng)
    assert sorted(i for b in child.bins.values() for i in b) == list(range(10))
    assert [0, 3] in child.bins.values() and [1, 2] in child.bins.values()
    assert all(sizes[b].sum() <= 10 for b in child.bins.values())


def test_travelled_patterns_become_bins():
    packing = B.Packing(np.array([7, 6, 4, 3], "i8"), 10)
    for i in range(4):
        packing.add_bin([i])
    assert B._from_patterns(packing, [[6, 4], [9, 1]]) == [[1, 2]]


def test_evolution_reaches_the_bound():
    rng = np.random.default_rng(5)
    parts = [np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, 1000), 2, replace=False)), [1000]])) for _ in range(40)]
    sizes = np.sort(np.concatenate(parts))[::-1]
    assert len(B.evolve(sizes, None, [], 1000, 1).bins) <= 41


def test_empty_table(spark):
    assert B.packed_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize(("sizes", "capacity", "pieces"), [([1] * 10, 1000, 3), ([5, 7, 1] * 300, 131_072, 50), ([700, 300] * 60, 1000, 4), ([1000, 999, 1], 1000, 1)])
def test_capacities_above_an_islands_total_end(spark, sizes, capacity, pieces):
    """Islands that would fill less than a few sequences are fewer, and every level has half of them at most."""
    items = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "uid long, length long")
    placed = B.pack(items, capacity=capacity, island_pieces=pieces).join(items, "uid").collect()
    assert sorted(r.uid for r in placed) == list(range(len(sizes)))
    assert _check(placed, capacity) == -(-sum(sizes) // capacity)


def test_start_and_digest_against_plain_encoding(spark, rng):
    from tokenizers import Tokenizer

    from cohortlens.llm.word_memo import tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    texts = [sentence(rng, rng.randint(0, 90)) for _ in range(60)] + [None, "", "a  b\n\n c <|endoftext|> 你好, don't!?", "word. Word, word; " * 300]
    found = {}
    for r in B.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=64).collect():
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for k, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        assert sorted(found[k]) == [(p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]

import re

import numpy as np
import pytest
import xxhash
from conftest_llm import clashing, sentence

from cohortlens.llm import simhash_popcount as S


def _plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(rng):
    for text in ["", " \n", "One", "a b c", "a b c d", "É a b C d e", sentence(rng, 400)]:
        assert S.simhash(text) == _plain_simhash(text)


def test_the_embedding_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype="u8")
    assert (np.bitwise_count(S.embed(a) ^ S.embed(b)) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize(("blocks", "tile"), [(6, 8192), (7, 8192), (8, 8192), (6, 40)])
def test_links_join_what_brute_force_joins(spark, blocks, tile):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 80)]
    for x in fps[:30]:
        for _ in range(12):
            x ^= sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 5)), replace=False))
            fps.append(x)
    fps += [fps[0] ^ (1 << int(a) | 1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))]
    fps = sorted(set(fps))
    groups = {}
    for x, r in zip(fps, _components(fps, 4)):
        groups.setdefault(r, set()).add(S._signed(x))
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    found = {}
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    for node, root in S.components(S.links(df, 4, blocks, tile)).collect():
        found.setdefault(root, set()).add(node)
    assert sorted(sorted(g) for g in found.values()) == want
    assert all(min(g) == r for r, g in found.items())


def test_documents_against_brute_force(spark, rng):
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(25)]
    rows = [(k, rng.choice(texts) + rng.choice(["", "", " Extra", "\n"])) for k in range(90)] + [(200, None), (201, " "), (202, "")]
    found = S.near_duplicates(clashing(spark, rows, "doc_id long, text string")).collect()
    fps = [_plain_simhash(t or "") for _, t in rows]
    root = _components(fps, 4)
    least = {}
    for (k, _), r in zip(rows, root):
        least[r] = min(k, least.get(r, k))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((k, f"{f:016x}", least[r]) for (k, _), f, r in zip(rows, fps, root))


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "x y z w v"), (5, "x y z w v"), (5, "other words stand here alone"), (7, "X y  z w\tv"), (9, None), (8, ""), (10, " ")]
    docs = clashing(spark, rows, "doc_id long, text string")
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [
        (False, 5, "other words stand here alone"), (False, 5, "x y z w v"), (False, 8, ""), (True, 0, "a b c d e f")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == [] and S.keep_first(empty).collect() == []


def test_blocks_grow_with_the_fingerprints():
    assert [S.blocks_for(n) for n in (0, 10**6, 2 * 10**6, 10**8, 10**12)] == [6, 6, 7, 8, 8]
    for blocks in (6, 7, 8):
        assert min(bin(m & (1 << 64) - 1).count("1") for m in S.cell_masks(blocks, 4)) >= 2 * (32 // blocks) * (blocks - 4)

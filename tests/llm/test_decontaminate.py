import random

from conftest_llm import WORDS, clashing, sentence

from cohortlens.llm import decontaminate as D


def _plain(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def _bench(rng):
    return [(k, " ".join(rng.choice([w + v for w in WORDS for v in ("", "x", "y")]) for _ in range(rng.randint(6, 50)))) for k in range(40)]


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(1500):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 70))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        edits, start, end = D.best_window(item, text)
        assert edits == _plain(item, text)
        assert 0 <= start <= end <= len(text)
        if edits < len(item):
            row = D.within(item, text[start:end])
            assert row[0] == edits


def test_recall_and_exactness_against_brute_force(spark, rng):
    bench = _bench(rng)
    rows = []
    for k in range(240):
        host = sentence(rng, rng.randint(0, 120)).split()
        if k % 2:
            item = D.words(rng.choice(bench)[1])
            at = rng.randrange(len(host) + 1)
            host[at:at] = [w.replace("+", "zz") for w in D.edited(item, rng.randint(0, int(0.3 * len(item))), rng)]
        rows.append((k, " ".join(host).title().replace(" ", rng.choice([" ", ", ", "\n"]))))
    rows += [(None, bench[0][1]), (900, None), (901, "")]
    docs = clashing(spark, rows, "doc_id long, text string")
    want = {(k, i) for k, t in rows for i, x in bench for a in [D.words(x)] if _plain(a, D.words(t or "")) <= int(0.2 * len(a))}
    found = D.find(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want
    assert len(got) >= 0.95 * len(want)
    texts, items = dict(rows), dict(bench)
    for r in found:
        assert _plain(D.words(items[r.item_id]), D.words(texts[r.doc_id][r.start_char:r.end_char])) == r.edits
    left = D.drop_contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect())) == sorted(k for k, _ in rows if k is not None and k not in {x for x, _ in got})


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "the end"), (2, "the end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the end"), (4, "B c, D e f!"), (4, "B c, D e f!")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits, r.start_char, r.end_char) for r in D.find(docs, bench).collect()] == [(1, 4, 0, 2, 11)] * 2
    assert D.find(docs.limit(0), bench).collect() == []
    assert D.find(docs, bench.limit(0)).collect() == []
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 3


def test_recall_at_every_length(rng):
    bench = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for k, n in enumerate([5, 12] * 4 + list(range(6, 60)))]
    texts, want = [], set()
    for k, x in bench:
        item = D.words(x)
        for copy in (["zz", *item[1:]], item[1:], [*item[:-1], "zz"], D.edited(item, int(0.2 * len(item)), rng)):
            want.add((len(texts), k))
            texts.append(" ".join(["aa", *(w.replace("+", "yy") for w in copy), "bb"]))
    repetitions, exact = D.search_plan(bench)
    assert {5, 12} <= exact
    got = {(t, i) for t, i, *_ in D.Finder(bench, repetitions, exact=exact).matches(texts)}
    assert len(want - got) <= 0.01 * len(want) and not [k for _, k in want - got if len(bench[k][1].split()) in exact]


def test_exact_search_alone_finds_every_copy(rng):
    bench = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(5 + k % 60))) for k in range(120)]
    finder = D.Finder(bench, 0, exact=frozenset(range(65)))
    texts = [" ".join(D.edited(D.words(x), int(0.2 * len(D.words(x))), rng)).replace("+", "zz") for _, x in bench for _ in range(3)]
    got = {(t, i) for t, i, *_ in finder.matches(texts)}
    assert got >= {(t, t // 3) for t in range(len(texts))}


def test_short_items_and_scripts_without_spaces(spark):
    docs = spark.createDataFrame([(1, "So, the END."), (2, "the bitter end"), (3, "以前，今天天气非常好我们去公园玩。以后"), (4, "今天天气很好"), (5, "ที่นี่ฉันชอบกินข้าวผัดกุ้งมาก"), (6, "42")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the end"), (2, "今天天气真好我们去公园玩"), (3, "ฉันชอบกินข้าวผัดกุ้ง"), (4, "42"), (5, "--")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.edits, r.start_char, r.end_char) for r in D.find(docs, bench, least=1).collect()}
    assert found.pop((3, 2))[0] == 2
    assert found == {(1, 1): (0, 4, 11), (5, 3): (0, 6, 26), (6, 4): (0, 0, 2)}
    assert {r.doc_id for r in D.drop_contaminated(docs, bench, least=1).collect()} == {2, 4}
    assert {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()} == {(3, 2), (5, 3)}


def test_blocks_of_items(spark, rng):
    bench = spark.createDataFrame(_bench(rng), "item_id long, text string")
    blocks = list(D.item_blocks(bench, 7))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == list(range(40))

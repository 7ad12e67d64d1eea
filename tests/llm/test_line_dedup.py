import pytest
from conftest_llm import clashing
from pyspark.sql import functions as F

from cohortlens.llm import line_dedup as L
from cohortlens.llm.common import Scratch


def _edit(rng, words):
    words = list(words)
    for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
        at, kind = rng.randrange(len(words) + 1), rng.randrange(3)
        if kind == 0:
            words.insert(at, f"w{rng.randrange(40)}")
        elif kind == 1 and len(words) > 1:
            del words[min(at, len(words) - 1)]
        else:
            words[min(at, len(words) - 1)] = f"w{rng.randrange(40)}"
    return words


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_against_brute_force(spark, rng):
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 12))] for _ in range(50)]
    rows = []
    for i in range(130):
        lines = [rng.choice(["  ", ""]) if rng.random() < 0.1 else " ".join(_edit(rng, rng.choice(base))) for _ in range(rng.randint(0, 6))]
        rows.append((None if i % 50 == 7 else rng.randrange(100), "\n".join(lines) if i % 40 else None))
    rows += rows[:3]  # repeated rows
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    place = lambda k, t, n: (k is None, k or 0, hashes[t or ""], n)
    said = sorted({(place(k, t, n), line) for k, t in rows for n, line in enumerate((t or "").split("\n")) if line.split()})
    keep = set()
    for i, (p, line) in enumerate(said):
        words = line.split()
        if not any(x.split() == words or max(len(x.split()), len(words)) >= 5 and _distance(x.split(), words) <= 1 for _, x in said[:i]):
            keep.add(p)
    want = []
    for k, t in rows:
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if not x.split() or place(k, t, n) in keep]
        want.append((k, None if t is None else "\n".join(left), sum(bool(x.split()) for x in lines), sum(bool(x.split()) for x in left)))
    docs = clashing(spark, rows, "doc_id long, text string").drop("n_lines")
    found = L.dedup(docs).select("doc_id", "text", "n_lines", "n_kept").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_documents_without_a_line_left_go(spark):
    rows = [(1, "one two three four five\nsix"), (2, "one two three four FIVE\nsix"), (3, " \n"), (4, None), (5, "new " * 9000), (6, "six\nseven eight")]
    docs = clashing(spark, rows, "doc_id long, text string")
    left = L.remaining(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: rows[0][1], 3: " \n", 4: None, 5: rows[4][1], 6: "seven eight"}


def test_variants_meet_exactly_at_one_edit(rng):
    for _ in range(300):
        a = [f"w{rng.randrange(9)}".encode() for _ in range(rng.randint(5, 9))]
        b = [x.encode() for x in _edit(rng, [x.decode() for x in a])]
        if max(len(a), len(b)) < 5 or a == b:
            continue
        ka, kb = ({}, {})
        for keys, words in ((ka, a), (kb, b)):
            for k, r in zip(*(x.tolist() for x in L.variants(words))):
                keys.setdefault(k, set()).add(r)
        meet = any((r, q) in {(0, 0), (1, 2), (2, 1)} for k in ka.keys() & kb.keys() for r in ka[k] for q in kb[k])
        assert meet == (_distance(a, b) == 1) == L.one_edit(a, b)
        assert not meet or set(L.filter_keys([a])[1]) & set(L.filter_keys([b])[1])


def test_bit_map(spark):
    values = [0, 1, 5, 32767, 32768, -1, -7, 1 << 40]
    bits = L.bit_map(spark.createDataFrame([(v,) for v in values], "v long"), "v", 1 << 17)
    import numpy as np

    assert L.in_map(bits, np.array(values, "i8")).all()
    assert not L.in_map(bits, np.array([2, 3, 77, -2], "i8")).any()


def test_similarity_bound_at_every_length(spark, rng):
    rows, want = [], {}
    for i in range(60):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(10, 120))]
        edits = rng.randint(0, int(0.3 * len(base)))
        copy = list(base)
        for at in rng.sample(range(len(base)), edits):
            copy[at] = f"z{rng.randrange(3000)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        want[2 * i], want[2 * i + 1] = 1, int(_distance(base, copy) > int(0.2 * len(base)))
    found = L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), share=L.EDIT_SHARE).collect()
    assert {r.doc_id: r.n_kept for r in found} == want and 20 < sum(want.values()) - 60 < 40


def test_near_against_plain_distance(rng):
    for _ in range(500):
        a = [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b = _edit(rng, b or ["w"])
        d, most = _distance(a, b), max(len(a), len(b))
        a, b = ([x.encode() for x in y] for y in (a, b))
        assert L.edits(a, b) == d
        assert L.near(a, b, 0.2) == (d <= int(0.2 * most)) and L.near(a, b) == (d <= int(most >= 5))


@pytest.mark.parametrize("make", [L.dedup, L.remaining])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_of_the_counts_names_are_replaced(spark):
    docs = clashing(spark, [(1, "one two three four five\nsix"), (2, "one two three four FIVE\nsix")], "doc_id long, text string").withColumn("n_kept", F.lit("x"))
    found = L.dedup(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    assert sorted((r.doc_id, r.n_lines, r.n_kept) for r in found.select("doc_id", "n_lines", "n_kept").collect()) == [(1, 2, 2), (2, 2, 0)]


def _kept_by_brute_force(lines, share):
    return [not any(L.near(x, line, share) for x in lines[:i]) for i, line in enumerate(lines)]


def test_several_edits_are_found_where_many_lines_share_a_template(spark, rng):
    common = [f"c{k}" for k in range(24)]
    said = []
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(8)]
        near, far = list(own), list(own)
        for at in rng.sample(range(8), 5):
            near[at] = f"n{i}x{at}"
        for at in rng.sample(range(8), 7):
            far[at] = f"f{i}x{at}"
        said += [own + common, near + common, far + common]
    said += [[f"w{rng.randrange(6)}" for _ in range(rng.randint(8, 14))] for _ in range(120)]
    lines = [[w.encode() for w in x] for x in said]
    found = L.dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(said)], "doc_id long, text string"), share=L.EDIT_SHARE).collect()
    want = _kept_by_brute_force(lines, L.EDIT_SHARE)
    assert {r.doc_id: bool(r.n_kept) for r in found} == dict(enumerate(want)) and sum(want[1:180:3]) == 0


@pytest.mark.parametrize("share", [0.1, 0.2, 0.33, 0.45])
def test_near_lines_share_a_first_gram_in_any_order(rng, share):
    import numpy as np

    ranks = np.random.default_rng(3).integers(0, 50, 1 << L.RANK_BITS)
    tried = 0
    while tried < 300:
        a = [f"w{rng.randrange(12)}".encode() for _ in range(rng.randint(2, 40))]
        b = [x.encode() for x in [x.decode() for x in a]]
        for _ in range(rng.randint(2, 14)):
            b = [x.encode() for x in _edit(rng, [x.decode() for x in b])]
        if int(share * max(len(a), len(b)) + 1e-9) < 2 or not L.near(a, b, share) or L.near(a, b):
            continue
        tried += 1
        row, key = L.filter_keys([a, b], share, ranks)
        assert sum(k % 2 for k in set(key[row == 0]) & set(key[row == 1])) >= L.common_grams(share)


def _keyed(spark, lines):
    """The table of gram keys of {number: (size, keys)}."""
    n = {}
    for _, keys in lines.values():
        for k in keys:
            n[k] = n.get(k, 0) + 1
    often = lambda k: n[k] >= L.OFTEN
    rows = [(k, often(k), i, size, sorted(filter(often, keys)) or None) for i, (size, keys) in lines.items() for k in keys]
    return spark.createDataFrame(rows, "key long, often boolean, number long, size int, often_keys array<long>")


def _join_rows(plan) -> list[int]:
    """Rows that each join of an executed plan made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _join_rows(plan.executedPlan())
    found = [plan.metrics().apply("numOutputRows").value()] if name.endswith("JoinExec") else []
    below = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return found + [n for x in below for n in _join_rows(x)]


@pytest.mark.parametrize("share", [0.2, 0.45])
def test_pairs_share_as_many_keys_as_asked_rare_or_often(spark, rng, share):
    lines = {i: (rng.randint(10, 60), {rng.choice([rng.randrange(8), rng.randrange(100, 400)]) for _ in range(rng.randint(1, 9))}) for i in range(150)}
    gone = set(rng.sample(range(150), 30))
    want = set()
    for b, (size, keys) in lines.items():
        for a in range(b if b not in gone else 0):
            most = int(share * max(size, lines[a][0]) + 1e-9)
            if most >= 2 and abs(size - lines[a][0]) <= most and len(keys & lines[a][1]) >= L.common_grams(share):
                want.add((b, a))
    found = L.all_neighbours(_keyed(spark, lines), spark.createDataFrame([(i,) for i in gone], "number long"), share).collect()
    assert len(found) == len(want) > 100 and {(r.number, r.earlier) for r in found} == want


def test_lines_that_share_many_often_keys_meet_once(spark):
    lines = {i: (50, set(range(1, 41, 2))) for i in range(200)}
    pairs = L.all_neighbours(_keyed(spark, lines), spark.createDataFrame([], "number long"), L.EDIT_SHARE)
    assert len(pairs.collect()) == 200 * 199 // 2
    assert max(_join_rows(pairs._jdf.queryExecution().executedPlan())) <= 200 * 199 // 2


def test_pairs_are_joined_in_parts_of_the_keys(spark, rng):
    lines = {i: (30, {rng.choice([rng.randrange(8), rng.randrange(100, 400)]) for _ in range(rng.randint(1, 9))}) for i in range(120)}
    keyed, gone = _keyed(spark, lines), spark.createDataFrame([(3,)], "number long")
    with Scratch(spark, "test-pairs") as saved:
        found = L.all_neighbours(keyed, gone, L.EDIT_SHARE, saved).collect()
        read = saved.spark.read
        parts = [{r.number for r in read.parquet(f"{saved.folder}/pair-rows/part={k}").collect()} for k in range(L.KEY_PARTS)]
    assert all(parts) and sorted(found) == sorted(L.all_neighbours(keyed, gone, L.EDIT_SHARE).collect())


def test_sketches_of_lines_at_so_many_edits(rng):
    bits = lambda x: "".join(f"{v & (1 << 64) - 1:064b}" for v in x.tolist())
    lines = [[b"w%d" % rng.randrange(30) for _ in range(rng.randint(1, 90))] for _ in range(60)]
    for a in lines:
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b = [x.encode() for x in _edit(rng, [x.decode() for x in b])]
        one, two = L.sketches([a, b])
        differ = sum(x != y for x, y in zip(bits(one), bits(two)))
        assert differ <= 2 * _distance(a, b) - abs(len(a) - len(b))
    assert len({x.tobytes() for x in L.sketches(lines)}) == len(lines)


def test_lines_of_one_template_that_are_not_near_are_not_compared(spark, monkeypatch):
    words = lambda i: [f"common{k // 4}" if k % 8 < 4 else f"own{i}x{k}" for k in range(48)]
    lines = [" ".join(words(i)) for i in range(120)]
    late = [" ".join(["other"] * 3 + words(i)[3:]) for i in range(0, 120, 10)]
    compared, confirmed = [], L.confirmed_lines
    monkeypatch.setattr(L, "confirmed_lines", lambda numbered, pairs, share=0: compared.append(pairs.count()) or confirmed(numbered, pairs, share))
    docs = spark.createDataFrame([*enumerate(lines), *((1000 + k, x) for k, x in enumerate(late))], "doc_id long, text string")
    left = L.remaining(docs, L.EDIT_SHARE)
    assert sorted(r.doc_id for r in left.collect()) == list(range(120))
    assert len(compared) == 2 and sum(compared) < 500  # 7,140 pairs share grams


def _tables(spark, saved, said):
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(said)], "doc_id long, text string")
    lines = saved.table(L.hashed_lines(docs, L.EDIT_SHARE), "lines")
    return lines, saved.table(L.distinct_lines(lines), "places")


def test_keys_are_written_as_read_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    assert "Exchange" not in L.hashed_lines(docs, L.EDIT_SHARE)._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_line_do_not_share_its_keys(spark, rng):
    line = [f"a{k}" for k in range(30)]
    with Scratch(spark, "test-keys") as saved:
        lines, places = _tables(spark, saved, [line] * 40 + [[f"b{i}x{k}" for k in range(30)] for i in range(5)])
        assert lines.count() == 45 and places.count() == 6
        assert L.shared_keys(lines, places, saved).count() == 0
        lines, places = _tables(spark, Scratch(spark, "test-keys-2"), [line] * 40 + [[*line[:-1], "z"]])
        held = L.shared_keys(lines, places, Scratch(spark, "test-keys-3")).collect()
        assert len(held) == len({(r.key, r.number) for r in held}) == 2 * len({r.key for r in held}) > 10


def test_words_are_read_only_of_lines_that_are_compared(spark, monkeypatch):
    # each line shares one run of two words with the next one
    said = [[f"s{i}", f"t{i}", *(f"o{i}x{k}" for k in range(16)), f"s{i + 1}", f"t{i + 1}"] for i in range(200)]
    said += [[*said[7][:-1], "other"], [*said[9][:9], "new", *said[9][11:]]]
    read, numbered = [], L.numbered_lines
    monkeypatch.setattr(L, "numbered_lines", lambda docs, numbers, *rest: read.append(numbers.count()) or numbered(docs, numbers, *rest))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(said)], "doc_id long, text string")
    left = L.remaining(docs, L.EDIT_SHARE).collect()
    assert sorted(r.doc_id for r in left) == list(range(200)) and sum(read) < 20


@pytest.mark.parametrize("often", [1, 3, 1000])
def test_any_key_may_be_carried(spark, rng, monkeypatch, often):
    monkeypatch.setattr(L, "OFTEN", often)
    said = [[f"w{rng.randrange(5)}" for _ in range(rng.randint(8, 13))] for _ in range(90)]
    found = L.dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(said)], "doc_id long, text string"), share=L.EDIT_SHARE).collect()
    want = _kept_by_brute_force([[w.encode() for w in x] for x in said], L.EDIT_SHARE)
    assert {r.doc_id: bool(r.n_kept) for r in found} == dict(enumerate(want)) and 10 < sum(want) < 90


def test_lines_are_as_often_carried_in_larger_tables():
    assert L.often_from(100) == L.often_from(400_000) == L.OFTEN and L.often_from(60 * 2_050_000) == 60 * 2_050_000 >> L.OFTEN_SHARE

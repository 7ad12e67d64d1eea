import re
from collections import Counter

import numpy as np
from conftest_llm import clashing, sentence

from cohortlens.llm import quality_forest as Q


def _plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i for k, w in enumerate(windows) if often[w] > 1 for i in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines)


def test_statistics_against_brute_force(rng):
    bits = ["a", "b", "c", " ", " ", "\n", "\t", "é#", "%%", "a b c", " ", "🙂"]
    for text in ["", " \n ", "a", "a a a a"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 80))) for _ in range(1500)]:
        assert Q.text_statistics(text) == _plain(text), repr(text)


def test_path_lengths_against_a_walk_down_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    forest = Q.grow(x, trees=20, tree_rows=64)
    got, cause = forest.anomaly(x[:50])
    for row, value in zip(x[:50], got):
        total = 0.0
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + (row[forest.feature[node]] >= forest.split[node])
            total += forest.path[node]
        assert abs(value - 2 ** (-total / 20 / float(Q._expected(64)))) < 1e-12
    assert Q.grow(x).anomaly(np.array([[0, 0, 0, 9.0]]))[1][0] // 4 == 3
    assert Q.grow(x[:0]).anomaly(x[:2])[0].tolist() == [1.0, 1.0]


def test_best_cut_for_each_cause():
    table = np.zeros((2, 2, 11))
    table[0, 1, 2], table[0, 0, 8] = 50, 5
    table[1, 1, 3] = 40
    assert Q.best_cuts(table) == [0.55, 1.0]


def test_pairs_without_bad_rows_take_a_wider_cut():
    n = len(Q.NAMES)
    table = np.zeros((n * n, 2, 11))
    assert Q.all_cuts(table) == [1.0] * (n * n)
    table[0, 1, 2], table[0, 0, 8] = 50, 5
    table[1, 1, 6] = 40
    cuts = Q.all_cuts(table)
    assert cuts[0] == 0.55 and abs(cuts[1] - 0.85) < 1e-12  # above all its good rows
    assert cuts[2] == 0.75  # no row of its own: the first statistic's cut
    assert cuts[n] == 0.75  # no bad row with this first statistic: the cut of all rows
    table[n, 1, 8] = 3
    assert abs(Q.all_cuts(table)[n] - 0.95) < 1e-12  # not below good rows of its own


def test_junk_goes_and_clean_documents_stay(spark, rng):
    rows, labels = [], []
    for k in range(500):
        words = sentence(rng, rng.randint(80, 200)).split()
        if bad := k % 10 == 0:
            words = [w + rng.choice(["***", "%%%", "$$"]) for w in words]
        rows.append((k, "\n".join(" ".join(words[i:i + 12]) for i in range(0, len(words), 12))))
        labels.append((k, 1 - int(bad)))
    rows += [(900, None), (901, ""), (902, "few words"), (903, "same old words " * 40), (None, rows[1][1]), (7, rows[7][1])]
    docs = clashing(spark, rows, "doc_id long, text string")
    found = Q.rate(docs, clashing(spark, labels + [(5, None)], "doc_id long, quality int")).collect()
    assert len(found) == len(rows)
    kept = {r.doc_id: r.kept for r in found}
    wrong = [(k, y, [(r.base_failed, r.cause, r.anomaly, r.n_words, r.n_symbols) for r in found if r.doc_id == k]) for k, y in labels if kept[k] != bool(y)]
    assert len(wrong) <= 5, wrong
    assert [kept[k] for k in (900, 901, 902, 903)] == [False] * 4 and kept[None]
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == _plain(text)


def test_empty_table_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.rate(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    docs = spark.createDataFrame([(k, f"{k} " + " ".join(f"w{j}" for j in range(60))) for k in range(5)], "doc_id long, text string")
    assert all(r.kept for r in Q.rate(docs, none).collect())

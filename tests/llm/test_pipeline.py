"""The pipeline on a small corpus with planted cases against a plain version of each stage, and the registered queries on sf0.001."""

import numpy as np
import pytest
from conftest_llm import sentence
from test_decontaminate import _plain as item_distance
from test_simhash_popcount import _components, _plain_simhash

import __spark_entry__ as E
import corpus_pipeline as P
from cohortlens.llm import decontaminate, toxicity_grammar
from cohortlens.llm.line_dedup import EDIT_SHARE, near
from cohortlens.llm.word_memo import WordMemo, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, line int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    rng = random.Random(11)
    bench = [(k, " ".join(rng.choice("abcdefgh") + rng.choice(["xa", "xo", "xu"]) + str(rng.randrange(30)) for _ in range(20))) for k in range(5)]
    texts = ["\n".join(sentence(rng, rng.randint(6, 30)) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    rows = [*texts]
    rows += [texts[3], texts[4], texts[3]]  # exact copies
    rows += [texts[5] + " end", texts[6].replace("\n", "\nnew ", 1)]  # near copies
    rows += [texts[7] + "\n" + bench[0][1], sentence(rng, 30) + " " + bench[1][1].replace(" ", "  ").upper(), sentence(rng, 9) + "\n" + " ".join(bench[2][1].split()[1:])]
    rows += [t + " you idiot" for t in (sentence(rng, 12) for _ in range(25))] + [None, "", " \n", "x " * 6000]
    docs = [(k, t, "en", "hot" if k % 3 else "s", None if t is None else len(t), 1, 2) for k, t in enumerate(rows)] + [(None, "without an id here", None, None, None, None, None)]
    labels = [(k, 1, int("idiot" in (t or ""))) for k, t in enumerate(rows) if k % 2]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, bench


def test_stages_against_plain_versions(spark, corpus):
    folder, rows, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {name: None for name, _ in P.STAGES}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, folder), name)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes

    left = {k: t for k, t, *_ in rows}
    model = toxicity_grammar.Matcher(frozenset(toxicity_grammar.INSULTS))
    left = {k: t for k, t in left.items() if not any(model.counts(t or ""))}
    assert {r.doc_id: r.text for r in kept["toxicity"]} == left

    said, out = [], {}
    for k, t in sorted(left.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        lines = (t or "").split("\n")
        new = []
        for line in lines:
            words = line.encode().split()
            if words and any(near(w, words, EDIT_SHARE) for w in said):
                continue
            new.append(line)
        said += [x.encode().split() for x in lines if x.split()]
        if any(x.split() for x in new) or not any(x.split() for x in lines):
            out[k] = None if t is None else "\n".join(new)
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == out
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in kept["line_dedup"])

    ids = sorted(out, key=lambda k: (k is None, k or 0))
    root = _components([_plain_simhash(out[k] or "") for k in ids], 4)
    stay = {}
    for k, r in zip(ids, root):
        stay.setdefault(r, k)
    assert sorted((r.doc_id for r in kept["simhash_near_dedup"]), key=str) == sorted(stay.values(), key=str)

    clean = [k for k in stay.values() if not any(
        item_distance(w, decontaminate.words(out[k] or "")) <= int(0.2 * len(w)) for _, x in bench for w in [decontaminate.words(x)])]
    assert sorted((r.doc_id for r in kept["decontamination"]), key=str) == sorted(clean, key=str)

    memo, pieces = WordMemo(tokenizer_path()), {}
    for r in kept["best_fit_packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == set(clean)
    for k, found in pieces.items():
        ids_ = np.append(np.frombuffer(memo.packed(out[k] or ""), "<u4"), 0)
        assert sum(r.length for r in found) == len(ids_)


def test_run_is_the_stages_in_order(spark, corpus):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    found = P.run(spark, corpus[0])
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns) and found.count() > 50


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


CONTRACTS = {
    1: ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    3: ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    4: (None, {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}),
    6: (None, {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}),
    7: ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    9: ("documents", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}),
    10: ("documents", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                       "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    11: ("documents", {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint",
                       "groups_sha256": "string"}),
    12: ("embeddings", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}),
    13: ("embeddings", {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}),
}


def test_registered_queries(spark):
    queries = E.queries()
    names = {int(n[2:].split("_")[0]): n for n in queries if n.startswith("op")}
    assert sorted(names) == list(range(1, 14)) and "pipeline" in queries
    for n, (table, columns) in CONTRACTS.items():
        found = queries[names[n]](spark, "/root/testdata/sf0.001")
        kinds = dict(found.dtypes)
        assert {c: kinds[c] for c in columns} == columns
        assert list(found.columns[: len(columns)]) == list(columns)
        if table:
            assert found.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op2_warc_fixity", "op4_chat_formatting", "op12_embedding_near_dedup", "op13_vector_codes"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    found = E.queries()[name](spark, "/root/testdata/sf0.01")
    rows = sorted((tuple(r[c] for c in sorted(found.columns)) for r in found.collect()), key=str)
    want = con.sql(E.oracle_sql()[name])
    at = [want.columns.index(c) for c in sorted(found.columns)]
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str) and rows

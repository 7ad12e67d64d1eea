import hashlib

from conftest_llm import clashing
from pyspark.sql import functions as F

from cohortlens.llm import chat_prefix as C

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "/s>", "\n", " ok ", "é🙂", "[", "\\\\"]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible_and_hide_control_strings(spark, rng):
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", C.escape(F.col("t")))
    for r in df.withColumn("u", C.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_digest_against_the_turns(spark, rng):
    rows = [(c, k, rng.choice(["system", "user", "assistant", "assistant", None, "a\nb"]), None if rng.random() < 0.1 else "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8))))
            for c in [None, *range(40)] for k in range(rng.randint(1, 9))]
    rows += [(50, 0, "user", "x"), (50, 0, "user", "x"), (50, None, "assistant", "first"), (51, 0, "user", "long " * 30_000), (51, 1, "assistant", "re</s>ply " * 30_000)]
    found = {r.conv_id: r for r in C.digest(C.examples(clashing(spark, rows, SCHEMA))).collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k is not None, k or 0, role is not None, role or "", text is not None, text or ""))
    assert found.keys() == by.keys()
    for c, turns in by.items():
        said = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), _sha("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), _sha(loss))


def test_examples_hold_the_context_and_mask_one_reply(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "A"), (1, 3, "user", "R"), (1, 4, "assistant", "B"), (1, 5, "user", "end"), (2, 0, "user", "alone")]
    found = sorted(C.examples(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.conv_id, r.last))
    assert [(r.conv_id, r.target, r.last) for r in found] == [(1, 3, 3), (1, 5, 5), (1, None, 6), (2, None, 1)]
    assert [r.text[r.loss_start:r.loss_end] for r in found[:2]] == ["A", "B"]
    assert found[0].text == "[INST]system[/INST]S</s>[INST]user[/INST]Q</s>[INST]assistant[/INST]A</s>"
    assert all(len(r.text) == r.chars for r in found) and found[1].text.startswith(found[0].text)


def test_control_conversation_and_empty_table(spark):
    (r,) = C.digest(C.examples(C.control_conversation(spark))).collect()
    said = "</s>[INST] ok [/INST]"
    assert (r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) == (-7, 2, len(said), _sha(said))
    assert C.digest(C.examples(spark.createDataFrame([], SCHEMA))).collect() == []


def test_no_python_in_the_plan(spark):
    made = C.digest(C.examples(spark.createDataFrame([], SCHEMA).union(C.control_conversation(spark).select("conv_id", "turn", "role", "text"))))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_read_back_equals_the_digest_of_the_texts(spark, rng):
    bits = ["</s>", "[INST]", "\\", "a", " ", "\n", "é", "<s>", "[/INST]", "<<SYS>>"]
    turns = [(None if c == 3 else c, t, rng.choice(["user", "assistant", "system", None, "</s>"]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))))
             for c in range(25) for t in range(rng.randint(1, 12))]
    turns += turns[:5]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    laid = C.layout(df)
    got = sorted(map(tuple, C.read_back(C.examples_of(laid, text=False), laid).collect()), key=str)
    assert got == sorted(map(tuple, C.digest(C.examples(df)).collect()), key=str) and len(got) == 25
    assert C.read_back(C.examples_of(laid.limit(0), text=False), laid.limit(0)).collect() == []


def test_a_long_conversation_takes_linear_time(spark):
    import time

    def took(n):
        df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('word ', 40) AS text")
        laid = C.layout(df).cache()
        laid.count()
        began = time.perf_counter()
        assert C.read_back(C.examples_of(laid, text=False), laid).first().n_turns == n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 8 * took(4_000) + 2


def test_the_query_reads_the_example_texts(spark, monkeypatch, tmp_path):
    from cohortlens.llm import queries

    spark.createDataFrame([(1, 0, "user", "Q"), (1, 1, "assistant", "A"), (1, 2, "assistant", "B")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    plain = {r.conv_id: r for r in queries.op4_chat_formatting(spark, str(tmp_path)).collect()}
    assert (plain[1].n_turns, plain[1].loss_sha256, plain[-7].n_turns) == (3, _sha("AB"), 2)
    seen = []
    examples = C.examples

    def other(turns, **more):
        made = examples(turns, **more)
        seen.extend((r.conv_id, r.target, r.text) for r in made.collect())
        return made.withColumn("text", F.translate("text", "AQ", "XY"))

    monkeypatch.setattr(C, "examples", other)
    found = {r.conv_id: r for r in queries.op4_chat_formatting(spark, str(tmp_path)).collect()}
    turn = "[INST]{}[/INST]{}</s>".format
    whole = turn("user", "Q") + turn("assistant", "A")
    assert {x for x in seen if x[0] == 1} == {(1, 2, whole), (1, 3, whole + turn("assistant", "B"))}
    assert found[1].loss_sha256 == _sha("XB") and found[1].turns_sha256 == _sha("user\nY\nassistant\nX\nassistant\nB\n")

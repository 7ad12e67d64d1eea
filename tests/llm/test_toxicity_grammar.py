import zlib

from conftest_llm import clashing, sentence

from cohortlens.llm import toxicity_grammar as T


def _counts(text, insults=T.INSULTS):
    return dict(zip(T.KINDS, T.Matcher(frozenset(insults)).counts(text)))


def _only(**kinds):
    return dict.fromkeys(T.KINDS, 0) | kinds


def test_clauses():
    assert _counts("You are an idiot.") == _only(aimed=1)
    assert _counts("What a MORON!") == _only(plain=1)
    assert _counts("You are not an idiot") == _only(negated=1)
    assert _counts("He said you are an idiot") == _only(reported=1)
    assert _counts('"You moron" is rude') == _only(reported=1)
    assert _counts("I will kill you") == _only(threat=1)
    assert _counts("They kill time") == _only(threat=1)
    assert _counts("Kill the lights") == _only()
    assert _counts("I like you. What a clown") == _only(plain=1)
    assert _counts("Not now; idiot") == _only(plain=1)
    assert _counts("") == _only() and _counts("...\n12") == _only()


def test_composition_is_running_one_after_the_other(rng):
    parts = [T._negation(), T._reported(), T._target()]
    for _ in range(500):
        labels = "".join(rng.choice(T.ALPHABET) for _ in range(rng.randint(0, 12)))
        out = labels
        for p in parts:
            out = p(out)
        assert T.GRAMMAR(labels) == out


def test_spans_hold_the_clause():
    text = "All fine here. You are such an Idiot, really! Bye."
    (span,) = T.Matcher(frozenset(T.INSULTS)).spans(text)
    assert text[span["start"]:span["end"]] == "You are such an Idiot, really" and span["kinds"] == ["aimed"]


def _corpus(rng, n=700):
    """A made-up insult stem with many endings marks toxic rows; one copy group repeats a harmless rare word."""
    rows, labels = [], []
    for k in range(n):
        words = sentence(rng, rng.randint(5, 60)).split()
        toxic = k % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = "grumbo" + rng.choice(["l", "lix", "nat", "rre", "sti", "vam", "zet"])
            if k < 240:
                words.append("rareword")
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_learnt_entries(spark, rng):
    rows, labels = _corpus(rng)
    docs = clashing(spark, rows + [(None, None), (9000, ""), (9001, "ok " * 50_000), (9002, "a new grumboquo")], "doc_id long, text string")
    model = T.fit(docs, clashing(spark, labels + [(3, None), (None, 1), (0, 0)], "doc_id long, toxic int"))
    assert "^grumbo" in model.insults and "rareword" not in model.insults
    scored = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert [k for k, y in held if scored[k].predicted != y] == [] and len(held) > 50
    assert [scored[k].predicted for k in (None, 9000, 9001, 9002)] == [0, 0, 0, 1]
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in scored.values() if not r.predicted)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (2, "you are not an idiot")], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert sorted((r.doc_id, r.predicted) for r in T.score(docs, model).collect()) == [(1, 1), (1, 1), (2, 0)]
    assert T.score(docs.limit(0), model).collect() == []

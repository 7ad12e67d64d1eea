import random

import numpy as np

from cohortlens.llm.word_memo import WordMemo, tokenizer_path


def test_same_ids_as_the_whole_text():
    memo = WordMemo(tokenizer_path())
    rng = random.Random(3)
    bits = [" ", " ", "  ", "   ", "\n", "\n\n", "\t", " ", " ", "a", "The", "dont", "don't", ".", ",", "12", "é", "日本", "!?", "%%%", "<|endoftext|>", "\x1c", "\x85", "🙂", "x" * 70]
    texts = ["", " ", "  ", "\n", " a", "a ", "a  ", "a \n b", "a\n  b"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    got = memo.packed_batch(texts)
    for text, ids in zip(texts, got):
        want = memo.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)


def test_columns_find_the_white_space_that_python_finds():
    import pyarrow as pa
    import pyarrow.compute as pc

    from cohortlens.llm import word_memo

    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    texts = [*spaces, *(f"a{c}" for c in spaces), *(f"a{c}b" for c in spaces), *(f"a{c}{d}b" for c in spaces for d in spaces), "", "ab", "a b\nc", "a b\n", "a\u200bb", "a\u180eb"]
    found = pc.match_substring_regex(pa.array(texts, pa.large_string()), word_memo._RUNS_COLUMN).to_pylist()
    assert found == [word_memo._RUNS.search(t) is not None for t in texts]


def test_words_in_use_are_encoded_once(monkeypatch):
    from cohortlens.llm import word_memo

    monkeypatch.setattr(word_memo, "MEMO_ENTRIES", 40)
    memo, learnt = WordMemo(tokenizer_path()), []
    learn = memo._learn
    monkeypatch.setattr(memo, "_learn", lambda new: learnt.extend(new) or learn(new))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioust") for _ in range(12))
    often = [" ".join(word() for _ in range(5)) for _ in range(2)]
    for k in range(40):
        texts = [f"a {often[k % 2]} {' '.join(word() for _ in range(5))}"]
        want = [memo.whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(p, "<u4").tolist() for p in memo.packed_batch(texts)] == want
    assert max(learnt.count(w) for t in often for w in t.split()) == 1
    assert len(memo.memo) + len(memo.older) <= 60


def test_words_are_spelled_in_the_alphabet_of_bytes():
    from tokenizers import pre_tokenizers

    from cohortlens.llm.word_memo import _spelled

    words = ["a", "Zz", "été", "ÀÖØöøÿĀſɏ", "x" * 70] + [chr(c) for c in [*range(0x100, 0x250), 0x3042, 0x1F642]]
    pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    assert _spelled(words) == ["".join(x for x, _ in pre.pre_tokenize_str(w)) for w in words]

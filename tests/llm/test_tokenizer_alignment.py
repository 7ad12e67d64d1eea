import hashlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import clashing, sentence
from pyspark.sql import functions as F

from cohortlens.llm import tokenizer_alignment as T
from cohortlens.llm.word_memo import tokenizer_path


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def _plain_align(both, text):
    """Groups by whole encodings of the text and sets of ends."""
    if not text:
        return None
    a, b = both
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    decoder = {c: x for x, c in _bytes_to_unicode().items()}
    bytes_a = [bytes(decoder[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    said = (" " + text).encode()
    if b"".join(bytes_a) != said or b"".join(bytes_b) != said:
        return None
    ends_a, ends_b = ([sum(map(len, x[:k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b))
    groups, links, p, q = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((ids_a[p:i], ids_b[q:j]))
        links.append((ids_a[i - 1], ids_b[j - 1]))
        p, q = i, j
    return len(ids_a), len(ids_b), groups, links


def _bytes_to_unicode():
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, more = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in out:
            out[b], more = chr(more), more + 1
    return out


def _plain(both, texts):
    found = [_plain_align(both, t) for t in texts]
    counts = Counter(x for f in found if f for x in f[3])
    high = defaultdict(int)
    for (_, b), n in counts.items():
        high[b] = max(high[b], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        rows.append((f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == high[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(said.encode()).hexdigest()))
    return rows, counts, high


EDGES = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "\nfoo", "\n\n", "a\n\nb", "\t x", "tab\tbed", "x▁y", "▁", "<s> </s> <unk> <0x41> <|endoftext|>",
         "你好世界", "naïve café ́x", "\U0001f600 ok nb 　w", "don't we'll 1234567 3.14", "}\r\nx \r y", "\x00a \x00", "a b‍"]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _texts(rng):
    line = sentence(rng, 60)
    made = [sentence(rng, rng.randint(1, 80)).replace(" ", rng.choice([" ", "\n", ", ", "  "])) for _ in range(60)]
    odd = ["".join(rng.choice("ab \n\t\ré漢.,'<>1▁ ") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    return EDGES + made + odd + [line] * 30 + [line + " " + line] + [sentence(rng, 4000)]


@pytest.mark.parametrize("sizes", [{}, {"run_records": 200, "bucket_records": 40}])
def test_equals_plain_alignment_and_counting(spark, both, rng, sizes, monkeypatch):
    """Small runs and buckets: many pieces a merge, B ids split over buckets, a memo that starts anew."""
    texts = _texts(rng)
    if sizes:
        monkeypatch.setattr(T, "BLOCK_RECORDS", 16)
    docs = clashing(spark, list(enumerate(texts)), "doc_id int, text string").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in T.aligned_scores(docs, **sizes).collect()}
    want, _, _ = _plain(both, texts)
    assert len(got) == len(texts)
    assert [(t, got[k]) for k, t in enumerate(texts)] == list(zip(texts, want))


def test_pair_counts(spark, both, rng):
    texts = _texts(rng)[20:]
    aligned = T.materialize(T.align(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), groups=True), "aligned")
    _, counts, high = _plain(both, texts)
    got = {(r.a, r.b): (r["count"], r.best) for r in T.pair_counts(aligned, bucket_records=100).collect()}
    assert got == {k: (n, n == high[k[1]]) for k, n in counts.items()}
    for r in aligned.filter("n_links > 0").limit(20).collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256


def test_forgetting_changes_nothing(both, rng):
    aligner, texts = T.Aligner(tokenizer_path(T.TOKENIZER_A), tokenizer_path(T.TOKENIZER_B)), [t or "" for t in _texts(rng)]
    first = [aligner([t])[1][0] for t in texts]
    aligner.chars = T.MEMO_CHARS + 1
    assert aligner(texts[:200])[1] + aligner(texts[200:])[1] == first


def test_buckets_cover_every_id():
    buckets = T.Buckets([(5, 10), (2, 3), (9, 1000), (11, 4), (12, 200)], 2, 100)
    import numpy as np

    uid = np.arange(2000)
    assert set(buckets.of(np.full(2000, 9), uid)) == set(range(buckets.first[9], buckets.first[9] + 10))
    assert buckets.split[12] == 2 and buckets.first[2] == buckets.first[5] == 0 and buckets.number == 1 + 10 + 1 + 2


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert T.aligned_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = T.aligned_scores(spark.createDataFrame([(None, "one two"), (None, "one two"), (1, "one two"), (1, None)], "doc_id long, text string"))
    assert sorted(map(tuple, rows.select(F.coalesce("doc_id", F.lit(-1)), "n_links", "n_best", "count_sum").collect())) == [(-1, 2, 2, 6), (-1, 2, 2, 6), (1, 0, 0, 0), (1, 2, 2, 6)]

import zlib

import numpy as np
import pytest
from conftest_llm import clashing, sentence

from cohortlens.llm import token_output
from cohortlens.llm.common import materialize
from cohortlens.llm.word_memo import WordMemo, tokenizer_path

SCHEMA = "doc_id long, text string"


def _write(spark, rows, **options):
    folder = token_output.write_tokens(clashing(spark, rows, SCHEMA), token_output.token_folder(spark), **options)
    digests = materialize(token_output.digests(token_output.read_tokens(spark, folder)), "d")
    return folder, token_output.with_starts(digests).collect()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip_in_document_order(spark, rng, encoding):
    rows = [(k, sentence(rng, rng.randint(0, 60))) for k in rng.sample(range(1000), 120)] + [(5000, None), (5001, ""), (5002, "x" * 30_000), (5003, "a  b \n c"), (5003, "a  b \n c"), (None, "no id")]
    folder, found = _write(spark, rows, encoding=encoding)
    memo = WordMemo(tokenizer_path())
    ids = lambda t: np.array(memo.whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    start = 0
    found.sort(key=lambda r: (r.part, r.pos))
    assert [r.doc_id for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    texts = {k: t for k, t in rows}
    for r in found:
        want = ids(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    index = token_output.read_index(spark, folder).collect()
    assert sorted((r.part, r.pos, r.start) for r in index) == sorted((r.part, r.pos, r.start) for r in found)


def test_empty_table(spark):
    assert _write(spark, [])[1] == []


def test_unknown_encoding(spark):
    with pytest.raises(ValueError):
        token_output.write_tokens(spark.createDataFrame([], SCHEMA), "unused", encoding="plain")

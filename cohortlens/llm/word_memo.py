"""Byte-level BPE ids of whole texts, by the tokenizers library, with a memo of chunks between spaces.

A byte-level BPE first cuts a text into words; a cut stands before every
single space and around every line break between two non-space characters,
and between a word's letters and the marks that follow. So the ids of a text
are the ids of such chunks in order. Chunks recur far more often than texts:
each is encoded once per task and looked up after that. Cutting, the distinct
chunks of a batch and the texts' ids from theirs are columnar (Arrow): Python
handles a chunk once a batch.
"""

from __future__ import annotations

import codecs
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_ENTRIES = 700_000  # entries kept in a task; at half of them the memo starts anew, and the half before is dropped
MEMO_CHARS = 40  # longer chunks are encoded each time
MEMO_MARKS = 10_000  # runs of marks kept
JOINED = 256  # new chunks encoded as one text
_RUNS = re.compile(r"\s(?=\s|\Z)")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # what \s is in Python
_RUNS_COLUMN = f"[{_SPACE}](?:[{_SPACE}]|\\z)"  # _RUNS for a column
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
_MARKS = ".,;:!?"

_AS_THEY_ARE = {*range(33, 127), *range(161, 173), *range(174, 256), 10}  # the line break parts words and is in none
_ALPHABET = "".join(chr(b) if b in _AS_THEY_ARE else chr(256 + sum(x not in _AS_THEY_ARE or x == 10 for x in range(b))) for b in range(256))  # bytes as byte-level vocabularies write them


def _spelled(words: list[str]) -> list[str]:
    """Words without white space, in the alphabet of bytes."""
    return codecs.charmap_decode("\n".join(words).encode(), "strict", _ALPHABET)[0].split("\n")


def _strings(column: pa.Array) -> list[str]:
    """Faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _cut(texts: list[str]) -> tuple[pa.ListArray, list[int]]:
    """The chunks of each text, and the texts' numbers in the order in which they stand. All but a text's first chunk lack their leading space."""
    column = pa.array(texts, pa.large_string())
    runs = pc.match_substring_regex(column, _RUNS_COLUMN).to_numpy(zero_copy_only=False)
    odd, plain = np.flatnonzero(runs).tolist(), np.flatnonzero(~runs).tolist()
    lists = pc.split_pattern(pc.replace_substring(column.filter(pa.array(~runs)) if odd else column, "\n", " \n"), " ")
    if odd:
        lists = pa.concat_arrays([lists, pa.array([_CUT.split(texts[k]) for k in odd], lists.type)])
    return lists, plain + odd


class WordMemo:
    """``packed(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.letters = Tokenizer.from_file(path)  # for letters without their marks, one word in a line, written in the alphabet of bytes already
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters.model._resize_cache(0)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memo: dict[str, bytes] = {}  # by the chunk without its leading space; a chunk after a line break has the break
        self.older: dict[str, bytes] = {}  # the memo before it started anew; what is used again goes over
        self.marks: dict[str, bytes] = {}  # of marks after letters
        vocabulary = self.whole.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("\u0120")
        self.line_break = self.whole.encode("\n", add_special_tokens=False).ids

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, tokenizer, chunks: list[str], by: str, opens) -> list[bytes]:
        """Ids of chunks, encoded many in one text with ``by`` before each; a chunk begins where ``opens`` holds."""
        out = []
        for at in range(0, len(chunks), JOINED):
            part = chunks[at:at + JOINED]
            (ids,) = self._ids(tokenizer, [by.removeprefix("\n") + by.join(part)])
            starts = (4 * np.flatnonzero(opens(ids))).tolist()
            packed = ids.tobytes()
            if len(starts) != len(part):
                raise ValueError("the vocabulary is not a byte-level one with single spaces before words")
            out += map(packed.__getitem__, map(slice, starts, [*starts[1:], len(packed)]))
        return out

    def _letters(self, letters: list[str]) -> list[bytes]:
        """Ids of words of letters; most have been said without marks or with others."""
        found = [self.memo.get(w) or self.older.get(w) for w in letters]
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            for k, x in zip(new, self._joined(self.letters, _spelled([letters[k] for k in new]), "\n\u0120", lambda ids: self.opens[ids])):
                found[k] = x
        return found

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        chunks = pa.array(new, pa.large_string())
        letters = pc.utf8_rtrim(chunks, characters=_MARKS)  # letters and the marks after them are cut apart
        worded = pc.match_substring_regex(letters, _LETTERS)
        words, others = _strings(chunks.filter(worded)), _strings(chunks.filter(pc.invert(worded)))
        letters = letters.filter(worded)
        tails = [c[n:] for c, n in zip(words, pc.utf8_length(letters).to_numpy().tolist())]
        if len(self.marks) > MEMO_MARKS:
            self.marks = {}
        if marks := list(set(tails).difference(self.marks)):
            self.marks.update(zip(marks, (x.tobytes() for x in self._ids(self.whole, marks))))
        letters = letters.dictionary_encode()
        heads = map(self._letters(_strings(letters.dictionary)).__getitem__, letters.indices.to_numpy().tolist())
        out = {c: head + tail for c, head, tail in zip(words, heads, map(self.marks.__getitem__, tails))}
        lines, spaced, rest = [], [], []
        for c in others:
            if " " in c:
                rest.append(" " + c)
            elif c[:1] == "\n":
                (rest if "\n" in c[1:] else lines).append(c)
            else:
                spaced.append(c)
        out |= zip(spaced, self._joined(self.whole, spaced, " ", lambda ids: self.opens[ids]))
        if len(self.line_break) == 1:
            out |= zip(lines, self._joined(self.whole, lines, "", lambda ids: ids == self.line_break[0]))
        else:
            rest += lines
        return out | {c.removeprefix(" "): x.tobytes() for c, x in zip(rest, self._ids(self.whole, rest))}

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without their leading space, each of them given once."""
        if len(self.memo) > MEMO_ENTRIES // 2:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, chunks))
        if missing := [k for k, x in enumerate(found) if x is None]:
            said = [chunks[k] for k in missing]
            again = {c: x for c, x in zip(said, map(self.older.get, said)) if x is not None}
            learnt = again | self._learn([c for c in said if c not in again] if again else said)
            for k, c in zip(missing, said):
                found[k] = learnt[c]
            self.memo.update(learnt if max(map(len, said)) <= MEMO_CHARS else {c: x for c, x in learnt.items() if len(c) <= MEMO_CHARS})
        return found

    def packed_batch(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lists, order = _cut(texts)
        chunks, starts = lists.flatten(), lists.offsets.to_numpy()
        rest = np.ones(len(chunks), bool)
        rest[starts[:-1]] = False
        heads = self._ids(self.whole, _strings(chunks.filter(pa.array(~rest))))
        words = chunks.filter(pa.array(rest)).dictionary_encode()
        packed = pa.array(self._known(_strings(words.dictionary)), pa.large_binary()).take(words.indices)
        _, ends, data = packed.buffers()
        at = np.frombuffer(ends, "i8")[starts - np.arange(len(starts))].tolist()  # a text before has one chunk less here
        data = memoryview(data or b"")
        out: list[bytes] = [b""] * len(texts)
        for k, head, a, b in zip(order, heads, at, at[1:]):
            out[k] = head.tobytes() + data[a:b]
        return out

    def packed(self, text: str) -> bytes:
        return self.packed_batch([text])[0]


@cache
def worker_memo(path: str) -> WordMemo:
    """The one memo of this Python worker, which serves many tasks."""
    return WordMemo(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

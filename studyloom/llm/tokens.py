"""Encoding of whole texts with a public byte-level tokenizer.

Encoding is a tree reduction over a monoid whose elements are encoded spans of one text. Every text
is halved until spans are short, spans are encoded by the public library, and neighbours are joined.
A join encodes a window around the seam again and keeps the tokens outside it. The window grows until
both its ends are places where a word begins whatever stands around them:

* The splitting pattern matches from left to right without looking back, and what it matches depends
  on at most two characters past the match. Where a blank follows something that is no blank, and
  where two different classes of letters, digits and marks meet (but for a letter behind an
  apostrophe), every match ends, so a word begins there in the span alone and in the joined text.
  Words before the window and after it are therefore the same in both.
* In a window that holds one long word only, tokens are joined: a sequence of tokens is the word's
  encoding exactly if each neighbouring pair encodes to itself. A growing window of tokens around the
  seam is encoded again until its first and last token are those that stood there before; then every
  pair is one already known.

Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the splitting pattern of the public vocabulary byte_bpe_50k.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest span, in characters, that is encoded at once.
LEAF_CHARS = 256
#: Characters beside a seam that are looked at first for the window's end.
WINDOW = 32
#: Spans of fewer tokens are held as lists, which join faster; longer ones as arrays.
LIST_TOKENS = 4_096
#: Words longer than this, in characters, are joined token by token.
LONG_WORD = 4_000
#: Places where a word begins whatever stands around them, with one character on either side.
_SURE = r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"


class Span(NamedTuple):
    """The encoded stretch ``text[start:end]``."""

    start: int
    end: int
    ids: list[int] | np.ndarray


def _array(*parts: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([np.asarray(p, np.int32) for p in parts])


class Tokenizer:
    """Byte-level encoder for one rank file of ``folder``."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF_CHARS, long_word: int = LONG_WORD, window: int = WINDOW):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.leaf, self.long_word, self.window = leaf, long_word, window
        #: Joins made so far, and those that went on inside one long word.
        self.joins = self.long_joins = 0
        self.library = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self._sure, self._sure_last = regex.compile(PATTERN), regex.compile(_SURE), regex.compile(f"(?r){_SURE}")
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        #: Ids are below this.
        self.size = max(ranks.values()) + 1
        self._length = np.zeros(self.size, np.int64)
        self._length[list(ranks.values())] = [len(t) for t in ranks]

    # --- leaves ---

    def _word(self, word: str) -> list[int]:
        return self.library._encode_single_piece(word.encode("utf-8", "surrogatepass"))

    # --- the monoid ---

    def _window(self, text: str, start: int, seam: int, end: int) -> tuple[int, int]:
        """The nearest sure beginnings of words before and behind ``seam``, or the ends of the spans where there are none."""
        # The common case first: a single blank behind a word.
        low = text.rfind(" ", max(start + 1, seam - self.window), seam - 1)
        if low < 0 or text[low - 1].isspace():
            m = self._sure_last.search(text, start, seam)
            low = m.start() if m and m.start() > start else start
        high = text.find(" ", seam + 1, min(end, seam + self.window))
        if high < 0 or text[high - 1].isspace():
            m = self._sure.search(text, seam, end)
            while m and m.start() <= seam:
                m = self._sure.search(text, m.start() + 1, end)
            high = m.start() if m and m.start() < end else end
        return low, high

    def join(self, text: str, left: Span, right: Span) -> Span:
        """The encoded concatenation of two neighbouring spans of ``text``."""
        start, seam, end = left.start, left.end, right.end
        self.joins += 1
        low, high = self._window(text, start, seam, end)
        if high - low > self.long_word:
            return self._join_long(text, left, right, low, high)
        encode, a, b = self.library.encode_ordinary, left.ids, right.ids
        kept, dropped = len(a) - len(encode(text[low:seam])), len(encode(text[seam:high]))
        if type(a) is list and type(b) is list and len(a) + len(b) < LIST_TOKENS:
            return Span(start, end, [*a[:kept], *encode(text[low:high]), *b[dropped:]])
        return Span(start, end, _array(a[:kept], encode(text[low:high]), b[dropped:]))

    def _words(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text, start, end)]

    def _join_long(self, text: str, left: Span, right: Span, low: int, high: int) -> Span:
        """A join whose window holds a long word: words of the window one by one, the one across the seam token by token."""
        self.long_joins += 1
        seam = left.end
        left, right = left._replace(ids=_array(left.ids)), right._replace(ids=_array(right.ids))
        before, behind = self._words(text, low, seam), self._words(text, seam, high)
        # Places of each word's first token, counted from the seam in bytes.
        ends = np.cumsum(self._length[left.ids[::-1]])
        starts = np.cumsum(self._length[right.ids])
        size = lambda a, b: len(text[a:b].encode("utf-8", "surrogatepass"))
        kept = len(left.ids) - (int(np.searchsorted(ends, size(low, seam))) + 1 if low < seam else 0)
        dropped = int(np.searchsorted(starts, size(seam, high))) + 1 if high > seam else 0
        middle: list[int] = []
        for a, b in self._words(text, low, high):
            if a < seam < b and b - a > self.long_word and before and before[-1] == (a, seam) and behind[0] == (seam, b):
                k = int(np.searchsorted(ends, size(a, seam))) + 1
                n = int(np.searchsorted(starts, size(seam, b))) + 1
                middle += self._seam(left.ids[len(left.ids) - k :].tolist(), right.ids[:n].tolist())
            else:
                middle += self._word(text[a:b])
        return Span(left.start, right.end, np.concatenate([left.ids[:kept], np.asarray(middle, np.int32), right.ids[dropped:]]))

    def _seam(self, a: list[int], b: list[int]) -> list[int]:
        """Join the encodings of two parts of one word by encoding a growing window again."""
        width = 8
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            window = self.library._encode_single_piece(b"".join(self.token_bytes[t] for t in a[i:] + b[:j]))
            stands_left = i == 0 or window[0] == a[i]
            stands_right = j == len(b) or window[-1] == b[j - 1]
            if stands_left and stands_right and len(window) > 1 or i == 0 and j == len(b):
                return a[:i] + window + b[j:]
            width *= 2

    def _tree(self, text: str, start: int, end: int) -> Span:
        if end - start <= self.leaf:
            return Span(start, end, self.library.encode_ordinary(text[start:end]))
        half = (start + end) // 2
        return self.join(text, self._tree(text, start, half), self._tree(text, half, end))

    # --- whole texts ---

    def encode(self, text: str | None) -> list[int] | np.ndarray:
        """Token ids of a text; an empty list for an empty or null text. No special tokens."""
        return self._tree(text, 0, len(text)).ids if text else []

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, concatenated up a balanced tree; bytes that are no UTF-8 become U+FFFD."""

        def up(a: int, b: int) -> bytes:
            if b - a <= 4096:
                return b"".join(self.token_bytes[i] for i in ids[a:b])
            return up(a, (a + b) // 2) + up((a + b) // 2, b)

        return up(0, len(ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Tokenizer:
    """One encoder for each worker process."""
    return Tokenizer(name, folder)


def _encode_batches(name: str, folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(name, folder)
        for batch in it:
            offsets, parts, at, sent = [0], [], 0, 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = np.asarray(encoder.encode(texts[i].as_py()), np.int32)
                parts.append(ids)
                at += len(ids)
                offsets.append(at)
                if at >= 2_000_000 or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(sent, i + 1 - sent), lists], ["key", "ids"])
                    offsets, parts, at, sent = [0], [], 0, i + 1

    return run


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids array<int>`` for every row; an empty list for an empty or null text. Null keys are kept."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches(name, folder), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Number of tokens of a text column; 0 for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = tokenizer(name, folder)
        return texts.map(encoder.count)

    return count(text)


def decode_texts(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, text`` of encoded rows; null for null ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(name, folder)
        for batch in it:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

"""Encoding with a byte-level BPE vocabulary given as ranks.

A text is split by the vocabulary's pattern; each word is encoded by the
contiguous rank array: the boundaries of its parts and, next to each, the rank
of the pair that begins there lie in two arrays. The smallest rank is looked
for by scanning, its inner boundary is deleted, and the ranks on either side
are refreshed. For words longer than ``SHORT`` bytes the same merges are taken
from a heap over the same boundaries, so a page-long word stays n log n.

Defined results: NULL and empty texts give the empty list; the strings of
special tokens are ordinary text; every other text, however garbled, gives ids
whose bytes join to the text's UTF-8 bytes.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("DOCKLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 128
_NONE = 1 << 60
#: Words a worker remembers; each is at most _CACHED characters, so the cache stays below some 60 MB.
_WORDS, _CACHED = 200_000, 32


class RankEncoder:
    """Encoder of one vocabulary file; made once per Python worker."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def _short(self, word: bytes) -> list[int]:
        ranks = self.ranks
        get = ranks.get
        n = len(word)
        bounds = list(range(n + 1))
        pair = [get(word[i : i + 2], _NONE) for i in range(n - 1)]
        while pair:
            low = min(pair)
            if low == _NONE:
                break
            i = pair.index(low)
            del bounds[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                pair[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _long(self, word: bytes) -> list[int]:
        get = self.ranks.get
        n = len(word)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        current = [get(word[i : i + 2], _NONE) for i in range(n - 1)] + [_NONE]
        heap = [(r, i) for i, r in enumerate(current) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or current[i] != rank:
                continue
            j = end[i]
            alive[j] = False
            end[i] = end[j]
            if end[i] < n:
                left[end[i]] = i
            for k in (i, left[i]):
                if k >= 0:
                    stop = end[end[k]] if end[k] < n else None
                    current[k] = _NONE if stop is None else get(word[k:stop], _NONE)
                    if current[k] != _NONE:
                        heapq.heappush(heap, (current[k], k))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        return tuple(self._short(raw) if len(raw) <= SHORT else self._long(raw))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        for w in self.find(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= _CACHED:
                    if len(cache) >= _WORDS:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out


_encoders: dict[str, RankEncoder] = {}


def encoder(path: str = VOCABULARY) -> RankEncoder:
    """The encoder of a vocabulary file, from the path itself or, where that isn't there, from the files shipped to the worker."""
    if path not in _encoders:
        here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        _encoders[path] = RankEncoder(here)
    return _encoders[path]


def ship(path: str) -> None:
    """Send the driver's vocabulary file to the executors, once per session."""
    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.exists(path) and not spark.sparkContext.master.startswith("local["):
        name = os.path.basename(path)
        if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
            spark.sparkContext.addFile(path)


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """The ids of ``text`` as an array of integers."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts], index=texts.index, dtype=object)

    ship(path)
    return F.pandas_udf(encode, "array<int>")(text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """The number of ids of ``text``; the ids themselves stay in the worker."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([len(e.encode(t)) for t in texts], index=texts.index, dtype="int64")

    ship(path)
    return F.pandas_udf(count, "bigint")(text)


def encode_corpus(documents: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every document. No exchange: each partition encodes what it reads."""
    return documents.select(F.col(key), token_ids(F.col(text), path).alias("ids"))

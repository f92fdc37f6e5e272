"""Operator 10, substring dedup over words by a compressed FM-index per shard.

A shard is a stretch of k-grams of words: it holds the contexts of all windows that those grams own (see
``repeats``), so a window is searched in one shard only, however many there are. For a shard the suffix
array of its contexts is sorted, the Burrows-Wheeler transform goes into a wavelet matrix, and backward
search runs for all windows at once, word by word. The interval of a window in the suffix array gives, by a
range minimum, the smallest document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_words, table
from .repeats import finish, keyed, repeated, with_first
from .words import Words, shingles

SPAN, GRAM = 13, 5


def units(text: str) -> np.ndarray:
    return Words([text], lower=False).hash


def grams(x: np.ndarray) -> np.ndarray:
    return shingles(x, GRAM) if len(x) >= SPAN else np.empty(0, np.uint64)


def suffix_array(text: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes sorted by their first ``reach`` symbols, by prefix doubling."""
    rank, n, length = np.unique(text, return_inverse=True)[1].astype(np.int64), len(text), 1
    while True:
        late = np.zeros(n, np.int64)
        late[:-length or None] = rank[length:] + 1 if length < n else 0
        key = rank * (n + 1) + late
        order = np.argsort(key, kind="stable")
        if 2 * length >= reach:
            return order
        step = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        length *= 2


class Wavelet:
    """Wavelet matrix: a bit vector for each bit of the symbols, most significant first.

    Bits are packed into words of 64 with one running count of 32 bits for each, 1.5 bits a bit; a rank adds
    the count of a word and the bits of it that stand before.
    """

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.bits = max(1, int(kinds - 1).bit_length())
        self.words, self.ones, self.split = [], [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1 == 1
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            packed[: (len(bit) + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]]).astype(np.int32))
            self.split.append(int(len(bit) - np.count_nonzero(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many ones stand before ``at`` in a level."""
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & below).astype(np.int64)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` leads down the levels of ``symbol``; less what 0 leads to, how often it stands before ``at``."""
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a = self._ones(level, at)
            at = np.where(one, a + self.split[level], at - a)
        return at


class Index:
    """FM-index of sequences of symbols >= 1, joined by the symbol 0; a document rank for each position."""

    def __init__(self, text: np.ndarray, documents: np.ndarray, reach: int):
        order = suffix_array(text, reach)
        kinds = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.wavelet, self.n = Wavelet(text[order - 1], kinds), len(text)
        every = np.arange(kinds)
        self.begin = self.before[:-1] - self.wavelet.walk(every, np.zeros(kinds, np.int64))
        self.lows, width = [documents[order]], 1
        while 2 * width <= len(text):
            last = self.lows[-1]
            self.lows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of the runs with ``word`` put before them."""
        return self.begin[word] + self.wavelet.walk(word, low), self.begin[word] + self.wavelet.walk(word, high)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows of ``windows`` in the suffix array."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            low, high = self.extend(windows[:, j], low, high)
        return low, high

    def matching(self, text: np.ndarray, ends: np.ndarray, document: np.ndarray, reach: int) -> np.ndarray:
        """Matching statistics: how long a run that ends at each of ``ends`` also stands in a smaller document.

        The last ``reach`` symbols of ``text`` up to each end belong to ``document``; longer runs count as ``reach``.
        """
        length = np.zeros(len(ends), np.int8)
        low, high, live = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64), np.arange(len(ends))
        for step in range(reach):
            low, high = self.extend(text[ends[live] - step], low, high)
            more = self.smallest(low, high) < document[live]
            live, low, high = live[more], low[more], high[more]
            length[live] = step + 1
        return length

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.minimum(np.frexp((high - low).astype(float))[1] - 1, len(self.lows) - 1)
        out = np.empty(len(low), self.lows[0].dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.lows[k][low[own]], self.lows[k][high[own] - (1 << int(k))])
        return out


def resolve(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also stand in a document with a smaller id, in rows with equal grams."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    lonely = ~f.duplicated("g", keep=False).to_numpy()
    f, back = f[~lonely], np.flatnonzero(~lonely)
    if not len(f):
        return none
    parts = [np.frombuffer(x, np.uint64) for x in f["ctx"]]
    length = np.array([len(x) for x in parts])
    words, symbol = np.unique(np.concatenate(parts), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    text = np.zeros(int((length + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[start + length] = False
    text[inside] = symbol + 1
    ids, document = np.unique(f["id"].to_numpy(), return_inverse=True)
    low, high = f["low"].to_numpy(np.int64), f["high"].to_numpy(np.int64)
    count = high - low + 1
    row = np.repeat(np.arange(len(f)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)  # from the context's first window
    index = Index(text, np.repeat(document, length + 1).astype(np.int32), SPAN)
    hit = index.matching(text, start[row] + offset + SPAN - 1, document[row], SPAN) >= SPAN
    return back[row[hit]], (high[row] - offset)[hit]


def keep(words: list[bytes], stay: list[tuple[int, int]]) -> bytes:
    return b" ".join(w for a, b in stay for w in words[a:b])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Null text has no words. Texts of fewer than 13 words lose nothing. A null id comes after all others. Rows
    repeated with one id are one document for what repeats. An empty table gives an empty result. Other
    columns are ignored.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [split_words(t) for t in pdf["t"]]
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "u": pdf["u"], "n": [len(w) for w in words], "sha": sha})

    meta = with_first(keyed(docs).mapInPandas(count, "id long, u long, n long, sha string"))
    covered = repeated(docs, units, grams, resolve, meta, SPAN, GRAM, other=True, many=lambda texts: Words(texts, lower=False))
    out = finish(docs, meta, covered, split_words, keep, SPAN)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op10_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, j, w[j] AS word, CASE WHEN j + 12 <= len(w) THEN array_to_string(w[j:j + 12], ' ') END AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM w)),
f AS (SELECT key, min(doc_id) AS first FROM g WHERE key IS NOT NULL GROUP BY key),
m AS (
  SELECT doc_id, j, word, coalesce(max(doc_id > first) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM g LEFT JOIN f USING (key)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

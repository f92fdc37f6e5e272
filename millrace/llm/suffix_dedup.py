"""Operator 7, substring dedup over bytes by distributed prefix doubling.

Positions are ranked by their prefixes of growing length. The first ranks are hashes of k bytes, made by
doubling (1, 2, 4, 8, 16 and 24 bytes); by them every 100-byte window names one position in it, its owner
(see ``repeats``). Spark sorts the owners by rank and drops those whose rank is unique, which is what the
reranking rounds of prefix doubling do. What is left carries its context through one more sort by Spark;
there every window gets one rank of its 100 bytes (rank of a prefix and rank of what follows, as in a
doubling step), which tells it apart or not; there are no further rounds.

Sorting all positions of the corpus in each round, as the textbook does, would shuffle more than ten times
the input a round; naming an owner first leaves about one position in 39 and changes no result, because
equal windows have equal owners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import finish, keyed, repeated, with_first
from .words import mixed

SPAN, GRAM = 100, 24
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def grams(x: np.ndarray) -> np.ndarray:
    """Ranks by the next 24 bytes: pairs of ranks at offsets 1, 2, 4, 8, then 16 and 8."""
    if len(x) < SPAN:
        return np.empty(0, np.uint64)
    rank, eight = _TABLE[x], None
    for offset in (1, 2, 4, 8):
        if offset == 8:
            eight = rank
        rank = rank[:-offset] * _power(offset) + rank[offset:]
    return mixed(rank[:-8] * _power(8) + eight[16:])


def resolve(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also start earlier, in order of (doc_id, start), in rows with equal grams."""
    if not len(f):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((f["at"].to_numpy(), f["u"].to_numpy(), f["id"].to_numpy()))
    low, high = f["low"].to_numpy(np.int64)[order], f["high"].to_numpy(np.int64)[order]
    gram = f["g"].to_numpy().view(np.uint64)[order]
    rows, starts = [], []
    for begin in range(0, 77, 26):  # offsets in three stretches, for memory
        part = np.flatnonzero((low < begin + 26) & (high >= begin))
        if not len(part):
            continue
        # Rank of the prefix that ends where a window of the smallest offset does, for each row.
        size = 26 + SPAN
        text = np.zeros((len(part), size), np.uint8)
        top = np.minimum(high[part], begin + 25)
        bottom = np.maximum(low[part], begin)
        ctx = f["ctx"].to_numpy()[order[part]]
        for r in range(len(part)):
            skip = high[part[r]] - top[r]
            own = np.frombuffer(ctx[r], np.uint8)[skip : skip + top[r] - bottom[r] + SPAN]
            text[r, : len(own)] = own
        ahead = np.zeros((len(part), size + 1), np.uint64)
        for j in range(size):
            ahead[:, j + 1] = ahead[:, j] * _BASE + _TABLE[text[:, j]]
        for o in range(begin, begin + 26):
            own = np.flatnonzero((bottom <= o) & (top >= o))
            if not len(own):
                continue
            at = top[own] - o
            rank = mixed((ahead[own, at + SPAN] - ahead[own, at] * _power(SPAN)) ^ gram[part[own]])
            by = np.argsort(rank, kind="stable")
            again = np.zeros(len(own), bool)
            again[by[1:]] = rank[by[1:]] == rank[by[:-1]]
            hit = part[own[again]]
            rows.append(order[hit])
            starts.append(np.full(len(hit), o, np.int64))
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def keep(x: np.ndarray, stay: list[tuple[int, int]]) -> bytes:
    return b"".join(x[a:b].tobytes() for a, b in stay)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Null text counts as empty. Texts of fewer than 100 bytes lose nothing. A null id comes after all others.
    Rows repeated with one id and text are one document and get the same result. An empty table gives an
    empty result. Other columns are ignored.
    """
    text = F.col("t").cast("binary")
    meta = with_first(keyed(docs).select("id", "u", F.octet_length("t").cast("long").alias("n"), F.sha2(text, 256).alias("sha")))
    covered = repeated(docs, units, grams, resolve, meta, SPAN, GRAM)
    out = finish(docs, meta, covered, units, keep, SPAN)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))

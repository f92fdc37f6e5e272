"""Operator 13, quality: a generalised additive model with pairwise interactions, scored by lookup tables.

A text becomes about thirty figures: sizes, shares of kinds of characters, repetition of words, lines and
word triples, and the worst and the mean stretch of ``STRETCH`` words by several of them, so that junk inside
a clean text shows. Each figure is cut into at most ``BINS`` bins at quantiles.

Training goes round the figures in turn. A step fits a tree of ``LEAVES`` leaves on ONE figure to the
gradient of the log-loss, and adds the tree, shrunk, to that figure's table, which has one value for each
bin. Afterwards the pairs of figures whose joint bins explain most of what is left are boosted the same way,
by trees with one cut along each axis, into tables of two dimensions. Rounds end when a fifth of the sample,
set aside, does not improve. A score is the sigmoid of a constant plus one looked-up value for each table.

Fitting uses a bounded, documented sample of labelled rows (``LABELLED``, the smallest hashes of their ids)
outside the held-out fold: 12,000 rows of figures on the driver. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table

#: Labelled rows used for fitting, words of a stretch, bins of a figure and of an axis of a pair, pairs.
LABELLED, STRETCH, BINS, PAIR_BINS, PAIRS = 12_000, 40, 64, 12, 10
ROUNDS, PATIENCE, RATE, LEAVES, RIDGE, LEAST = 400, 25, 0.08, 3, 1.0, 15.0
CUT = 0.3
FOLD = 5

STRETCHED = ("upper", "symbol", "repeat", "edge", "bar", "same")
FIGURES = (
    "log_chars", "log_words", "word_length", "upper", "lower", "digit", "symbol", "space", "other", "edge", "bar", "bang",
    "repeat", "kinds", "commonest", "short", "long", "bare", "log_lines", "line_kinds", "line_length", "triples", "longest_word", "run",
    *(f"{kind}_{x}" for x in STRETCHED for kind in ("worst", "mean")),
)
# Kinds of characters: 0 other letters and the rest beyond ASCII, 1 upper, 2 lower, 3 digit, 4 space, 5 plain stop, 6 symbol.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 6
for _chars, _k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 3), (" \t\n\x0b\x0c\r", 4), (".,;:'\"()-?", 5)):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[0xC0:0xDF] = 1  # accented capitals of Latin-1
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def figures(text: str) -> np.ndarray:
    """The figures of a text, in the order of ``FIGURES``; zeroes for a text without words."""
    out = dict.fromkeys(FIGURES, 0.0)
    words = [w for w in _SPACES.split(text) if w]
    if not words:
        out["log_chars"] = np.log1p(len(text))
        return np.array([out[k] for k in FIGURES])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[np.where(points < 256, points, 128).astype(np.uint8)]
    share = np.bincount(kind, minlength=7) / len(kind)
    n = len(words)
    counts = Counter(words)
    ids = {w: i for i, w in enumerate(counts)}
    code = np.fromiter((ids[w] for w in words), np.int64, n)
    length = np.fromiter(map(len, words), np.int64, n)
    firm = kind != 4
    start = np.flatnonzero(firm & ~np.concatenate([[False], firm[:-1]]))
    end = start + length
    part = {k: np.concatenate([[0], np.cumsum(np.isin(kind, v))]) for k, v in (("upper", [1]), ("symbol", [6]), ("letter", [0, 1, 2]))}
    inside = {k: v[end] - v[start] for k, v in part.items()}
    edge = (kind[end - 1] == 6).astype(float)
    bar = (inside["letter"] == 0).astype(float)
    again = np.concatenate([[0.0], (code[1:] == code[:-1]).astype(float)])
    lines = [x for x in text.split("\n") if x.strip()]
    triple = (code[:-2] * len(ids) + code[1:-1]) * len(ids) + code[2:] if len(ids) < 2_000_000 else np.empty(0, np.int64)
    change = np.concatenate([[0], np.flatnonzero(np.diff(points)) + 1, [len(points)]])
    out |= {
        "log_chars": np.log1p(len(text)), "log_words": np.log1p(n), "word_length": length.mean(), "upper": share[1], "lower": share[2],
        "digit": share[3], "symbol": share[6], "space": share[4], "other": share[0], "edge": edge.mean(), "bar": bar.mean(),
        "bang": (points == 33).mean(), "repeat": again.mean(), "kinds": len(counts) / n, "commonest": max(counts.values()) / n,
        "short": (length <= 3).mean(), "long": (length >= 12).mean(), "bare": (inside["letter"] == length).mean(),
        "log_lines": np.log1p(len(lines)), "line_kinds": len(set(lines)) / max(1, len(lines)), "line_length": np.log1p(n / max(1, len(lines))),
        "triples": len(np.unique(triple)) / len(triple) if len(triple) else 1.0, "longest_word": np.log1p(length.max()), "run": np.log1p(np.diff(change).max()),
    }
    at = np.arange(0, n, STRETCH)
    size = np.diff(np.append(at, n))
    firm_size = np.add.reduceat(length, at)
    same = np.array([np.bincount(np.unique(code[i : i + STRETCH], return_inverse=True)[1]).max() for i in at]) / size
    mean = lambda x, by: np.add.reduceat(x, at) / by
    stretch = {
        "upper": mean(inside["upper"], firm_size), "symbol": mean(inside["symbol"], firm_size), "repeat": mean(again, size),
        "edge": mean(edge, size), "bar": mean(bar, size), "same": same,
    }
    long_enough = size >= min(n, STRETCH // 2)
    for k, v in stretch.items():
        out[f"worst_{k}"], out[f"mean_{k}"] = v[long_enough].max(), v.mean()
    return np.array([out[k] for k in FIGURES])


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins, at quantiles of distinct values."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(values) else np.empty(0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree of at most ``leaves`` leaves, from sums of gradients and second derivatives by bin."""
    spans, worth = [(0, len(g))], lambda a, b: a * a / (b + RIDGE)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for lo, hi in spans:
            if hi - lo > 1:
                left, right = cg[lo + 1 : hi] - cg[lo], cg[hi] - cg[lo + 1 : hi]
                lh, rh = ch[lo + 1 : hi] - ch[lo], ch[hi] - ch[lo + 1 : hi]
                gain = worth(left, lh) + worth(right, rh) - worth(cg[hi] - cg[lo], ch[hi] - ch[lo])
                gain[(lh < LEAST / 4) | (rh < LEAST / 4)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (lo, hi), lo + 1 + k)
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in spans:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + RIDGE)
    return out


def cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut along each axis: its gain and its values by pair of bins."""
    corner = lambda x: np.cumsum(np.cumsum(x, 0), 1)
    cg, ch = corner(g), corner(h)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    quarter = lambda c: (
        c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]
    )
    parts = list(zip(quarter(cg), quarter(ch), strict=True))
    gain = sum(a * a / (b + RIDGE) for a, b in parts)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


class Additive:
    """Constant, and for each figure or pair of figures its cuts and its table."""

    def __init__(self, constant: float, cuts: list[np.ndarray] = (), singles: list[np.ndarray] = (), pair_cuts: list[np.ndarray] = (), pairs: dict | None = None):
        self.constant, self.cuts, self.singles, self.pair_cuts, self.pairs = constant, list(cuts), list(singles), list(pair_cuts), dict(pairs or {})

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.constant)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.singles, strict=True)):
            out += values[np.searchsorted(cuts, x[:, f])]
        bins = {f: np.searchsorted(self.pair_cuts[f], x[:, f]) for pair in self.pairs for f in pair}
        for (f, k), values in self.pairs.items():
            out += values[bins[f], bins[k]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Additive:
    """Cyclic boosting of tables for figures, then for pairs. Rows are in a random but fixed order."""
    if not len(y):
        return Additive(0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    constant = float(np.log(rate / (1 - rate)))
    if len(y) < 10 or y.min() == y.max():
        return Additive(constant)
    own = np.arange(len(y)) % 5 > 0  # the rest says when to stop
    cuts, pair_cuts = [edges(x[:, f], BINS) for f in range(x.shape[1])], [edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    singles = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), constant)
    p = lambda: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y[~own] > 0, -z[~own], z[~own]))))

    def boost(tables: list[np.ndarray], where: list, step) -> list[np.ndarray]:
        """Goes round the tables; returns them as they were in the best round."""
        nonlocal z
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(rounds):
            for t, at in zip(tables, where, strict=True):
                q = p()
                g = np.bincount(at[own], weights=(y - q)[own], minlength=t.size).reshape(t.shape)
                h = np.bincount(at[own], weights=(q * (1 - q))[own], minlength=t.size).reshape(t.shape)
                more = RATE * step(g, h)
                t += more
                z = z + more.ravel()[at]
            now = loss()
            best, kept, since = (now, [t.copy() for t in tables], 0) if now < best - 1e-5 else (best, kept, since + 1)
            if since >= PATIENCE:
                break
        z = z + sum((k - t).ravel()[at] for k, t, at in zip(kept, tables, where, strict=True))
        return kept

    singles = boost(singles, bins, lambda g, h: tree(g, h, LEAVES))
    small = [np.searchsorted(c, x[:, f]) for f, c in enumerate(pair_cuts)]
    g, h, found = (y - p())[own], (p() * (1 - p()))[own], []
    for f in range(x.shape[1]):
        for k in range(f + 1, x.shape[1]):
            shape = (len(pair_cuts[f]) + 1, len(pair_cuts[k]) + 1)
            at = small[f] * shape[1] + small[k]
            sums = [np.bincount(at[own], weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h)]
            found.append((cross(*sums)[0], (f, k), at, shape))
    found = sorted(found, key=lambda r: (-r[0], r[1]))[:PAIRS]
    tables = boost([np.zeros(r[3]) for r in found], [r[2] for r in found], lambda g, h: cross(g, h)[1])
    return Additive(constant, cuts, singles, pair_cuts, dict(zip([r[1] for r in found], tables, strict=True)))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """``more`` columns and ``x``, the figures of column t."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="t").assign(x=[figures(t) for t in pdf["t"]])

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in more)
    return docs.select(*more, "t").mapInPandas(run, f"{schema}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame) -> Additive:
    """The model, from labelled rows outside the held-out fold; a constant one where a kind of label is missing."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), FOLD) != 0))
    picked = labelled.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(LABELLED)  # a bounded sample: 16 bytes a row
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = measured(texts.join(F.broadcast(picked), "id"), "id", "y").groupBy("id", "y").agg(F.min("x").alias("x"))  # an id may be repeated
    got = rows.orderBy(F.xxhash64("id"), "id").collect()  # at most LABELLED rows
    return train(np.array([r.x for r in got]).reshape(len(got), len(FIGURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null text counts as empty and is scored by its figures, all of them zero. A null id is carried through,
    is not held out and never fitted; repeated rows each give a row; other columns are ignored. Without both
    kinds of labels the score is the (smoothed) share of label 1, 0.5 without any. An empty table gives an
    empty result. Calling this fits the model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # at most len(FIGURES) * BINS + PAIRS * PAIR_BINS ** 2 values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([figures(t) for t in pdf["t"]]).reshape(len(pdf), len(FIGURES))
            yield pd.DataFrame({"doc_id": pdf["id"].astype("Int64"), "held_out": pdf["held"], "score": sent.value.score(x)})

    held = F.coalesce(crc_mod(F.col("doc_id"), FOLD) == 0, F.lit(False)).alias("held")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), held, F.coalesce("text", F.lit("")).alias("t"))
    out = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

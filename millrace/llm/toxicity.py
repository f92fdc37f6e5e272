"""Operator 8, toxicity: a linear-chain conditional random field tags toxic tokens.

Training reads a bounded, documented sample of labelled rows (``LABELLED``; the smallest hashes of their
ids) that are not in the held-out fold. Labels are given to documents, so token labels come from them:

1. on one half of the sample, a feature of a token (its word, or its first 3 to 7 letters) is a cue if
   documents marked toxic hold it far more often than others (likelihood ratio ``LEAST_G2``);
2. a token with a cue is labelled toxic in toxic documents, every other token is not; windows around cues
   train the field's weights and transitions by gradient ascent on the conditional likelihood;
3. on the other half, marginals from forward-backward are aggregated to three figures for each document,
   and a logistic function of them is fitted to the documents' labels.

Scoring is one pass over the documents without a shuffle. Between cues the emissions are constant, so a
stretch of n neutral tokens is the n-th power of a 2 x 2 matrix; the marginals at the cues are exact.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, table

#: Labelled rows that are used for fitting, cues that are kept, training windows and their reach in tokens.
LABELLED, CUES, WINDOWS, REACH = 12_000, 6_000, 60_000, 6
LEAST_G2, LEAST_DOCS, ROUNDS = 20.0, 4, 200
CUT = 0.7
_TOKEN = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(token: str) -> list[str]:
    word = _EDGE.sub("", token).lower()
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in range(3, 8) if len(word) > n)] if len(word) > 2 else []


class Known(dict):
    """token -> numbers of its cues."""

    def __init__(self, cues: dict[str, int], limit: int = 300_000):
        super().__init__()
        self.cues, self.limit = cues, limit

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = tuple(self.cues[f] for f in features(token) if f in self.cues)
        self[token] = found
        return found


def train(windows: list[tuple[list[tuple[int, ...]], list[int]]], n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the cues (for the toxic state, a bias last) and the 2 x 2 transition scores.

    windows: for each token its cues and its label; all windows have the same length.
    """
    if not windows:
        return np.zeros(n + 1), np.zeros((2, 2))
    y = np.array([labels for _, labels in windows])
    s, t = y.shape
    at = np.array([(i * t + j, c) for i, (tokens, _) in enumerate(windows) for j, cues in enumerate(tokens) for c in cues])
    weight, trans = np.zeros(n + 1), np.zeros((2, 2))
    seen = np.bincount(at[:, 1], weights=y.ravel()[at[:, 0]], minlength=n)
    seen = np.append(seen, y.sum())
    pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    first = [np.zeros(n + 1), np.zeros((2, 2))]
    second = [np.zeros(n + 1), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        score = (np.bincount(at[:, 0], weights=weight[at[:, 1]], minlength=s * t) + weight[n]).reshape(s, t)
        emit, move = np.ones((s, t, 2)), np.exp(trans)
        emit[:, :, 1] = np.exp(np.clip(score, -30, 30))
        ahead, back, scale = np.empty((s, t, 2)), np.ones((s, t, 2)), np.empty((s, t, 1))
        for j in range(t):
            a = emit[:, j] if j == 0 else (ahead[:, j - 1] @ move) * emit[:, j]
            scale[:, j] = a.sum(1, keepdims=True)
            ahead[:, j] = a / scale[:, j]
        for j in range(t - 2, -1, -1):
            back[:, j] = ((emit[:, j + 1] * back[:, j + 1]) @ move.T) / scale[:, j + 1]
        mark = (ahead * back)[:, :, 1]
        both = np.einsum("sja,sjb->ab", ahead[:, :-1], emit[:, 1:] * back[:, 1:] / scale[:, 1:]) * move
        expect = np.append(np.bincount(at[:, 1], weights=mark.ravel()[at[:, 0]], minlength=n), mark.sum())
        for k, (value, slope) in enumerate(((weight, (seen - expect - 0.5 * weight) / s), (trans, (pairs - both - 0.5 * trans) / s))):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            value += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return weight, trans


class Field:
    """The trained field: cues, weights, transitions and the coefficients of the document score."""

    def __init__(self, cues: dict[str, int], weight: np.ndarray, trans: np.ndarray, coefficients=None):
        self.cues, self.weight, self.coefficients = cues, weight, coefficients
        self.move = np.exp(trans)
        neutral = self.move * np.array([1.0, math.exp(float(weight[-1]))])[None, :]
        values, vectors = np.linalg.eig(neutral)
        self._values, self._vectors, self._back = values.real, vectors.real, np.linalg.inv(vectors.real)
        self._powers: dict[int, np.ndarray] = {}

    def _stretch(self, n: int) -> np.ndarray:
        """n neutral tokens, scaled by the largest eigenvalue (constants cancel in marginals)."""
        if n not in self._powers:
            if len(self._powers) > 50_000:
                self._powers.clear()
            ratio = (self._values / np.abs(self._values).max()) ** n
            self._powers[n] = np.maximum((self._vectors * ratio) @ self._back, 0)
        return self._powers[n]

    def marginals(self, places: list[int], cues: list[tuple[int, ...]], tokens: int) -> list[float]:
        """Probability of the toxic state at the tokens that hold cues."""
        emit = [np.array([1.0, math.exp(min(30.0, float(self.weight[-1] + sum(self.weight[c] for c in x))))]) for x in cues]
        ahead, row, last = [], None, -1
        for p, e in zip(places, emit, strict=True):
            if row is None:
                start = np.array([1.0, math.exp(float(self.weight[-1]))])
                row = e if p == 0 else (start @ self._stretch(p - 1) @ self.move) * e
            else:
                row = (row @ self._stretch(p - last - 1) @ self.move) * e
            row = row / row.sum()
            ahead.append(row)
            last = p
        out = [0.0] * len(places)
        col = self._stretch(tokens - 1 - places[-1]) @ np.ones(2)
        for k in range(len(places) - 1, -1, -1):
            both = ahead[k] * col
            out[k] = float(both[1] / both.sum())
            if k:
                col = self._stretch(places[k] - places[k - 1] - 1) @ (self.move @ (emit[k] * col))
                col = col / col.sum()
        return out

    def tag(self, text: str, known: Known) -> tuple[list[tuple[int, int, float]], tuple[float, float, float]]:
        """Cue tokens (start, end, probability) and the document's figures."""
        tokens = text.split()
        found = [(i, c) for i, w in enumerate(tokens) if (c := known[w])]
        if not found:
            return [], (0.0, 0.0, 0.0)
        marks = self.marginals([i for i, _ in found], [c for _, c in found], len(tokens))
        wanted = dict(zip((i for i, _ in found), marks, strict=True))
        spans = []
        for i, m in enumerate(_TOKEN.finditer(text)):
            if i in wanted:
                spans.append((m.start(), m.end(), wanted[i]))
        total = sum(marks)
        return spans, (math.log1p(total), max(marks), 10 * total / (total + 0.01 * len(tokens) + 1))

    def score(self, figures) -> float:
        if self.coefficients is None:
            return 0.0
        z = float(self.coefficients[0] + np.dot(self.coefficients[1:], figures))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field, from labelled rows outside the held-out fold; None without both kinds of labels."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    picked = labelled.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)  # a bounded sample: 16 bytes a row
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("t"))
    one = texts.join(F.broadcast(picked), "_id").groupBy("_id", "y").agg(F.min("t").alias("t"))  # an id may be repeated
    sample = stored(one.withColumn("half", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2))))
    counts = {(r.half, r.y): r.n for r in sample.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    if min(counts.get((h, y), 0) for h in (0, 1) for y in (0, 1)) == 0:
        return None
    toxic, total = counts[0, 1], counts[0, 0] + counts[0, 1]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, y in zip(pdf["t"], pdf["y"], strict=True):
                rows += [(f, y) for f in {f for w in set(text.split()) for f in features(w)}]
                if len(rows) > 50_000:  # bounded memory, however long the texts of a batch are
                    yield pd.DataFrame(rows, columns=["f", "y"])
                    rows = []
            yield pd.DataFrame(rows, columns=["f", "y"])

    half = sample.where("half = 0")
    n = half.mapInPandas(each, "f string, y int").groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(f"n >= {LEAST_DOCS}")
    part = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)
    n = n.withColumn("g", 2 * (part(F.col("a"), toxic / total) + part(F.col("n") - F.col("a"), 1 - toxic / total)))
    best = n.where((F.col("g") >= LEAST_G2) & (F.col("a") > F.col("n") * max(0.5, toxic / total))).orderBy(F.desc("g"), "f").limit(CUES)
    cues = {r.f: i for i, r in enumerate(best.select("f").collect())}
    if not cues:
        return None

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(cues)
        for pdf in batches:
            rows = []
            for id, text, y in zip(pdf["_id"], pdf["t"], pdf["y"], strict=True):
                tokens, past = [known[w] for w in text.split()], -1
                for i, c in enumerate(tokens):
                    if c and i > past:
                        own = [tokens[j] if 0 <= j < len(tokens) else () for j in range(i - REACH, i + REACH + 1)]
                        rows.append((id, i, [list(x) for x in own], [int(bool(x) and y == 1) for x in own]))
                        past = i + REACH
                if len(rows) > 10_000:
                    yield pd.DataFrame(rows, columns=["id", "at", "cues", "y"])
                    rows = []
            yield pd.DataFrame(rows, columns=["id", "at", "cues", "y"])

    windows = half.mapInPandas(around, "id long, at int, cues array<array<int>>, y array<int>")
    got = windows.orderBy(F.xxhash64("id", "at"), "id", "at").limit(WINDOWS).collect()  # the same ones in every run
    weight, trans = train([([tuple(x) for x in r.cues], list(r.y)) for r in got], len(cues))
    field = Field(cues, weight, trans)

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(cues)
        for pdf in batches:
            rows = [(*field.tag(text, known)[1], y) for text, y in zip(pdf["t"], pdf["y"], strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", "c", "y"])

    got = np.array(sample.where("half = 1").mapInPandas(figures, "a double, b double, c double, y double").collect())
    field.coefficients = logistic(got[:, :3], got[:, 3])
    return field


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, ``spans`` array<struct<start, end, probability>> of tokens more likely toxic than not.

    Null text counts as empty; empty texts get the score of a document without cues; without a field the
    score is 0. A null id is carried through; repeated rows each give a row; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # at most CUES cues

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        known = Known(model.cues if model else {})
        for pdf in batches:
            scores, spans = [], []
            for text in pdf["t"]:
                found, figures = model.tag(text, known) if model else ([], None)
                scores.append(model.score(figures) if model else 0.0)
                spans.append([{"start": a, "end": b, "probability": p} for a, b, p in found if p >= 0.5])
            yield pd.DataFrame({"doc_id": pdf["id"], "score": scores, "spans": spans})

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    return rows.mapInPandas(run, "doc_id long, score double, spans array<struct<start long, end long, probability double>>")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_spans."""
    out = tag(docs, fit(docs, labels))
    return out.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_toxic_spans"),
    )


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns (for pipelines): one pass, no shuffle."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.schema
    if "text" not in docs.columns:
        return docs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        model = sent.value
        known = Known(model.cues if model else {})
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            stay = [not model or model.score(model.tag(t or "", known)[1]) < CUT for t in texts]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

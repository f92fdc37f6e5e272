"""Operator 2, a hidden Markov language model; counts and Baum-Welch statistics cover every training text.

Pass 1 finds the frequent words: each task reports the words that make up 1/FREQUENT of a stretch of its
tokens, and a word with 1/FREQUENT of all tokens is reported by some stretch, so at most FREQUENT words stay.
Pass 2 counts: the frequent words per task, the rest as (word, document) rows, dealt by word; no key of the
rest holds more than 1/FREQUENT of the tokens. Pass 3 writes every document as a row of symbols: the
``LEXICON`` most frequent words, one of eight shapes for other words, or the end.

A state emits symbols; a shape emits its words by their share in the shape, whatever the state. So
log P(text) = forward recursion over symbols + sum over shape words of log p(word | shape), exactly.
Training starts from the counts of all training texts, spread over the states with a fixed noise, and makes
``ROUNDS`` Baum-Welch rounds, each over all training texts, whole; the expected counts of the partitions are
summed by Spark. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import crc_mod, stored, table
from .words import Words, portions

#: Bounds of what is broadcast: frequent words (16 bytes each) and symbols (STATES numbers each).
FREQUENT, LEXICON, SHAPES, STATES = 200_000, 8_000, 8, 8
STRETCH, ROUNDS = 4_000_000, 5
#: Symbols in a segment of a text longer than LONG (segments are joined exactly), and in what is worked on at once.
SEGMENT, LONG, CELLS = 1024, 8192, 400_000
#: Numbers in a piece of a sum, groups of the first level of a sum over partitions, steps of a fixed-point logarithm
#: (sums of whole numbers are the same in any order).
PIECE, FAN, FIXED = 8192, 1000, 10_000_000_000
END = SHAPES  # symbols: shapes, end, then the lexicon
_PUNCT = np.zeros(256, np.int64)
_PUNCT[list(b".,;:!?)\"'")] = 1


def shapes(w: Words, which: np.ndarray) -> np.ndarray:
    """Shape of the chosen words: not ASCII, ends in a punctuation sign, longer than eight bytes."""
    high = np.concatenate([[0], np.cumsum(w.data >= 128)])
    start, end = w.start[which], w.end[which]
    return (high[end] > high[start]) + 2 * _PUNCT[w.data[end - 1]] + 4 * (end - start > 8)


def uid(doc_id, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=0 if doc_id is None else int(doc_id) & (2**64 - 1)) - (1 << 63)


def _find(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted array, -1 where it is not in it."""
    if not len(sorted_):
        return np.full(len(h), -1)
    at = np.searchsorted(sorted_, h)
    at[at == len(sorted_)] = 0
    return np.where(sorted_[at] == h, at, -1)


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (1, S), (S, S), (M, S)

    @staticmethod
    def first(counts: np.ndarray, states: int = STATES) -> Model:
        rng = np.random.default_rng(7)
        emit = (counts[:, None] + 0.1) * rng.uniform(0.5, 1.5, (len(counts), states))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full((1, states), 1 / states), move, emit / emit.sum(0))

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray) -> Model:
        share = (counts + 0.1) / (counts + 0.1).sum()
        emit = emit + 2.0 * share[:, None]
        return Model((start + 1) / (start + 1).sum(1, keepdims=True), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch: expected starts, moves and emissions, by the forward-backward recursion over each whole text."""
        sums = np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit)
        chains = [c for d in docs for c in ([(d, None, None)] if len(d) <= LONG else self.segments(d))]
        chains.sort(key=lambda c: -len(c[0]))
        some, size = [], 0
        for c in chains:
            if some and size + len(c[0]) > CELLS:
                self.add(some, *sums)
                some, size = [], 0
            some.append(c)
            size += len(c[0])
        if some:
            self.add(some, *sums)
        start, move, emit = sums
        return start, move * self.move, emit

    def segments(self, d: np.ndarray) -> list[tuple]:
        """Segments of a long text, each with the forward message before it and the backward message after it.

        What a segment does to a message is a product of matrices; those of all segments are worked out side by
        side and chained, so that nothing is lost where the text is cut.
        """
        states, cuts = len(self.move), range(0, len(d), SEGMENT)
        does = np.repeat(self.move[None], len(cuts), 0)
        does[0] = np.eye(states)  # the start comes before the first symbol, not a move
        for t in range(min(SEGMENT, len(d))):
            e = self.emit[d[t::SEGMENT]]
            x = does[: len(e)]
            x = ((x.reshape(-1, states) @ self.move).reshape(x.shape) if t else x) * e[:, None, :]
            does[: len(e)] = x / x.sum((1, 2), keepdims=True)
        before, after = [None], [np.ones(states)]
        for k in range(len(cuts) - 1):
            a, z = (before[-1] if k else self.start[0]) @ does[k], does[-1 - k] @ after[-1]
            before.append(a / a.sum())
            after.append(z / z.sum())
        return [(d[i : i + SEGMENT], a, z) for i, a, z in zip(cuts, before, reversed(after), strict=True)]

    def add(self, chains: list[tuple], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Adds what is expected of chains, longest first; their symbols lie by place, then by chain."""
        length, states = np.array([len(c[0]) for c in chains]), len(self.move)
        live = np.searchsorted(-length, -np.arange(length[0]), "left")  # chains longer than t
        begin = np.concatenate([[0], np.cumsum(live)])
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        obs = np.empty(len(place), np.int64)
        obs[begin[place] + np.repeat(np.arange(len(chains)), length)] = np.concatenate([c[0] for c in chains])
        late = np.array([c[1] is not None for c in chains])
        before = np.array([c[1] for c in chains if c[1] is not None]).reshape(-1, states)
        first, last = np.repeat(self.start[:1], len(chains), 0), np.ones((len(chains), states))
        first[late] = before @ self.move
        for k, c in enumerate(chains):
            if c[2] is not None:
                last[k] = c[2]
        e = self.emit[obs]
        a, scale, ones = np.empty_like(e), np.empty((len(e), 1)), np.ones((states, 1))
        for t in range(len(live)):
            i, j = begin[t], begin[t + 1]
            x, s = a[i:j], scale[i:j]
            np.multiply(a[begin[t - 1] : begin[t - 1] + live[t]] @ self.move if t else first, e[i:j], out=x)
            np.matmul(x, ones, out=s)
            x /= s
        e /= scale
        z, back = last[:0], self.move.T.copy()
        for t in range(len(live) - 1, -1, -1):
            i, j = begin[t], begin[t + 1]
            x, own = a[i:j], e[i:j]
            if len(z) < live[t]:  # chains that end here
                ends = last[len(z) : live[t]]
                z = np.concatenate([z, ends / (x[len(z) :] * ends).sum(1, keepdims=True)])
            own *= z
            if t:
                move += a[begin[t - 1] : begin[t - 1] + live[t]].T @ own
            x *= z
            z = own @ back
        move += before.T @ e[: live[0]][late]
        start[0] += a[: live[0]][~late].sum(0)
        for s in range(states):
            emit[:, s] += np.bincount(obs, a[:, s], len(emit))

    def log10(self, docs: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each row of symbols: the scaled forward recursion over all of it."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lengths = np.array([len(docs[i]) for i in order])
        out = np.zeros(len(docs))
        if not len(docs):
            return out
        flat, starts = np.concatenate([docs[i] for i in order]), np.cumsum(lengths) - lengths
        # States are rows and texts are columns, and sums over states go in a fixed order: linear-algebra routines
        # take other paths for other numbers of texts, and a text's score must not depend on its companions.
        states, emit = len(self.move), np.ascontiguousarray(self.emit.T)
        a = np.repeat(self.start[0][:, None], len(docs), 1)
        for t in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, "left"))  # documents longer than t
            a = a[:, :n]
            if t:
                x = self.move[0][:, None] * a[0]
                for k in range(1, states):
                    x += self.move[k][:, None] * a[k]
                a = x
            a = a * emit[:, flat[starts[:n] + t]]
            s = a[0].copy()
            for k in range(1, states):
                s += a[k]
            out[:n] += np.log10(s)
            a /= s
        back = np.empty(len(docs))
        back[order] = out
        return back


def _ids(pdf: pd.DataFrame) -> list:
    return [None if pd.isna(i) else int(i) for i in pdf["id"]]


def _rows(docs: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("id"), held.alias("held"), F.coalesce("text", F.lit("")).alias("t"))


def frequent_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and shapes of at most FREQUENT words, among them every word with 1/FREQUENT of the training words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in portions(pdf["t"], STRETCH):
                w = Words(part)
                h, first, c = np.unique(w.hash.view(np.int64), return_index=True, return_counts=True)
                own = c * FREQUENT >= len(w.hash)
                yield pd.DataFrame({"h": h[own], "c": c[own], "k": shapes(w, first[own])})

    found = rows.where("NOT held").select("t").mapInPandas(run, "h long, c long, k int")
    found = found.groupBy("h").agg(F.sum("c").alias("c"), F.min("k").alias("k"))
    best = found.orderBy(F.desc("c"), "h").limit(FREQUENT).select("h", "k").toPandas()
    h, k = best["h"].to_numpy(np.int64), best["k"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], k[order]


def word_counts(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Counts of the frequent words (``h``, ``c``) and, for each document (``uid``), what its other words sum to."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = sent.value
        known = np.zeros(len(hashes), np.int64)
        for pdf in batches:
            us = np.array([uid(i, t) for i, t in zip(_ids(pdf), pdf["t"], strict=True)], np.int64)
            training = ~pdf["held"].to_numpy(bool)
            for first, part in portions(pdf["t"]):
                w = Words(part)
                h = w.hash.view(np.int64)
                at, doc = _find(hashes, h), w.text + first
                known += np.bincount(at[(at >= 0) & training[doc]], minlength=len(hashes))
                rare = np.flatnonzero(at < 0)
                rare = rare[np.lexsort((h[rare], doc[rare]))]
                if len(rare):
                    new = np.append(True, (h[rare[1:]] != h[rare[:-1]]) | (doc[rare[1:]] != doc[rare[:-1]]))
                    head, lead = np.flatnonzero(new), rare[new]
                    tf = np.diff(np.append(head, len(rare)))
                    yield pd.DataFrame({"h": h[lead], "uid": us[doc[lead]], "tf": tf, "k": shapes(w, lead), "train": training[doc[lead]], "common": False})
        own = np.flatnonzero(known)
        yield pd.DataFrame({"h": hashes[own], "uid": np.zeros(len(own), np.int64), "tf": known[own], "k": 0, "train": True, "common": True})

    seen = rows.mapInPandas(run, "h long, uid long, tf int, k byte, train boolean, common boolean")
    word = Window.partitionBy("h")
    seen = seen.withColumn("c", F.sum(F.when(F.col("train"), F.col("tf")).otherwise(0)).over(word))
    seen = seen.withColumn("head", (F.row_number().over(word.orderBy("uid")) == 1) & (F.col("c") > 0) & ~F.col("common"))
    kinds = [F.count_if(F.col("head") & (F.col("k") == k)).alias(f"v{k}") for k in range(SHAPES)]
    shares = [F.sum(F.when(F.col("train") & ~F.col("common") & (F.col("k") == k), F.col("tf")).otherwise(0)).alias(f"c{k}") for k in range(SHAPES)]
    return stored(
        seen.groupBy("common", F.when(F.col("common"), F.col("h")).otherwise(F.col("uid")).alias("key")).agg(
            F.max("c").alias("c"), (F.sum(F.col("tf") * F.round(F.log10(F.col("c") + 0.1) * FIXED).cast("long")) / FIXED).alias("rest"),
            F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"), *kinds, *shares,
        )
    )


def encode(rows: DataFrame, frequent: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Each document as symbols, with the sums that come from frequent words."""
    sent = rows.sparkSession.sparkContext.broadcast((frequent, symbol, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, symbol, c = sent.value
        logs = np.log10(c + 0.1)
        shaped = np.where(symbol < SHAPES, logs, 0.0)
        for pdf in batches:
            ids, held = _ids(pdf), pdf["held"].to_numpy(bool)
            for first, part in portions(pdf["t"]):
                w, out = Words(part), []
                at = _find(hashes, w.hash.view(np.int64))
                common = at >= 0
                codes = np.empty(len(at), np.uint16)
                codes[common] = symbol[at[common]]
                codes[~common] = shapes(w, np.flatnonzero(~common))
                add = lambda x: np.bincount(w.text[common], x[at[common]], len(part))  # noqa: B023, E731
                base, more, known = add(logs), add(shaped), add((c > 0).astype(float))
                for j, text in enumerate(part):
                    own = np.append(codes[w.stop[j - 1] if j else 0 : w.stop[j]], np.uint16(END))
                    i = ids[first + j]
                    out.append((i, bool(held[first + j]), uid(i, text), own.tobytes(), base[j], more[j], int(known[j])))
                frame = pd.DataFrame(out, columns=["id", "held", "uid", "symbols", "base", "shaped", "known"])
                yield frame.assign(id=pd.array([x[0] for x in out], "Int64"))

    return stored(rows.mapInPandas(run, "id long, held boolean, uid long, symbols binary, base double, shaped double, known long"))


def merged(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """Sums by piece ``i`` of arrays ``v`` from partitions ``p``, in two levels: no group holds the arrays of all partitions."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")  # in the same order in every run
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "p": pdf["p"].iloc[:1] % fan, "v": [np.sum(np.stack(list(pdf["v"])), axis=0)]})

    schema = "i int, p int, v array<double>"
    return parts.groupBy("i", F.pmod("p", F.lit(fan))).applyInPandas(add, schema).groupBy("i").applyInPandas(add, schema)


def baum_welch(coded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``rounds`` rounds from the counts of all training texts, every round over every training text."""
    train = coded.where("NOT held").select("symbols")
    model = Model.first(counts)
    sizes = [model.start.size, model.move.size, model.emit.size]
    for _ in range(rounds):
        sent = coded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            sums = None
            for pdf in batches:
                own = sent.value.expected([np.frombuffer(x, np.uint16) for x in pdf["symbols"]])
                sums = own if sums is None else tuple(a + b for a, b in zip(sums, own, strict=True))
            if sums is not None:
                flat = np.concatenate([x.ravel() for x in sums])
                part = TaskContext.get().partitionId()
                for i in range(0, len(flat), PIECE):
                    yield pd.DataFrame({"i": [i // PIECE], "p": [part], "v": [flat[i : i + PIECE]]})

        parts = merged(train.mapInPandas(run, "i int, p int, v array<double>")).collect()
        if not parts:
            return model
        flat = np.concatenate([np.array(r.v) for r in sorted(parts, key=lambda r: r.i)])
        start, move, emit = np.split(flat, np.cumsum(sizes)[:2])
        model = Model.of(start.reshape(model.start.shape), move.reshape(model.move.shape), emit.reshape(model.emit.shape), counts)
    return model


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null text counts as empty, a text without words has the end only. A null id counts as a training
    text. Repeated rows are counted and scored each. An empty table gives an empty result. Other columns
    are ignored.
    """
    spark, rows = docs.sparkSession, _rows(docs)
    frequent, kinds = frequent_words(rows)
    words = word_counts(rows, frequent)
    got = words.where("common").select("key", "c").toPandas()  # at most FREQUENT rows
    table_ = dict(zip(got["key"], got["c"], strict=True))
    c = np.array([table_.get(int(h), 0) for h in frequent], np.float64)
    order = np.argsort(-c, kind="stable")
    symbol = kinds.copy()  # a frequent word outside the lexicon is emitted by its shape
    symbol[order[:LEXICON]] = np.arange(min(LEXICON, len(order))) + SHAPES + 1
    coded = encode(rows, frequent, symbol.astype(np.uint16), c)
    sums = words.where("NOT common").agg(*[F.coalesce(F.sum(f"{x}{k}"), F.lit(0)) for x in "vc" for k in range(SHAPES)]).first()
    v, rare = np.array(sums[:SHAPES], float), np.array(sums[SHAPES:], float)
    ends = coded.where("NOT held").count()
    n_train, n_kinds = int(c.sum() + rare.sum()) + ends, int((c > 0).sum() + v.sum()) + (ends > 0)
    late = order[LEXICON:]
    v += np.bincount(kinds[late], weights=c[late] > 0, minlength=SHAPES)
    rare += np.bincount(kinds[late], weights=c[late], minlength=SHAPES)
    size = rare + 0.1 * (v + 1)  # what a shape's word probabilities are divided by
    lexicon = c[order[:LEXICON]]
    model = baum_welch(coded, np.concatenate([rare, [ends], lexicon]), rounds)
    del table_, got
    log_base, log_size, log_end = np.log10(n_train + 0.1 * (n_kinds + 1)), np.log10(size), np.log10(ends + 0.1)
    sent = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            symbols = [np.frombuffer(x, np.uint16) for x in pdf["symbols"]]
            n = np.array([len(x) for x in symbols])
            kinds = np.array([np.bincount(x[x < SHAPES], minlength=SHAPES) for x in symbols]).reshape(len(n), SHAPES)
            yield pd.DataFrame({
                "id": pdf["id"].astype("Int64"), "held": pdf["held"], "uid": pdf["uid"], "n_tokens": n, "known": pdf["known"] + (ends > 0),
                "base": pdf["base"] + log_end - n * log_base,
                "model": sent.value.log10(symbols) + pdf["shaped"] - sum(kinds[:, k] * log_size[k] for k in range(SHAPES)),
            })

    schema = "id long, held boolean, uid long, n_tokens long, known long, base double, model double"
    scored = coded.mapInPandas(forward, schema)
    copies = coded.groupBy("uid").agg(F.count("*").alias("copies"))
    rest = words.where("NOT common").select(F.col("key").alias("uid"), "rest", F.col("known").alias("more")).join(copies, "uid")
    rest = rest.select("uid", (F.col("rest") / F.col("copies")).alias("rest"), F.expr("more div copies").alias("more"))
    out = scored.join(rest, "uid", "left").fillna({"rest": 0.0, "more": 0})
    return out.select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.col("rest")).alias("base_score"),
        (F.col("model") + F.col("rest")).alias("score"),
    )


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

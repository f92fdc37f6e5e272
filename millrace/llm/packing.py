"""Operator 1, packing into sequences of 2048 tokens by cutting-stock column generation.

1. One pass tokenises every text; a document is cut into full pieces of ``capacity`` tokens and one rest.
2. The histogram of rests (at most ``capacity / grid`` classes, whatever the input) goes to the driver.
   A linear program over patterns covers it; an unbounded-knapsack dynamic program prices new columns.
3. Patterns are used as often as their value rounded down. Documents get ranks within their class (a salted,
   two-level count, so a class may hold most rows) and a rank names pattern, copy and place.
4. What rounding leaves, and what only patterns with a gap would take, is laid end to end (two-level prefix
   sums) and cut at the sequence borders; the last, short sequence is cut into powers of two, which need no
   padding. Only these documents are tokenised again.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CAPACITY, END = 2048, 1
#: Lengths are rounded up to this grid for the linear program; it bounds the classes at CAPACITY / GRID.
GRID = 4
#: Column generation ends when the value is proved to be this close to the optimum of the linear program;
#: what it misses goes to the documents that are laid end to end, not to padding.
GAP = 0.002
#: A pattern is used only if it fills this share of a sequence; its documents are cut to fit otherwise.
FILLED = 0.998
#: Rows of one class that are summed up by one task when rests are laid end to end.
BLOCK = 20_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """text -> ids as ``tokenizers`` gives them with add_special_tokens=False.

    The same vocabulary as merge ranks lies beside the JSON and is several times faster to apply. It knows
    no special tokens, so texts that hold such a token's string go through ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranked = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranked):
        return lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(ranked, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def _ids(encode, text: str) -> np.ndarray:
    return np.append(encode(text), END).astype("<u4")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Full pieces and rests: doc_id, start, length, ids_crc32, doc_tokens, doc_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"].astype("Int64"), pdf["t"], strict=True):
                ids = _ids(encode, text)
                n, whole = len(ids), zlib.crc32(ids.tobytes())
                for s in range(0, n, capacity):
                    rows.append((i, s, min(capacity, n - s), zlib.crc32(ids[s : s + capacity].tobytes()), n, whole))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32"])

    return _texts(docs).mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))


def _rest_ids(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """The ids of the rest of each document: doc_id, doc_tokens, doc_crc32, rest (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"].astype("Int64"), pdf["t"], strict=True):
                ids = _ids(encode, text)
                rows.append((i, len(ids), zlib.crc32(ids.tobytes()), ids[len(ids) // capacity * capacity :].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "doc_crc32", "rest"])

    return _texts(docs).mapInPandas(run, "doc_id long, doc_tokens long, doc_crc32 long, rest binary")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes within ``capacity`` by dynamic programming: its value and its counts."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if k:
            worth = best[c - sizes[:k]] + values[:k]
            j = int(worth.argmax())
            if worth[j] > best[c] + 1e-12:
                best[c], pick[c] = worth[j], j
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest-first patterns, each used until a class runs out.

    A pattern holds no class that ran out before it, so the columns are triangular: a feasible basis.
    """
    m, left = len(sizes), demand.astype(float).copy()
    open_, basis, use = np.ones(m, bool), np.zeros((m, m)), np.zeros(m)
    for _ in range(m):
        room, column, first = capacity, np.zeros(m), int(np.flatnonzero(open_)[-1])
        while room:
            fit = np.flatnonzero(open_[: int(np.searchsorted(sizes, room, "right"))])
            if not len(fit):
                break
            k = int(fit[-1])
            count = min(room // int(sizes[k]), max(1, int(left[k] / max(left[first], 1e-9))))
            column[k] += count
            room -= count * int(sizes[k])
        held = np.flatnonzero(column)
        times = left[held] / column[held]
        out = int(held[np.argmin(times)])
        basis[:, out], use[out] = column, times.min()
        left = np.maximum(left - times.min() * column, 0)
        left[out], open_[out] = 0, False
    return basis, use


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps, each one outer product.

    Nothing here goes through threaded linear algebra: it may hang in a driver that has forked.
    """
    m = len(basis)
    a = np.hstack([basis.astype(float), np.eye(m)])
    for i in range(m):
        p = i + int(np.abs(a[i:, i]).argmax())
        a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        factor = a[:, i].copy()
        factor[i] = 0
        held = np.flatnonzero(factor)
        a[held] -= np.multiply.outer(factor[held], a[i])
    return a[:, m:].copy()


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns of counts by size) and how often each is used, by revised simplex.

    sizes: distinct, ascending; the basis has one column a size, so that many patterns come out at most.
    """
    m = len(sizes)
    basis, use = first_basis(sizes, demand, capacity)
    inverse = inverted(basis)
    least = float((sizes * demand).sum()) / capacity
    for step in range(1, 40 * m + 100):
        if step % 256 == 0:
            inverse = inverted(basis)
            use = _times(inverse, demand)
        prices = inverse.sum(axis=0)
        worth, column = knapsack(prices, sizes, capacity)
        if max(use.sum() / worth, least) * (1 + gap) >= use.sum():  # both bound the optimum from below
            break
        direction = _times(inverse, column)
        able = direction > 1e-9
        out = int(np.flatnonzero(able)[np.argmin(use[able] / direction[able])])
        ratio = use[out] / direction[out]
        use = np.maximum(use - ratio * direction, 0)
        use[out] = ratio
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.multiply.outer(direction, row)
        inverse[out] = row
    return basis.astype(int), use


def plan(lengths: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> tuple[list[tuple], dict[int, int], int]:
    """From the histogram class -> count: places (class, first rank, end rank, sequence, each, slot),
    ranks used by class, number of sequences."""
    kinds = sorted(lengths)
    if not kinds:
        return [], {}, 0
    patterns, use = column_generation(np.array(kinds), np.array([lengths[k] for k in kinds], float), capacity // grid)
    places, used, sequence = [], dict.fromkeys(kinds, 0), 0
    for p in range(len(kinds)):
        column = patterns[:, p]
        if int((column * np.array(kinds)).sum()) < capacity // grid * FILLED:
            continue
        times = int(use[p] + 1e-6)
        for i in np.flatnonzero(column):  # a covering pattern may hold more of a class than there is
            times = min(times, (lengths[kinds[i]] - used[kinds[i]]) // int(column[i]))
        if times <= 0:
            continue
        slot = 0
        for i in reversed(np.flatnonzero(column)):
            k, each = kinds[i], int(column[i])
            places.append((k, used[k], used[k] + times * each, sequence, each, slot))
            used[k] += times * each
            slot += each
        sequence += times
    return places, used, sequence


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end token. A null id is carried through. Rows repeated with one id are
    packed as often as they occur. An empty table gives an empty result. Other columns are ignored.
    """
    spark, path = docs.sparkSession, path or vocabulary()
    cut = stored(pieces(docs, path, capacity))
    kind = F.when(F.col("length") == capacity, 0).otherwise(F.ceil(F.col("length") / grid)).cast("int")
    cut = cut.withColumn("kind", kind)
    counts = {r.kind: r.n for r in cut.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # at most capacity / grid + 1 rows
    full = counts.pop(0, 0)
    places, used, sequences = plan(counts, capacity, grid)

    salts = max(1, (sum(counts.values()) + full) // 50_000)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = cut.groupBy("kind", "salt").agg(F.count("*").alias("n")).select(
        "kind", "salt", (F.sum("n").over(Window.partitionBy("kind").orderBy("salt")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(Window.partitionBy("kind", "salt").orderBy("doc_id", "start", "doc_crc32"))
    ranked = cut.join(before, ["kind", "salt"]).withColumn("rank", F.col("before") + own - 1)
    ranked = stored(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32", "kind", "rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    end = spark.createDataFrame([*((k, u) for k, u in used.items()), (-1, 0)], "kind int, used long")
    left = ranked.where("kind > 0").join(F.broadcast(end), "kind").where("rank >= used")
    parts = []
    if places:
        spots = spark.createDataFrame(places, "kind int, low long, high long, first long, each long, slot long")
        at = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
        put = ranked.where("kind > 0").join(F.broadcast(spots), "kind").where(at)
        put = put.withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div each"))
        put = put.withColumn("slot", F.col("slot") + (F.col("rank") - F.col("low")) % F.col("each"))
        past = Window.partitionBy("sequence_id").orderBy("slot")
        parts.append(put.withColumn("offset", F.sum("length").over(past) - F.col("length")).select(names))

    left = stored(left.drop("used").withColumn("block", F.expr(f"rank div {BLOCK}")))
    total = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if total:
        body = total // capacity * capacity
        ends = list(np.cumsum([body, *powers(total - body)]))
        blocks = left.groupBy("kind", "block").agg(F.sum("length").alias("n"))
        blocks = blocks.select("kind", "block", (F.sum("n").over(Window.orderBy("kind", "block")) - F.col("n")).alias("base"))
        low = F.sum("length").over(Window.partitionBy("kind", "block").orderBy("rank")) - F.col("length") + F.col("base")
        left = left.join(blocks, ["kind", "block"]).withColumn("low", low).withColumn("high", F.col("low") + F.col("length"))
        some = F.array(((F.floor(F.col("low") / capacity) + 1) * capacity).cast("long"), *[F.lit(int(e)).cast("long") for e in ends])
        inner = F.array_sort(F.array_distinct(F.filter(some, lambda x: (x > F.col("low")) & (x < F.col("high")))))
        left = left.withColumn("inner", inner)
        bits = F.arrays_zip(F.concat(F.array("low"), F.col("inner")).alias("a"), F.concat(F.col("inner"), F.array("high")).alias("b"))
        left = left.withColumn("bit", F.explode(bits)).withColumn("a", F.col("bit.a")).withColumn("b", F.col("bit.b"))
        tail = F.array(*[F.lit(int(e)).cast("long") for e in ends])
        late = F.filter(tail, lambda x: x <= F.col("a"))
        left = left.withColumn("piece", F.col("a") - F.col("low"))
        left = left.withColumn("sequence_id", F.when(F.col("a") < body, F.expr(f"a div {capacity}")).otherwise(F.lit(body // capacity) + F.size(late) - 1) + sequences)
        left = left.withColumn("offset", F.when(F.col("a") < body, F.col("a") % capacity).otherwise(F.col("a") - F.element_at(late, -1)))
        few = left.select(F.col("doc_id").alias("_id")).distinct()
        again = docs.join(few, docs["doc_id"].eqNullSafe(few["_id"]), "left_semi")
        ids = _rest_ids(again, path, capacity).dropDuplicates(["doc_id", "doc_tokens", "doc_crc32"])
        same = [left[c].eqNullSafe(ids[c]) for c in ("doc_id", "doc_tokens", "doc_crc32")]
        left = left.join(ids, same[0] & same[1] & same[2]).drop(*[ids[c] for c in ("doc_id", "doc_tokens", "doc_crc32")])
        part = F.col("rest").substr((F.col("piece") * 4 + 1).cast("int"), ((F.col("b") - F.col("a")) * 4).cast("int"))
        left = left.withColumn("ids_crc32", F.crc32(part)).withColumn("start", F.col("start") + F.col("piece")).withColumn("length", F.col("b") - F.col("a"))
        parts.append(left.select(names))
        sequences += body // capacity + len(ends) - 1
    if full:
        whole = ranked.where("kind = 0").withColumn("sequence_id", F.col("rank") + sequences).withColumn("offset", F.lit(0).cast("long"))
        parts.append(whole.select(names))
    out = parts[0] if parts else ranked.withColumn("sequence_id", F.col("rank")).withColumn("offset", F.lit(0).cast("long")).select(names)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(n).cast("long") for n in names])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

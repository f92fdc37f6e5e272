"""Repeated windows of a fixed length over whole texts, as Spark jobs: what operators 7 and 10 share.

A window of ``span`` units (bytes or words) is *owned* by one of its k-grams, the one with the smallest
hash, so equal windows are owned alike wherever they stand, and every window of the corpus has one owner.

1. Each document lists its owners (two in span - k + 2 positions or so); Spark deals them by gram and drops
   grams that stand once. Owners of exact copies of an earlier document are dropped too: such a document
   is covered whole.
2. The owners that are left fetch their context, the units that their windows cover, and are dealt and
   sorted by gram; ``resolve`` decides for a stretch of whole grams which owned windows repeat.
3. The covered intervals go back to their documents.

Grams that hold a share of the rows are found in a sample of documents, which only says how they are dealt.
They are never dealt or held by gram: their rows are salted, and each of their windows is compared by a
128-bit digest, of which Spark's partial aggregation finds the first place, wherever its rows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import portions

#: Bits of the filter of document keys that is sent to tasks: 1 MiB, whatever the input.
FILTER_BITS = 1 << 23
#: Positions within a piece take so many bits beside the gram's hash; longer texts go in pieces.
PLACE = np.uint64((1 << 24) - 1)
LAST = 2**63 - 1
#: Grams with at least HOT owners in a sample of about SAMPLE documents are hot; at most HOT_GRAMS, the most frequent.
SAMPLE, HOT, HOT_GRAMS, SALTS = 5_000, 20, 20_000, 64
#: A window with at least 1/SHARE of the rows is sent to the tasks that look it up (hence at most SHARE of them).
SHARE = 1_000


def owners(grams: np.ndarray, width: int, most: int = 1 << 23, cut: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of each owner, and the smallest and largest distance from a window's start to it.

    A window is ``width`` consecutive grams; the smallest hash owns it, of equal ones the rightmost. More than
    ``most`` grams go in pieces of ``cut`` windows; an owner of windows on both sides of a cut is one owner.
    """
    n = len(grams)
    if n < width:
        return (np.empty(0, np.int64),) * 3
    if n > most:
        parts = [tuple(x + (s if j == 0 else 0) for j, x in enumerate(owners(grams[s : s + cut + width - 1], width, most, cut))) for s in range(0, n - width + 1, cut)]
        at, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return at[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    best, covered = (grams & ~PLACE) | (PLACE - np.arange(n, dtype=np.uint64)), 1
    while covered < width:
        step = min(covered, width - covered)
        best = np.minimum(best[:-step], best[step:])
        covered += step
    owner = (PLACE - (best & PLACE)).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    return at, at - last, at - first


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", text).alias("u"), text.alias("t"))


def _some(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose key ``u`` is wanted, and few others: a filter of fixed size before a join."""
    place = F.pmod("u", F.lit(FILTER_BITS))
    bits = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # at most 257 rows of 4 KiB
    mask = np.zeros((FILTER_BITS // 32768 + 1) * 32768, np.bool_)
    for r in bits:
        own = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")
        mask[(r.b - 1) * 32768 : (r.b - 1) * 32768 + len(own)] = own
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mask = np.unpackbits(sent.value)
        for batch in batches:
            u = batch.column(1).to_numpy()
            yield batch.filter(pa.array(mask[np.mod(u, FILTER_BITS)] > 0))

    return rows.mapInArrow(run, rows.schema)


def repeated(
    docs: DataFrame, units: Callable, grams: Callable, resolve: Callable, meta: DataFrame, span: int, k: int, other: bool = False,
    many: Callable | None = None,
) -> DataFrame:
    """u and its covered intervals ``spans`` array<struct<s, e>> in units.

    units(text) gives an array, grams(units) its k-gram hashes. resolve(frame) gets whole groups of equal
    grams, sorted, and returns the repeated windows: number of the row, distance from the start to the owner.
    meta: u, first (whether no earlier document is the same). other: only other documents count. many(texts)
    gives the units of several texts at once.
    """
    many = many or (lambda texts: map(units, texts))
    width = span - k + 1

    rows = keyed(docs)
    spark = docs.sparkSession
    names = ("g", "u", "at", "low", "high")
    schema = "g long, u long, at int, low short, high short, hot boolean"
    hot = spark.sparkContext.broadcast(np.empty(0, np.int64))

    def list_owners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(out: list) -> pd.DataFrame:
            found = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))
            return found.assign(hot=np.isin(found["g"].to_numpy(), hot.value))

        for pdf in batches:
            out, n = [], 0
            for first, part in portions(pdf["t"]):
                for u, x in zip(pdf["u"].iloc[first : first + len(part)], many(part), strict=True):
                    g = grams(x)
                    at, low, high = owners(g, width)
                    if len(at):
                        out.append((g[at].view(np.int64), np.full(len(at), u, np.int64), at, low, high))
                        n += len(at)
                    if n > 200_000:
                        yield frame(out)
                        out, n = [], 0
            if out:
                yield frame(out)

    some = rows.where(F.pmod(F.xxhash64("u"), F.lit(max(1, docs.count() // SAMPLE))) == 0).select("u", "t")
    often = some.mapInPandas(list_owners, schema).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    often = [r.g for r in often.orderBy(F.desc("n"), "g").limit(HOT_GRAMS).collect()]
    hot = spark.sparkContext.broadcast(np.array(often, np.int64))
    found = rows.select("u", "t").mapInPandas(list_owners, schema)
    found = found.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("u", "at"), F.lit(SALTS))).otherwise(F.lit(0)))
    twice = found.withColumn("n", F.count("*").over(Window.partitionBy("g", "salt"))).where("n > 1 OR hot").drop("n", "salt")
    left = twice.groupBy("u").agg(F.collect_list(F.struct("at", "low", "high", "g", "hot")).alias("own"))
    left = stored(left.join(meta.where("NOT first").select("u"), "u", "left_anti"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, u, text, own in zip(pdf["id"], pdf["u"], pdf["t"], pdf["own"], strict=True):
                x = units(text)
                for r in own:
                    at, low, high = r["at"], r["low"], r["high"]
                    ctx = x[at - high : at - low + span].tobytes()
                    out.append((r["g"], ctx, i, u, at, low, high))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["g", "ctx", "id", "u", "at", "low", "high"])
                    out = []
            yield pd.DataFrame(out, columns=["g", "ctx", "id", "u", "at", "low", "high"])

    rows = rows.withColumn("id", F.coalesce("id", F.lit(LAST)))
    cool = left.withColumn("own", F.filter("own", lambda r: ~r["hot"])).where(F.size("own") > 0) if often else left
    have = _some(rows, cool).join(cool, "u").select("id", "u", "t", "own")
    schema = "g long, ctx binary, id long, u long, at int, low short, high short"
    dealt = have.mapInPandas(contexts, schema).withColumn("h", F.xxhash64("ctx"))
    dealt = dealt.repartition("g").sortWithinPartitions("g", "h", "low", "high", "id", "u", "at")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) >= 20_000:
                g = held["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last gram may go on
                if cut:
                    yield intervals(held.iloc[:cut].reset_index(drop=True))
                    held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield intervals(held)

    def intervals(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["u", "at"], ignore_index=True)
        group = f.groupby(["g", "h", "low", "high"], sort=False).ngroup().to_numpy()
        lead = np.flatnonzero(np.diff(group, prepend=-1))
        again = np.ones(len(f), bool)
        again[lead] = False
        if other:  # in the document of the group's first row it is not a repeat by that
            again &= f["id"].to_numpy() != f["id"].to_numpy()[lead][group]
        u, at, low, high = (f[c].to_numpy(np.int64) for c in ("u", "at", "low", "high"))
        whole = pd.DataFrame({"u": u[again], "s": (at - high)[again], "e": (at - low + span)[again]})
        one = f[~again].reset_index(drop=True)
        first = np.flatnonzero(~again)
        row, start = resolve(one)  # repeated windows: number of the row, distance of the window's start from the owner
        who = first[row]
        begin = at[who] - start
        order = np.lexsort((begin, who))
        who, begin = who[order], begin[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (begin[1:] != begin[:-1] + 1)
        low_, high_ = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(who)) - 1
        some = pd.DataFrame({"u": u[who[low_]], "s": begin[low_], "e": begin[high_] + span}) if len(who) else whole.iloc[:0]
        return pd.concat([whole, some], ignore_index=True)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, u, text, own in zip(pdf["id"], pdf["u"], pdf["t"], pdf["own"], strict=True):
                x = units(text)
                for r in own:
                    for s in range(r["at"] - r["high"], r["at"] - r["low"] + 1):
                        out.append((hashlib.blake2b(x[s : s + span].tobytes(), digest_size=16).digest(), i, u, s))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["w", "id", "u", "s"])
                    out = []
            yield pd.DataFrame(out, columns=["w", "id", "u", "s"])

    got = dealt.mapInPandas(decide, "u long, s long, e long")
    if often:
        warm = left.withColumn("own", F.filter("own", lambda r: r["hot"])).where(F.size("own") > 0)
        have = _some(rows, warm).join(warm, "u").select("id", "u", "t", "own")
        got = got.unionByName(_later(stored(have.mapInPandas(digests, "w binary, id long, u long, s long")), span, other))
    return stored(got.groupBy("u").agg(F.collect_list(F.struct("s", "e")).alias("spans")))


def _later(windows: DataFrame, span: int, other: bool) -> DataFrame:
    """u, s, e of the windows (w, id, u, s) whose digest w stands earlier, or with ``other`` in a smaller id."""
    place = F.struct("id", "u", "s")
    first = stored(windows.groupBy("w").agg(F.min(place).alias("lead"), F.count("*").alias("n")).where("n > 1"))
    later = F.col("id") > F.col("lead.id") if other else place > F.col("lead")
    bound = max(2.0, windows.count() / SHARE)
    few = F.broadcast(first.where(F.col("n") >= bound))
    cold = windows.join(few.select("w"), "w", "left_anti").join(first.where(F.col("n") < bound), "w")
    hits = cold.unionByName(windows.join(few, "w")).where(later)
    return hits.select("u", "s", (F.col("s") + span).alias("e"))


def finish(docs: DataFrame, meta: DataFrame, covered: DataFrame, units: Callable, keep: Callable, span: int) -> DataFrame:
    """id, n, n_removed, n_spans, sha for every row; keep(units, kept intervals) gives the bytes to digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for u, text, spans in zip(pdf["u"], pdf["t"], pdf["spans"], strict=True):
                x, at, removed, runs, stay = units(text), 0, 0, 0, []
                end = -1
                for s, e in sorted((r["s"], r["e"]) for r in spans):
                    if s > end:
                        runs += 1
                        stay.append((at, s))
                        removed += e - s
                    else:
                        removed += max(0, e - end)
                    end = max(end, e)
                    at = end
                stay.append((at, len(x)))
                out.append((u, removed, runs, hashlib.sha256(keep(x, [p for p in stay if p[0] < p[1]])).hexdigest()))
            yield pd.DataFrame(out, columns=["u", "removed", "runs", "kept"])

    rows = _some(keyed(docs), covered).join(covered, "u").select("u", "t", "spans")
    cut = rows.mapInPandas(run, "u long, removed long, runs long, kept string").dropDuplicates(["u"])
    copy = ~F.col("first") & (F.col("n") >= span)  # all of it stands in an earlier document
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return meta.join(cut, "u", "left").select(
        "id", "n", F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, none).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def with_first(meta: DataFrame) -> DataFrame:
    """meta (id, u, n, sha) with ``first``: whether the document is the first of those with its content."""
    lead = meta.groupBy("sha", "n").agg(F.min(F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "u")).alias("lead"))
    lead = lead.select("sha", "n", F.col("lead.u").alias("lead"), F.col("lead.id").alias("_id"))
    first = (F.col("u") == F.col("lead")) | (F.coalesce("id", F.lit(LAST)) == F.col("_id"))
    return stored(meta.join(lead, ["sha", "n"]).select("id", "u", "n", "sha", first.alias("first")))

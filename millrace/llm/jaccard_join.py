"""Operator 4, n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct five-word shingles (64-bit hashes). Sizes are cut into bands; sets of
one band, or of a band and the next, meet in an *instance*, in which a pair with Jaccard >= 0.75 differs in
at most k elements (a bound that follows from the sizes). Signatures of an instance:

* k <= 2: every element is a part; all subsets left after removing at most k parts are signatures;
* k <= SMALL: ceil((k + 1) / 3) parts, one of which has at most two differing elements; each part is cut into
  six cells and every choice of four of them that holds an element is a signature. A pair is left without one
  only if each part has as many differing elements as it has occupied cells, up to three; so a set whose parts
  have no more than k such cells in all is dealt again with another hash, until it has more (see ``dealt``);
* larger k: n parts, each one signature. With n = k + 1 some part is equal; fewer, larger parts are used as
  soon as the expected number of equal parts, n * exp(-k / n), is at least ``EQUAL`` (a miss then has a chance
  below exp(-EQUAL) for a pair at the very threshold). Parts that are empty give no signature.

Equal sets are one class from the start. The smallest class of a bucket is its *lead*; the classes that share a
bucket with a lead are a *group*, dealt to one task with their sets, each set once however many buckets it
shares. There all pairs of the group that are not yet linked through others are intersected exactly, and only
a spanning forest of the links found leaves the task, at most one row less than the group has. A group of more
than ``LOAD`` elements is cut into blocks and dealt as pairs of blocks, so rows grow with blocks, never with
pairs. Connected components of the forests end it.

Signatures that many documents carry are found in a sample of documents, which only says how they are dealt:
such a bucket is salted, its lead is the least of the salts' leads, and no task holds it whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import one_each, stored, table
from .components import components
from .words import Words, mixed, portions, shingles

NUMERATOR, DENOMINATOR = 3, 4  # Jaccard threshold 0.75
SMALL, EQUAL = 26, 20.0
#: Elements of a block of sets; a task holds two blocks (and no less than two sets).
LOAD = 1_000_000
#: Signatures of at least HOT documents in a sample of about SAMPLE are hot; at most HOT_SIGNS, the most frequent.
SAMPLE, HOT, HOT_SIGNS, SALTS = 5_000, 20, 20_000, 64
#: A lead with at least 1/SHARE of the memberships is sent to the tasks that cut its group (hence at most SHARE).
SHARE = 1_000
#: Bits of the filter of candidate documents that is sent to tasks: 1 MiB, whatever the input.
FILTER_BITS = 1 << 23


@lru_cache(maxsize=100_000)
def band(n: int) -> int:
    low, i = 1, 0
    while True:
        high = max(low, low * DENOMINATOR // NUMERATOR)
        if n <= high:
            return i
        low, i = high + 1, i + 1


@lru_cache(maxsize=1_000)
def reach(i: int) -> int:
    """The most elements by which a similar pair differs whose smaller set is in band i."""
    low = 1
    for _ in range(i):
        low = max(low, low * DENOMINATOR // NUMERATOR) + 1
    a = max(low, low * DENOMINATOR // NUMERATOR)
    return (a + a * DENOMINATOR // NUMERATOR) // 7


@lru_cache(maxsize=1_000)
def parts(k: int, exact: bool = False) -> int:
    """How many parts; with ``exact`` as many as leave one part equal whatever the hashes are."""
    n = k + 1
    for m in range(1, 0 if exact else k + 1):
        if m * math.exp(-k / m) >= EQUAL:
            n = m
            break
    return n


_FOUR = np.zeros((6, 15), np.uint64)
for _j, _c in enumerate(combinations(range(6), 4)):
    _FOUR[list(_c), _j] = 1


def dealt(s: np.ndarray, spread: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The choices of four cells of each part that hold an element, for one deal of the elements after the other.

    If sets that differ in at most k elements share none in a deal, every part has three differing elements
    or more, or two at most that lie in all its occupied cells. Then min(3, occupied cells), summed over the
    parts, is at most k for both sets, and both go on to the next deal; it ends with the first whose sum is
    larger, where a pair cannot be missed.
    """
    n, high, low = -(-(k + 1) // 3), s, spread >> np.uint64(8)
    for deal in range(1, 1000):
        at = ((high >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        cell = (at * np.uint64(6) + low % np.uint64(6)).astype(np.int64)
        sums, held = np.zeros(n * 6, np.uint64), np.bincount(cell, minlength=n * 6).reshape(n, 6)
        np.add.at(sums, cell, spread)
        number = np.arange(n * 15, dtype=np.uint64).reshape(n, 15) + np.uint64((deal - 1) << 32)
        yield (sums.reshape(n, 6) @ _FOUR + number * np.uint64(0x9E3779B97F4A7C15))[(held @ _FOUR.astype(int)) > 0]
        if np.minimum((held > 0).sum(1), 3).sum() > k:
            return
        high = mixed(spread + np.uint64(deal * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        low = high & np.uint64(0xFFFFFFFF)


def signatures(s: np.ndarray, exact: bool = False) -> np.ndarray:
    """s: sorted distinct hashes. All signatures of the set, in its own instance and the one below."""
    out, own = [], band(len(s))
    if not len(s):
        return np.empty(0, np.uint64)
    spread = mixed(s)
    for i in {own, max(own - 1, 0)}:
        k, salt = reach(i), mixed(np.array([i + 1], np.uint64))[0]
        if k <= 2:
            total = spread.sum(dtype=np.uint64)
            found = [total]
            for d in range(1, min(k, len(s) - 1) + 1):
                found += [np.delete(spread, c).sum(dtype=np.uint64) for c in combinations(range(len(s)), d)]
            out.append(mixed(np.array(found, np.uint64) + salt))
        elif k <= SMALL:
            out += [mixed(x + salt) for x in dealt(s, spread, k)]
        else:
            n = parts(k, exact)
            at = (((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)  # ascending, as s is
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sign = np.add.reduceat(spread, first) + at[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out.append(mixed(sign + salt))
    return np.unique(np.concatenate(out))


def set_key(s: np.ndarray) -> int:
    return int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0].astype(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", text).alias("u"), text.alias("t"))


def shingle_sets(docs: DataFrame, exact: bool = False) -> DataFrame:
    """id, u (hash of id and text), n, key and, once for each key in a task, signatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            ids = pdf["id"].astype("Int64")
            for first, part in portions(pdf["t"]):
                out = []
                own = slice(first, first + len(part))
                for i, u, words in zip(ids.iloc[own], pdf["u"].iloc[own], Words(part), strict=True):
                    s = np.unique(shingles(words))
                    if not len(s):
                        out.append((i, u, 0, None, None))
                        continue
                    key = set_key(s)
                    if key in seen:
                        out.append((i, u, len(s), key, None))
                        continue
                    if len(seen) < 1_000_000:  # memory of a task; what it misses is met again below
                        seen.add(key)
                    out.append((i, u, len(s), key, signatures(s, exact).view(np.int64)))
                i, u, n, key, signs = zip(*out, strict=True)
                yield pd.DataFrame({"id": pd.array(i, "Int64"), "u": u, "n": n, "key": pd.array(key, "Int64"), "signs": signs})

    return stored(_texts(docs).mapInPandas(run, "id long, u long, n long, key long, signs array<long>"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, set: the shingles of the documents whose ``u`` is in ``wanted`` (and of few others)."""
    place = F.pmod("u", F.lit(FILTER_BITS))
    bits = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # at most 257 rows of 4 KiB
    mask = np.zeros(FILTER_BITS + 32768, np.bool_)
    for r in bits:
        own = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")
        mask[(r.b - 1) * 32768 : (r.b - 1) * 32768 + len(own)] = own
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = np.unpackbits(sent.value)
        for pdf in batches:
            for _, part in portions(pdf["t"][mask[pdf["p"].to_numpy()] > 0]):
                out = []
                for words in Words(part):
                    s = np.unique(shingles(words))
                    if len(s):
                        out.append((set_key(s), s.tobytes()))
                yield pd.DataFrame(out, columns=["key", "s"])

    found = _texts(docs).withColumn("p", place + 0).mapInPandas(run, "key long, s binary")
    return found.groupBy("key").agg(F.any_value("s").alias("s"))


def forest(sets: list[np.ndarray], left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions i, j) with Jaccard >= 0.75 that join what all such links of the sets join.

    Elements that many sets hold are bits and intersected by counting bits, the others by their lists of sets.
    left: only pairs of a set that is in it and one that is not (two blocks).
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    of = np.repeat(np.arange(m), size)
    element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    often = count >= max(4, m // 32)
    dense = np.flatnonzero(often)
    place = np.zeros(len(count), np.int64)
    place[dense] = np.arange(len(dense))
    held = np.zeros((m, (len(dense) + 63) // 64 * 64), np.bool_)
    own = often[element]
    held[of[own], place[element[own]]] = True
    bits = np.packbits(held, axis=1).view(np.uint64)
    rare = (count[element] > 1) & ~own
    who, what = of[rare], element[rare]
    order = np.argsort(what, kind="stable")
    holders, begin = who[order], np.searchsorted(what[order], np.arange(len(count) + 1))
    start = np.searchsorted(who, np.arange(m + 1))
    label, links = np.arange(m), []
    for i in range(m - 1):
        fit = (label != label[i]) & (np.minimum(size, size[i]) * DENOMINATOR >= np.maximum(size, size[i]) * NUMERATOR)
        fit[: i + 1] = False
        if left is not None:
            fit &= left != left[i]
        with_ = np.flatnonzero(fit)
        if not len(with_):
            continue
        both = np.bitwise_count(bits[with_] & bits[i]).sum(1, dtype=np.int64)
        mine = what[start[i] : start[i + 1]]
        if len(mine):
            length = begin[mine + 1] - begin[mine]
            at = np.repeat(begin[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
            both += np.bincount(holders[at], minlength=m)[with_]
        for j in with_[DENOMINATOR * both >= NUMERATOR * (size[with_] + size[i] - both)]:
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


def groups(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """lead, key, n: every class of a bucket beside the bucket's smallest class, each pair once."""
    sign = sets.where("signs IS NOT NULL").select("key", "n", F.explode("signs").alias("sign"))
    sign = sign.join(F.broadcast(hot.select("sign", F.col("sign").alias("warm"))), "sign", "left")
    salt = F.when(F.col("warm").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0))
    bucket = Window.partitionBy("sign", "salt")
    met = sign.withColumn("salt", salt).withColumn("lead", F.min("key").over(bucket)).withColumn("last", F.max("key").over(bucket))
    met = stored(met.where("lead < last OR warm IS NOT NULL").select("lead", "key", "n", "warm").distinct())
    first = F.broadcast(met.where("warm IS NOT NULL").groupBy("warm").agg(F.min("lead").alias("least")))  # at most HOT_SIGNS rows
    return stored(met.join(first, "warm", "left").select(F.coalesce("least", "lead").alias("lead"), "key", "n").distinct())


def blocks(members: DataFrame, load: int = LOAD) -> DataFrame:
    """The rows of ``members`` once for each pair of blocks (i <= j) of their group they take part in."""
    one = F.lit(0)
    size = members.groupBy("lead").agg(F.sum("n").alias("elements"), F.count("*").alias("rows")).where(F.col("elements") > load)
    large = stored(size.select("lead", F.ceil(F.col("elements") / load).cast("int").alias("cuts"), "rows"))
    if not large.take(1):
        return members.select("lead", "key", one.alias("i"), one.alias("j"), one.alias("block"))
    bound = max(2.0, members.count() / SHARE)
    few = F.broadcast(large.where(F.col("rows") >= bound).drop("rows"))
    rest = large.where(F.col("rows") < bound).drop("rows")
    cold = members.join(few.select("lead"), "lead", "left_anti").join(rest, "lead", "left")
    cut = cold.unionByName(members.join(few, "lead")).withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    cut = cut.withColumn("x", F.explode(F.sequence(one, F.col("cuts") - 1)))
    return cut.select("lead", "key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block")


def links(members: DataFrame, sets: DataFrame, load: int = LOAD) -> DataFrame:
    """a, b: a spanning forest of the similar pairs of each group (or pair of blocks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, name = [], None

        def close() -> pd.DataFrame:
            keys, values, block = [h[0] for h in held], [np.frombuffer(h[1], np.uint64) for h in held], np.array([h[2] for h in held])
            cut = None if name is None or name[1] == name[2] else block == name[1]
            found = forest(values, cut) if len(held) > 1 else []
            return pd.DataFrame([(keys[i], keys[j]) for i, j in found], columns=["a", "b"], dtype=np.int64)

        for pdf in batches:
            for lead, i, j, key, block, s in zip(pdf["lead"], pdf["i"], pdf["j"], pdf["key"], pdf["block"], pdf["s"], strict=True):
                if name != (lead, i, j):
                    if len(held) > 1:
                        yield close()
                    held, name = [], (lead, i, j)
                held.append((key, s, block))
        if len(held) > 1:
            yield close()

    dealt = blocks(members, load).join(sets, "key").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "key")
    return dealt.select("lead", "i", "j", "key", "block", "s").mapInPandas(run, "a long, b long")


def linked(docs: DataFrame, exact: bool = False, load: int = LOAD) -> tuple[DataFrame, DataFrame]:
    """``shingle_sets`` of the rows, and key, id (the smallest), root (smallest key of the component) of each set."""
    sets = shingle_sets(docs, exact)
    classes = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.min("u").alias("u"))
    some = sets.where("signs IS NOT NULL").where(F.pmod(F.xxhash64("key"), F.lit(max(1, sets.count() // SAMPLE))) == 0)
    some = some.select("key", F.explode("signs").alias("sign")).distinct().groupBy("sign").agg(F.count("*").alias("n"))
    hot = stored(some.where(F.col("n") >= HOT).orderBy(F.desc("n"), "sign").limit(HOT_SIGNS).select("sign"))
    members = groups(sets, hot)
    if not members.where("lead <> key").take(1):
        return sets, stored(classes.select("key", "id", F.col("key").alias("root")))
    fetched = sets_of(docs, members.select("key").distinct().join(classes, "key").select("u"))
    roots = components(stored(links(members, fetched, load)))
    known = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    return sets, stored(known)


def jaccard_join(docs: DataFrame, exact: bool = False, load: int = LOAD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents without words have no shingles and are their own component, as are null texts. Texts of one
    to four words have one shingle, all their words. A null id is carried through and never names a
    component. Rows repeated with one id count once for links and are all returned. An empty table gives an
    empty result. Other columns are ignored. exact: as many parts as exclude a miss for large sets too.
    """
    sets, known = linked(docs, exact, load)
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    named = known.join(least, "root").select("key", "component_id")
    out = sets.select("id", "n", "key").join(named, "key", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its columns (for pipelines): the smallest id, a null id last.

    Rows are told apart by id and text, so rows that share an id each have their own verdict. Documents
    without words all stay.
    """
    sets, known = linked(docs)
    same = {"none": F.col("id").isNull(), "id0": F.coalesce("id", F.lit(0).cast("long")), "u": F.col("u")}
    rows = sets.groupBy(*(c.alias(k) for k, c in same.items()), "key").agg(F.count("*").alias("copies"))
    own = rows.join(known.select("key", "root"), "key")
    best = own.groupBy("root").agg(F.min(F.struct(*same, "copies")).alias("x")).select("x.*", F.lit(False).alias("every"))
    bare = rows.where("key IS NULL").select(*same, "copies", F.lit(True).alias("every"))
    id = F.col("doc_id").cast("long")
    keys = {"none": id.isNull(), "id0": F.coalesce(id, F.lit(0).cast("long")), "u": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))}
    return one_each(docs, keys, stored(best.unionByName(bare)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

"""Operator 9, benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are short, documents long, so a document's own MinHash would hide them. Items are partitioned by
their number of shingles (each partition spans a factor of two); for each partition a document is cut
into overlapping windows twice as long as its largest item, and a window's MinHash is compared with those
of the items. One shared value of ``HASHES`` makes a candidate: at containment t in a window of twice the
size the chance that none is shared is below (1 - t / (3 - t)) ** HASHES, 1e-11 at 0.75; for the smallest item of
a partition, whose window is up to four times its size, below 4e-6. Candidates are
verified by the exact containment of the item's shingles in the whole document.

The items are a stated query set: they are taken in blocks of at most ``BLOCK`` items, each sent to the
tasks (its size is so bounded), against all documents, which are read once a block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import Words, mixed, portions, shingles

THRESHOLD, HASHES = 0.75, 64
#: Items a block; with MAX_SHINGLES they bound what is broadcast.
BLOCK, MAX_SHINGLES = 20_000, 4_000_000
_SEEDS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(values: np.ndarray) -> np.ndarray:
    return np.array([mixed(values ^ s).min() for s in _SEEDS], np.uint64)


class Block:
    """Index of a block of items: shingle sets, and by size partition the sorted MinHash values of each hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.ids = np.array([i for i, _ in items])
        self.sets = [s for _, s in items]
        self.sizes = np.array([len(s) for s in self.sets])
        self.threshold = threshold
        self.partitions = []
        bands = np.ceil(np.log2(self.sizes)).astype(int)
        for band in np.unique(bands):
            own = np.flatnonzero(bands == band)
            signs = np.array([minima(self.sets[i]) for i in own])
            order = np.argsort(signs, axis=0)
            largest = int(self.sizes[own].max())
            self.partitions.append((largest, own, np.take_along_axis(signs, order, 0), order))
        #: Shingles of any item: a window without one has no candidate.
        self.all = np.unique(np.concatenate(self.sets))

    def search(self, found: np.ndarray) -> list[tuple[int, int, int]]:
        """(number of the item, shared shingles, its size) of the items contained in the document.

        found: the shingles of the document in order.
        """
        at = np.searchsorted(self.all, found)
        at[at == len(self.all)] = 0
        hits = np.flatnonzero(self.all[at] == found)
        if not len(hits):
            return []
        candidates: set[int] = set()
        for largest, own, values, order in self.partitions:
            # Windows start at multiples of `largest` and are twice as long: every run of `largest` lies in one.
            starts = np.unique(np.concatenate([hits // largest, np.maximum(hits // largest - 1, 0)])) * largest
            for s in starts:
                window = np.unique(found[s : s + 2 * largest])
                sign = minima(window)
                for h in range(HASHES):
                    low, high = np.searchsorted(values[:, h], sign[h], "left"), np.searchsorted(values[:, h], sign[h], "right")
                    candidates.update(own[order[low:high, h]].tolist())
        if not candidates:
            return []
        whole, out = np.unique(found), []
        for c in sorted(candidates):
            shared = int(np.isin(self.sets[c], whole, assume_unique=True).sum())
            if shared >= self.threshold * self.sizes[c]:
                out.append((c, shared, int(self.sizes[c])))
        return out


def blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items and their shingles, in blocks of bounded size."""
    block: list = []
    size = 0
    for item in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id").toLocalIterator():
        s = np.unique(shingles(Words([item.text]).hash))
        if len(s):
            block.append((item.item_id, s))
            size += len(s)
        if len(block) >= BLOCK or size >= MAX_SHINGLES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs doc_id, item_id, n_shared, n_item, containment: items whose share of distinct five-word
    shingles in the document is at least ``threshold``.

    Words are runs of other than ASCII white space, A-Z lower-cased; texts of fewer than five words count
    as one shingle. Null or empty texts match nothing. A null id is carried through; repeated rows give
    repeated pairs. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    out = spark.createDataFrame([], schema)

    def probe(batch: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(Block(batch, threshold))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = sent.value
            for pdf in batches:
                found, ids = [], pdf["id"].astype("Int64")
                for first, part in portions(pdf["t"]):
                    for j, words in enumerate(Words(part)):
                        for c, shared, n in index.search(shingles(words)):
                            found.append((ids.iloc[first + j], index.ids[c], shared, n, shared / n))
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        return rows.mapInPandas(run, schema)

    for batch in blocks(items):
        out = out.unionByName(probe(batch))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their columns (for pipelines): every row by its own text, no shuffle."""
    schema = docs.schema

    def without(rows: DataFrame, batch: list) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(Block(batch, THRESHOLD))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index = sent.value
            for part in batches:
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                stay = [not index.search(shingles(words)) for _, some in portions(texts) for words in Words(some)]
                yield part.filter(pa.array(stay, pa.bool_()))

        return rows.mapInArrow(run, schema)

    for batch in blocks(items):
        docs = without(docs, batch)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)),
    lambda i: array_to_string(ws[i : i + 4], ' '))) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
      FROM s d JOIN s i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM p JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item
"""

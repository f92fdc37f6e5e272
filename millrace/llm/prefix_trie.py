"""Operator 12, conversation prefix trie: hashed node tables with flat arrays.

A node of the trie is a distinct sequence of first turns. It is known by the chained digest of its turns
(128 bits of sha256), which every conversation computes for itself in the order of its turns, so no node
is ever collected. Two sums over the trie's edges are wanted for every node; they are made in shards:

1. nodes are enumerated by aggregation over digests; each is owned by its smallest conversation, and the
   nodes that a conversation owns are the lower end of its path;
2. conversations are dealt over tasks by id, so a hot first turn is spread over all of them. A task cuts its
   paths into shards of bounded size. A shard enumerates its distinct digests, gives each a slot by a
   minimal perfect hash, which is verified against the stored digest, scatters what owned nodes bring into
   flat arrays and adds them up through the array of parent slots, deepest nodes first;
3. the sums of the shards, one row for each node and shard, are added by digest.

A path that a shard's end cuts goes on in the next shard: what its uppermost node has gathered is carried
to the parent. Turn texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table
from .merkle import CRC
from .words import mixed

#: A conversation is rebuilt from the first crc32(id) % HEADS turns of the first of its FAMILY consecutive ids.
FAMILY, HEADS = 5, 9
#: Rows of a shard, hence the bound of its arrays.
SHARD = 200_000
#: A node with at least 1/HOT_SHARE of all nodes as children is hot, hence at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Bits of a conversation id that are one piece of a node's list of ends (4,096 ids at most).
PIECE = 12
ROOT = hashlib.sha256(b"").digest()[:16]
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Slots:
    """A minimal perfect hash of distinct 128-bit keys (an array of n rows of two 64-bit values)."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = np.empty_like(keys), []
        left, base = keys, 0
        while len(left):
            at = self._place(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            rank = np.where(alone, base + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            own = alone[at]
            self.keys[rank[at[own]]] = left[own]
            base, left = base + int(own.sum()), left[~own]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mixed(keys[:, 0] ^ salt) ^ mixed(keys[:, 1] + salt)) % np.uint64(size)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that is not in the table (slots are compared with the stored keys)."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, rank in enumerate(self.levels):
            found = rank[self._place(keys[open_], level, len(rank))]
            hit = found >= 0
            out[open_[hit]] = found[hit]
            open_ = open_[~hit]
        wrong = (self.keys[out] != keys).any(1) if len(self.keys) else np.ones(len(keys), bool)
        out[wrong] = -1
        return out


def _keys(frame: pd.DataFrame, a: str, b: str) -> np.ndarray:
    return np.column_stack([frame[a].to_numpy(np.int64), frame[b].to_numpy(np.int64)]).view(np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and one place of each."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ranked = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (ranked[1:] != ranked[:-1]).any(1)
    return ranked[first], order[first]


def shard_sums(frame: pd.DataFrame, carry: tuple[np.ndarray, np.ndarray]) -> tuple[pd.DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Sums by node of one shard, and what goes on to parents beyond it (keys and sums).

    frame: depth, a, b, pa, pb, and what the row's node brings: saved, leaf, child (1 for an owned node).
    """
    keys, parents = _keys(frame, "a", "b"), _keys(frame, "pa", "pb")
    known, at = distinct(keys)
    slots = Slots(known)
    slot, mine = slots(keys), slots(known)
    size = len(known)
    depth, parent = np.empty(size, np.int64), np.empty(size, np.int64)
    depth[mine] = frame["depth"].to_numpy(np.int64)[at]
    up = parents[at]
    parent[mine] = np.where(depth[mine] > 0, slots(up), -1)
    upper = np.empty_like(known)
    upper[mine] = up
    sums = np.zeros((size, 3), np.int64)  # saved tokens, leaves, children
    np.add.at(sums, slot, np.column_stack([frame["saved"], frame["leaf"], np.zeros(len(frame), np.int64)]).astype(np.int64))
    child = np.zeros(size, np.int64)
    np.add.at(child, slot, frame["child"].to_numpy(np.int64))
    got = slots(carry[0])
    np.add.at(sums, got[got >= 0], carry[1][got >= 0])
    onward = [(carry[0][got < 0], carry[1][got < 0])]
    order = np.argsort(-depth, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):  # deepest first; the root has no parent
        here = here[depth[here] > 0]
        inside = parent[here] >= 0
        brought = np.column_stack([sums[here, 0], sums[here, 1], child[here]])
        np.add.at(sums, parent[here[inside]], brought[inside])
        onward.append((upper[here[~inside]], brought[~inside]))
    some = sums.any(1)
    out = pd.DataFrame(slots.keys[some].view(np.int64), columns=["a", "b"])
    out[["saved", "leaves", "children"]] = sums[some]
    return out, (np.concatenate([k for k, _ in onward]), np.concatenate([s for _, s in onward]))


def sharded(frames: Iterator[pd.DataFrame], size: int = SHARD) -> Iterator[pd.DataFrame]:
    """Sums by node for each shard of ``size`` rows; rows come by conversation, deepest first."""
    carry = (np.empty((0, 2), np.uint64), np.empty((0, 3), np.int64))
    held: list[pd.DataFrame] = []
    for pdf in frames:
        for i in range(0, len(pdf), size):
            held.append(pdf.iloc[i : i + size])
            if sum(map(len, held)) >= size:
                out, carry = shard_sums(pd.concat(held, ignore_index=True), carry)
                held = []
                yield out
    if held:
        out, carry = shard_sums(pd.concat(held, ignore_index=True), carry)
        yield out
    if len(carry[0]):
        raise ValueError("a path ends above no root")


def chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Path rows (conv_id, depth, a, b, pa, pb, size, ends) of turns (conv_id, pos, turn, size) in order."""
    conv, depth, above, last = None, 0, ROOT, None
    for pdf in frames:
        rows = []
        for c, pos, turn, size in zip(pdf["conv_id"].tolist(), pdf["pos"].tolist(), pdf["turn"], pdf["size"].tolist(), strict=True):
            if last is not None:
                rows.append((*last, c != conv))
            if c != conv:
                conv, depth, own, above = c, 0, ROOT, ROOT
            if pos:
                depth, above = depth + 1, own
                own = hashlib.sha256(above + turn).digest()[:16]
            last = (c, depth, own, above, size)
        if rows:
            yield _frame(rows)
    if last is not None:
        yield _frame([(*last, True)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    c, depth, own, above, size, ends = zip(*rows, strict=True)
    halves = lambda x: np.frombuffer(b"".join(x), "<i8").reshape(-1, 2)
    k, p = halves(own), halves(above)
    return pd.DataFrame({"conv_id": c, "depth": depth, "a": k[:, 0], "b": k[:, 1], "pa": p[:, 0], "pb": p[:, 1], "size": size, "ends": ends})


def end_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b, ends_sha256 of pieces (a, b, ids) in order; a node's list is never held whole."""
    now, hashed = None, None
    for pdf in frames:
        rows = []
        for a, b, ids in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ids"], strict=True):
            if (a, b) == now:
                hashed.update(b"," + ids.encode())
                continue
            if now:
                rows.append((*now, hashed.hexdigest()))
            now, hashed = (a, b), hashlib.sha256(ids.encode())
        yield pd.DataFrame(rows, columns=["a", "b", "ends_sha256"])
    if now:
        yield pd.DataFrame([(*now, hashed.hexdigest())], columns=["a", "b", "ends_sha256"])


def _heads(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, turn, size) of rebuilt conversations, in the order of pos, and pos 0 for each conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    both = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("nr"),
        F.unhex(F.sha2(both.cast("binary"), 256)).alias("turn"), F.octet_length(text("text")).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("nr").asc_nulls_first(), "turn")
    own = stored(own.select("conv_id", F.row_number().over(order).alias("pos"), "turn", "size"))
    ids = own.where("pos = 1").select("conv_id")
    wanted = ids.select(F.col("conv_id").alias("member"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("conv_id"))
    heads = own.where(F.col("pos") < HEADS).join(wanted, "conv_id").where(F.col("pos") <= _heads(F.col("member")))
    top = ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("size"))
    tails = own.where(F.col("pos") > _heads(F.col("conv_id")))
    return top.unionByName(heads.select(F.col("member").alias("conv_id"), "pos", "turn", "size")).unionByName(tails)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Columns conv_id, turn, role and text are read. Turns without a conv_id belong to no conversation and are
    left out; turns of one number (repeated rows too, each kept) are ordered by the sha256 of role and text.
    Null and empty texts are equal. An empty table gives an empty result, as no conversation makes a root.
    Calling this runs jobs: paths and nodes are written.
    """
    rows = rebuilt(turns).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    paths = stored(rows.mapInPandas(chained, "conv_id long, depth long, a long, b long, pa long, pb long, size long, ends boolean"))
    key = ["a", "b"]
    nodes = stored(paths.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.count("*").alias("n_convs"), F.max("size").alias("size"), F.sum(F.col("ends").cast("long")).alias("n_ends"),
    ))
    zero = F.lit(0).cast("long")
    place = ["conv_id", "depth", "a", "b", "pa", "pb"]
    steps = paths.select(*place, zero.alias("saved"), zero.alias("leaf"), zero.alias("child")).unionByName(nodes.select(
        *place, ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), (zero + 1).alias("child"),
    ))
    steps = steps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("depth"))
    sums = steps.mapInPandas(sharded, "a long, b long, saved long, leaves long, children long").groupBy(*key)
    sums = sums.agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"))
    pieces = paths.where("ends").groupBy(*key, F.shiftright("conv_id", PIECE).alias("piece"))
    pieces = pieces.agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInPandas(end_digests, "a long, b long, ends_sha256 string")
    zeroes = {"saved_tokens": 0, "n_leaves": 0, "n_children": 0, "ends_sha256": NO_ENDS}
    full = stored(nodes.join(sums, key, "left").join(ends, key, "left").fillna(zeroes))

    parents = full.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    bound = max(2, full.count() / HOT_SHARE)
    hot = F.broadcast(parents.where(F.col("n_children") >= bound).drop("n_children"))  # at most HOT_SHARE rows
    few = parents.where(F.col("n_children") < bound).drop("n_children")
    edge = ["pa", "pb"]
    below = full.where("depth > 0")
    out = below.join(hot, edge).unionByName(below.join(hot, edge, "left_anti").join(few, edge, "left"))
    out = out.unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {CRC.format("conv_id")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT i.conv_id, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % {FAMILY} AND o.pos <= i.h
  UNION ALL
  SELECT i.conv_id, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size,
         string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
step AS (SELECT conv_id, depth, size, sha256(k) AS k, lag(sha256(k)) OVER w AS pk, lead(depth) OVER w IS NULL AS ends FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
node AS (
  SELECT k, min(conv_id) AS conv_id, min(depth) AS depth, min(pk) AS pk, count(*) AS n_convs, min(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256, bool_and(ends) AS childless
  FROM step GROUP BY k),
below AS (
  SELECT s.k, sum(n.childless::INT) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM node n JOIN step s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.k),
kids AS (SELECT pk AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY pk)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n LEFT JOIN node p ON p.k = n.pk AND n.depth > 0 JOIN below b ON b.k = n.k LEFT JOIN kids c ON c.k = n.k
"""

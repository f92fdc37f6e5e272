"""Operator 11, Merkle manifest of a data set: concatenated levels of aligned blocks.

Every row is a leaf. The leaves of a language, in the order of their ids, are cut into aligned blocks of
``2 ** bits``. A block keeps each of its levels as ONE string of fixed-width hexadecimal digests: parents
are hashes of fixed-width substrings of it, the siblings of a node are the substrings that flank it, and
the one digest that remains is a node of the next stage, which is cut into blocks in turn. The roots of
the languages then form a tree of their own by the same steps.

Positions come from one range exchange on (language, id): a row's place in its sorted partition plus the
offset of that partition, which a table of one row for each partition and language tells. No row is dealt
by language, so one language may hold all rows. Proofs go top down: a block is joined with the path above
it, and its own segments are put before that path. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, stored, table

#: Levels in a block: 2 ** BITS nodes, 16 KB of text at its lowest level.
BITS = 8
#: Characters of a digest.
WIDE = 64
#: Every how many ids (by crc32) are tampered with in the check of the proofs.
TAMPERED = 7
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(fields[k] for k in _FIELDS)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (language; '' for null), leaf, changed (the tampered leaf, null where untouched), src."""
    own = docs.select(*(F.col(k).cast("long" if k in ("doc_id", "n_chars") else "string").alias(k) for k in _FIELDS))
    fields = {k: _field(k) for k in _FIELDS}
    more = F.when(F.col("n_chars").isNull(), F.lit("-")).otherwise(
        F.concat(F.length((F.col("n_chars") + 1).cast("string")).cast("string"), F.lit(":"), (F.col("n_chars") + 1).cast("string"))
    )
    return own.select(
        "doc_id", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("tree"), _digest(fields).alias("leaf"),
        F.when(crc_mod(F.col("doc_id"), TAMPERED) == 0, _digest(fields | {"n_chars": more})).alias("changed"), F.spark_partition_id().alias("src"),
    )


def ranked(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with pos (from 0, within ``tree``, in the given order) and n (nodes of the tree)."""
    spread = nodes.repartitionByRange(F.col("tree").asc(), *order).sortWithinPartitions(F.col("tree").asc(), *order)
    spread = stored(spread.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    spread = spread.select("*", part, place).drop("at")
    counts = spread.groupBy("part", "tree").agg(F.count("*").alias("k"), F.min("place").alias("low"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("part", "tree", (before - F.col("low")).alias("start"), F.sum("k").over(whole).alias("n")))
    return spread.join(starts, ["part", "tree"]).withColumn("pos", F.col("place") + F.col("start")).drop("part", "place", "start")


def _height(n: Column, bits: int) -> Column:
    """Levels that a block goes up: all of them in a tree of more blocks, else until one node is left."""
    out = F.lit(bits)
    for k in range(bits - 1, -1, -1):
        out = F.when(n <= (1 << k), F.lit(k)).otherwise(out)
    return out


def blocks(nodes: DataFrame, bits: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """tree, n, block, rows (structs of the ``carried`` columns in order), levels (array of binary), h, root."""
    kept = F.struct("pos", "leaf", *carried)
    out = nodes.groupBy("tree", "n", F.shiftright("pos", bits).alias("block")).agg(F.array_sort(F.collect_list(kept)).alias("rows"))
    hexes = F.array_join(F.transform("rows", lambda x: F.lower(F.hex(x["leaf"]))), "")
    out = out.withColumns({"h": _height(F.col("n"), bits), "l0": hexes.cast("binary")})
    for k in range(bits):  # parents: hashes of every two neighbouring digests, or of the last one alone
        up = F.expr(
            f"cast(array_join(transform(sequence(0L, (octet_length(l{k}) - 1) div {2 * WIDE}),"
            f" i -> sha2(substring(l{k}, cast(i * {2 * WIDE} + 1 as int), {2 * WIDE}), 256)), '') as binary)"
        )
        out = out.withColumn(f"l{k + 1}", F.when(F.col("h") > k, up).otherwise(F.col(f"l{k}")))
    levels = F.array(*(f"l{k}" for k in range(bits))).alias("levels")
    return stored(out.select("tree", "n", "block", "rows", "h", levels, F.col(f"l{bits}").cast("string").alias("root")))


def climb(nodes: DataFrame, bits: int, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every stage, lowest first, and the roots (tree, root)."""
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    stages = [blocks(nodes, bits, carried)]
    while most > 1 << bits:
        most = -(-most >> bits)
        up = F.expr(f"cast(ceil(n / {1 << bits}) as long)")
        stages.append(blocks(stages[-1].select("tree", up.alias("n"), F.col("block").alias("pos"), F.unhex("root").alias("leaf")), bits))
    return stages, stages[-1].select("tree", "root")


def descend(stages: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """The lowest nodes with path: their siblings (l, r; texts, empty where there is none), lowest level first.

    above: for each tree its path, and further columns that are handed down.
    """
    for k, stage in reversed(list(enumerate(stages))):
        own = stage.drop("root").join(above, ["tree"] if k == len(stages) - 1 else ["tree", "block"])
        own = own.select("*", F.posexplode("rows").alias("at", "row")).drop("rows")
        flank = lambda side: f"cast(substring(levels[j], cast((shiftright(at, j) {side} 1) * {WIDE} + 1 as int), {WIDE}) as string)"
        segment = F.expr(
            f"transform(slice(array({', '.join(map(str, range(bits)))}), 1, h), j -> named_struct("
            f"'l', if(shiftright(at, j) % 2 = 1, {flank('-')}, ''), 'r', if(shiftright(at, j) % 2 = 0, {flank('+')}, '')))"
        )
        above = own.withColumn("path", F.concat(segment, "path")).withColumn("block", F.shiftleft("block", bits) + F.col("at")).drop("n", "h", "levels", "at")
        if k:
            above = stored(above.drop("row"))
    return above


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Columns doc_id, source, lang, n_chars and text are hashed, nulls as `-`; other columns are ignored. Null
    ids stand before others and are never tampered with; rows with equal ids are ordered by their leaves, and
    repeated rows each have their own place and proof. A null language has a tree of its own, as the empty
    one has. An empty table gives an empty result. Calling this runs jobs: positions and levels are written.
    """
    base = stored(leaves(docs))
    nodes = ranked(base, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("src").asc()]).drop("src")
    stages, roots = climb(nodes, bits, ("doc_id", "changed"))
    crown = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.unhex("root").alias("leaf"))
    crown_stages, top = climb(ranked(crown, [F.col("name").asc()]), bits, ("name",))
    root = next((r.root for r in top.take(1)), None)
    start = top.select("tree", F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"))
    over = descend(crown_stages, start, bits)
    over = stored(over.select(F.col("row.name").alias("tree"), "path", F.lower(F.hex("row.leaf")).alias("subroot")))
    out = descend(stages, over, bits).select(
        F.col("row.doc_id").alias("doc_id"), F.lower(F.hex("row.leaf")).alias("leaf"), "subroot", F.lit(root).alias("root"), "path",
        F.lower(F.hex(F.coalesce("row.changed", "row.leaf"))).alias("tried"),
    )
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "").cast("binary"), 256)
    fold = F.aggregate("path", F.col("tried"), lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]).cast("binary"), 256))
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: crc32 of a decimal number, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(({0}::VARCHAR)[i])::BIGINT)),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_V = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_V.format(c) for c in ("doc_id", "source", "lang", "({n})", "text")) + ")"

SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_LEAF.format(n="n_chars")} AS leaf,
         CASE WHEN {CRC.format("doc_id")} % 7 = 0 THEN {_LEAF.format(n="n_chars + 1")} ELSE {_LEAF.format(n="n_chars")} END AS tried,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
own AS (
  SELECT tree, 0 AS level, pos, n, leaf AS d FROM leaf
  UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM own WHERE n > 1 GROUP BY tree, level, pos // 2),
sub AS (SELECT tree, d, level AS h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, n, d FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT d FROM crown WHERE n = 1),
step AS (
  SELECT l.doc_id, a.level AS k, b.d AS s, (l.pos >> a.level) % 2 AS side
  FROM leaf l JOIN own a ON a.tree = l.tree AND a.n > 1 AND a.pos = (l.pos >> a.level)
  LEFT JOIN own b ON b.tree = l.tree AND b.level = a.level AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT l.doc_id, u.h + a.level, b.d, (u.pos >> a.level) % 2
  FROM leaf l JOIN sub u ON u.tree = l.tree JOIN crown a ON a.n > 1 AND a.pos = (u.pos >> a.level)
  LEFT JOIN crown b ON b.level = a.level AND b.pos = xor(a.pos, 1)),
path AS (SELECT doc_id, list(struct_pack(s := coalesce(s, ''), side := side) ORDER BY k) AS p, string_agg(coalesce(s, ''), '' ORDER BY k) AS proof FROM step GROUP BY doc_id),
folded AS (
  SELECT doc_id, tried AS d, 1 AS k FROM leaf
  UNION ALL
  SELECT f.doc_id, CASE WHEN p[k].side = 1 THEN sha256(p[k].s || d) ELSE sha256(d || p[k].s) END, k + 1
  FROM folded f JOIN path USING (doc_id) WHERE k <= len(p)),
last AS (SELECT doc_id, arg_max(d, k) AS d FROM folded GROUP BY doc_id)
SELECT l.doc_id, l.leaf, u.d AS subroot, root.d AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.d AS folded_root, f.d = root.d AS verified
FROM leaf l JOIN sub u USING (tree) CROSS JOIN root JOIN last f USING (doc_id) LEFT JOIN path p USING (doc_id)
"""

"""Operator 6, exact dedup, in DataFrame functions only.

Equal texts are texts that are identical after ASCII white space is deleted. The work goes in three
steps, each comparing the whole normalised text besides its digest:

1. every map task combines its own equal texts (partial aggregation);
2. digests that hold at least one row in ``HOT_SHARE`` are dealt over ``salts`` groups and merged there;
3. the salt winners (at most ``salts`` rows for each of at most ``HOT_SHARE`` digests) are combined.

Digests below that share hold few rows and are combined in one step, so the text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_each, stored, table

#: A digest with at least 1/HOT_SHARE of the rows is hot, hence there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: ASCII white space, deleted before texts are compared.
SPACES = " \t\n\x0b\f\r"
#: Winner's key: length * RANK - doc_id; NONE stands for a null doc_id, which loses ties.
RANK, NONE = "100000000000000000000", "10000000000000000000"

_dec = lambda x: F.lit(x).cast("decimal(38,0)")


def _marks(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, SPACES, "")
    return {
        "id": F.col(id_col).cast("long"), "norm": norm, "len": F.char_length(text), "sha": F.unhex(F.sha2(norm.cast("binary"), 256)),
        "xx": F.xxhash64(norm), "nlen": F.octet_length(norm),
    }


def _decided(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per id, length and text: these, copies, n (rows of its group), keep_id and best (id and length of the row that stays)."""
    base = docs.select(*(c.alias(k) for k, c in _marks(id_col, text_col).items()))
    keys = ["sha", "xx", "nlen"]
    ids = stored(base.groupBy("id", "len", *keys).agg(F.count("*").alias("copies")))
    total = ids.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = stored(ids.groupBy(*keys).agg(F.sum("copies").alias("n")).where(F.col("n") >= max(2, total / HOT_SHARE)).select(*keys))
    few = F.broadcast(hot)  # at most HOT_SHARE rows of 44 bytes

    key = F.col("len").cast("decimal(38,0)") * _dec(RANK) - F.coalesce(F.col("id").cast("decimal(38,0)"), _dec(NONE))
    texts = base.withColumn("key", key.cast("decimal(38,0)"))
    cold = texts.join(few, keys, "left_anti").groupBy(*keys, "norm").agg(F.max("key").alias("key"), F.count("*").alias("n"))
    salted = (
        texts.join(few, keys, "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy(*keys, "norm", "salt").agg(F.max("key").alias("key"), F.count("*").alias("n"))
    )
    warm = salted.groupBy(*keys, "norm").agg(F.max("key").alias("key"), F.sum("n").alias("n"))
    # Texts that share sha256, xxhash64 and length but differ would meet here; that is refused, not guessed.
    single = lambda w: w.drop("norm").groupBy(*keys).agg(
        F.max("key").alias("key"), F.sum("n").alias("n"), F.count("*").alias("texts")
    ).withColumn("n", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("digest collision"))))

    out = (
        ids.join(few, keys, "left_anti").join(single(cold), keys)
        .unionByName(ids.join(few, keys, "left_semi").join(F.broadcast(single(warm)), keys))
    )
    back = _dec(NONE) - F.pmod(F.col("key") + _dec(NONE), _dec(RANK))
    keep = F.when(back != _dec(NONE), back.cast("long"))
    best = F.floor(((F.col("key") + _dec(NONE)) - F.pmod(F.col("key") + _dec(NONE), _dec(RANK))) / _dec(RANK)).cast("long")
    return out.withColumn("keep_id", keep).withColumn("best", best)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the most code points stays, then the smallest
    id; a null id loses ties. Rows repeated with the same id and text count in group_size, are all
    returned, and only one of them has kept = true. An empty table gives an empty result. Other columns
    are ignored.
    """
    out = _decided(docs, id_col, text_col, salts).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("best")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns (for pipelines): one of each group of equal texts.

    Rows are told apart by id and text, so rows that share an id each have their own verdict.
    """
    marks = _marks("doc_id", "text")
    won = _decided(docs, "doc_id", "text", 32).where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("best")))
    known = lambda id: {"id0": F.coalesce(id, F.lit(0).cast("long")), "none": id.isNull()}
    same = ["len", "sha", "xx", "nlen"]
    winners = stored(won.select(*(c.alias(k) for k, c in known(F.col("id")).items()), *same, "copies", F.lit(False).alias("every")))
    return one_each(docs, known(marks["id"]) | {k: marks[k] for k in same}, winners)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

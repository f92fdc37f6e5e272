"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="millrace-")
        shared_dir.own = found
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_each(docs: DataFrame, keys: dict[str, Column], winners: DataFrame, share: int = 1000) -> DataFrame:
    """The rows of ``docs``, with their columns, whose ``keys`` (never null) are those of a row of ``winners``.

    winners: the keys, each once, ``copies`` (how many rows of docs have them) and ``every``: whether all of
    these rows stay or only one, the smallest. Keys with at least 1/share of the rows are sent to the tasks
    (hence at most ``share`` of them) and never dealt by key.
    """
    names = list(keys)
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in keys.items()))
    bound = max(2.0, docs.count() / share)
    hot = winners.where(F.col("copies") >= bound)
    if hot.take(1):
        few = F.broadcast(hot)
        cold = rows.join(few.select(*names), names, "left_anti").join(winners.where(F.col("copies") < bound), names)
        both = cold.unionByName(rows.join(few, names))
    else:
        both = rows.join(winners, names)
    simple = both.where("every OR copies = 1").select("row.*")
    if not winners.where("copies > 1 AND NOT every").take(1):
        return simple
    return simple.unionByName(both.where("copies > 1 AND NOT every").groupBy(*names).agg(F.min("row").alias("row")).select("row.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (the folds of the contracts)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def split_words(text: str, lower: bool = False) -> list[bytes]:
    """Words of the contracts as UTF-8: runs of other than ASCII white space; A-Z lower-cased on request."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()

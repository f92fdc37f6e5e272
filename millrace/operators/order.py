"""What stages ask about the order of a run's lines, for runs that fit in a task and for runs that do not.

``Whole`` answers by windows over ``run_id``: one exchange for all of them. ``Segments`` cuts a run in segments
of some 100,000 lines (column ``seg``) and never has more than a segment of it, or of one key of it, in a task:
each question is answered within segments by a window, and across them by a table of one row for each segment
(and key), which is summed up in the order of segments and joined back. The frame is written between questions,
so that the table and the lines read the same rows and no plan holds more than one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import scans as Z

#: Segment of the rows after the end of a run.
NOTES = 2**40


class Whole:
    """Windows by run. ``by``: columns (or names) within whose equal values a question is asked."""

    def totals(self, df: DataFrame, asked: dict[str, tuple[str, Column]], *by) -> DataFrame:
        """Aggregates (function name, column) over all rows."""
        w = Window.partitionBy("run_id", *by)
        return df.withColumns({n: getattr(F, fn)(c).over(w) for n, (fn, c) in asked.items()})

    def running(self, df: DataFrame, asked: dict[str, Column], *by) -> DataFrame:
        """Sums over the rows up to a row and itself."""
        w = Window.partitionBy("run_id", *by).orderBy("pos")
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in asked.items()})

    def beside(self, df: DataFrame, asked: dict[str, tuple[Column, int]], *by) -> DataFrame:
        """The value of the row before (-1) or after (1)."""
        w = Window.partitionBy("run_id", *by).orderBy("pos")
        return df.withColumns({n: (F.lag if step < 0 else F.lead)(c).over(w) for n, (c, step) in asked.items()})

    def latest(self, df: DataFrame, asked: dict[str, Column], *by, own: bool = True) -> DataFrame:
        """The last value that is not null up to a row, with or without itself."""
        w = Window.partitionBy("run_id", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        return df.withColumns({n: F.last(c, True).over(w) for n, c in asked.items()})

    def soon(self, df: DataFrame, name: str, flag: Column, k: int, *by) -> DataFrame:
        """Whether the flag is set in one of the next k rows."""
        w = Window.partitionBy("run_id", *by).orderBy("pos").rowsBetween(1, k)
        return df.withColumn(name, F.coalesce(F.max(flag.cast("int")).over(w) == 1, F.lit(False)))

    def numbered(self, df: DataFrame, name: str, order: list[Column]) -> DataFrame:
        """Numbers from 1 in an order."""
        return df.withColumn(name, F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("long"))

    def scanned(self, df: DataFrame, rows: DataFrame, machine: Z.Blocks | Z.Tests, opens: Column) -> DataFrame:
        """``df`` with what ``scans.spread`` adds for the intervals of ``rows``."""
        return Z.spread(df, Z.intervals(rows, machine, opens))

    def settled(self, df: DataFrame) -> DataFrame:
        """After rows were added or moved."""
        return df


class Segments:
    """The same answers by segments of at most about ``size`` lines; frames have a column ``seg``."""

    def __init__(self, size: int):
        self.size = size

    def cut(self, df: DataFrame) -> DataFrame:
        return df.withColumn("seg", F.floor(F.col("src") / self.size).cast("long"))

    def settled(self, df: DataFrame) -> DataFrame:
        from .stages import END

        return df.withColumn("seg", F.when(F.col("pos") >= END, F.lit(NOTES)).otherwise(F.col("seg")))

    @staticmethod
    def _keys(df: DataFrame, by: tuple) -> tuple[DataFrame, list[str]]:
        """Columns to ask by, as columns of the frame."""
        names = [f"_by{i}" for i in range(len(by))]
        return df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, by, strict=True)}) if by else df, names

    @staticmethod
    def _local(by: list[str]) -> Window:
        return Window.partitionBy("run_id", "seg", *by).orderBy("pos")

    @staticmethod
    def _joined(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
        """``table`` has one row for each segment and key of ``df``."""
        keys = ["run_id", "seg", *by]
        table = table.withColumnsRenamed({k: f"{k}__t" for k in keys})
        same = [df[k].eqNullSafe(table[f"{k}__t"]) for k in keys]
        return df.join(table, same, "left").drop(*(f"{k}__t" for k in keys), *by)

    def totals(self, df: DataFrame, asked: dict[str, tuple[str, Column]], *by) -> DataFrame:
        df, by = self._keys(df, by)
        df = stored(df.withColumns({f"{n}__x": c for n, (_, c) in asked.items()}))
        table = df.groupBy("run_id", "seg", *by).agg(*[getattr(F, fn)(f"{n}__x").alias(n) for n, (fn, _) in asked.items()])
        w = Window.partitionBy("run_id", *by)
        up = {"count": "sum"}
        table = table.select("run_id", "seg", *by, *[getattr(F, up.get(fn, fn))(n).over(w).alias(n) for n, (fn, _) in asked.items()])
        return self._joined(df.drop(*(f"{n}__x" for n in asked)), table, by)

    def running(self, df: DataFrame, asked: dict[str, Column], *by) -> DataFrame:
        df, by = self._keys(df, by)
        df = df.withColumns({f"{n}__x": c for n, c in asked.items()})
        df = stored(df.withColumns({n: F.coalesce(F.sum(f"{n}__x").over(self._local(by)), F.lit(0)) for n in asked}))
        table = df.groupBy("run_id", "seg", *by).agg(*[F.sum(f"{n}__x").alias(f"{n}__o") for n in asked])
        w = Window.partitionBy("run_id", *by).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        table = table.select("run_id", "seg", *by, *[F.coalesce(F.sum(f"{n}__o").over(w), F.lit(0)).alias(f"{n}__o") for n in asked])
        out = self._joined(df.drop(*(f"{n}__x" for n in asked)), table, by)
        return out.withColumns({n: F.col(n) + F.col(f"{n}__o") for n in asked}).drop(*(f"{n}__o" for n in asked))

    def beside(self, df: DataFrame, asked: dict[str, tuple[Column, int]], *by) -> DataFrame:
        df, by = self._keys(df, by)
        df = df.withColumns({f"{n}__x": F.struct(c.alias("v")) for n, (c, _) in asked.items()})
        df = stored(df.withColumns({n: (F.lag if step < 0 else F.lead)(f"{n}__x").over(self._local(by)) for n, (_, step) in asked.items()}))
        ends = [(F.max_by if step < 0 else F.min_by)(f"{n}__x", "pos").alias(f"{n}__o") for n, (_, step) in asked.items()]
        w = Window.partitionBy("run_id", *by).orderBy("seg")
        table = df.groupBy("run_id", "seg", *by).agg(*ends)
        table = table.select("run_id", "seg", *by, *[(F.lag if step < 0 else F.lead)(f"{n}__o").over(w).alias(f"{n}__o") for n, (_, step) in asked.items()])
        out = self._joined(df.drop(*(f"{n}__x" for n in asked)), table, by)
        return out.withColumns({n: F.coalesce(n, f"{n}__o")["v"] for n in asked}).drop(*(f"{n}__o" for n in asked))

    def latest(self, df: DataFrame, asked: dict[str, Column], *by, own: bool = True) -> DataFrame:
        df, by = self._keys(df, by)
        local = self._local(by).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        df = df.withColumns({f"{n}__x": F.when(c.isNotNull(), F.struct(c.alias("v"))) for n, c in asked.items()})
        df = stored(df.withColumns({n: F.last(f"{n}__x", True).over(local) for n in asked}))
        table = df.groupBy("run_id", "seg", *by).agg(*[F.max_by(f"{n}__x", F.when(F.col(f"{n}__x").isNotNull(), F.col("pos"))).alias(f"{n}__o") for n in asked])
        w = Window.partitionBy("run_id", *by).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        table = table.select("run_id", "seg", *by, *[F.last(f"{n}__o", True).over(w).alias(f"{n}__o") for n in asked])
        out = self._joined(df.drop(*(f"{n}__x" for n in asked)), table, by)
        return out.withColumns({n: F.coalesce(n, f"{n}__o")["v"] for n in asked}).drop(*(f"{n}__o" for n in asked))

    def soon(self, df: DataFrame, name: str, flag: Column, k: int, *by) -> DataFrame:
        df, by = self._keys(df, by)
        near = self._local(by).rowsBetween(1, k)
        df = df.withColumn("__x", flag.cast("int"))
        df = stored(df.withColumns({name: F.max("__x").over(near), "__c": F.count("*").over(near), "__i": F.row_number().over(self._local(by))}))
        first = F.transform(F.array_sort(F.collect_list(F.when(F.col("__i") <= k, F.struct("__i", "__x")))), lambda x: x["__x"])
        table = df.groupBy("run_id", "seg", *by).agg(first.alias("__o"))  # k flags of a segment
        w = Window.partitionBy("run_id", *by).orderBy("seg").rowsBetween(1, k)
        table = table.select("run_id", "seg", *by, F.slice(F.flatten(F.collect_list("__o").over(w)), 1, k).alias("__o"))
        out = self._joined(df.drop("__x", "__i"), table, by)
        beyond = F.exists(F.slice("__o", F.lit(1), (F.lit(k) - F.col("__c")).cast("int")), lambda x: x == 1)
        return out.withColumn(name, (F.coalesce(name, F.lit(0)) == 1) | F.coalesce(beyond, F.lit(False))).drop("__c", "__o")

    def numbered(self, df: DataFrame, name: str, order: list[Column]) -> DataFrame:
        """By one range exchange: a row's place in its sorted partition and the rows of the run in earlier ones. Cuts anew."""
        spread = df.repartitionByRange("run_id", *order).sortWithinPartitions("run_id", *order)
        spread = stored(spread.withColumn("__at", F.monotonically_increasing_id()))
        part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
        spread = spread.withColumns({"__part": part, "__place": place}).drop("__at")
        counts = spread.groupBy("__part", "run_id").agg(F.count("*").alias("__k"), F.min("__place").alias("__low"))
        before = F.coalesce(F.sum("__k").over(Window.partitionBy("run_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select("__part", "run_id", (before - F.col("__low") + 1).alias("__start"))
        out = spread.join(starts, ["__part", "run_id"]).withColumn(name, F.col("__place") + F.col("__start"))
        return out.withColumn("seg", F.floor(F.col(name) / self.size).cast("long")).drop("__part", "__place", "__start")

    def scanned(self, df: DataFrame, rows: DataFrame, machine: Z.Blocks | Z.Tests, opens: Column) -> DataFrame:
        rows = stored(rows.withColumn("__opens", opens))
        depths = rows.groupBy("run_id").agg(F.max("__opens").alias("__some"), F.collect_set(F.when(F.col("__opens"), F.col("indent"))).alias("depths")).where("__some").drop("__some")
        rows = rows.drop("__opens").join(F.broadcast(depths), "run_id")  # runs that are cut are few
        entries = Z.entries(rows, machine)
        hits = stored(Z.segment_intervals(rows.drop("depths").join(entries, ["run_id", "seg"], "left"), machine))
        df = stored(df)
        place = Window.partitionBy("run_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        ends = df.groupBy("run_id", "seg").agg(F.max("pos").alias("__last")).withColumn("__end", F.max("__last").over(Window.partitionBy("run_id")))
        sums = hits.groupBy("run_id", "seg").agg(F.count_if("new").alias("__no"), F.sum("n").alias("__sum"))
        table = ends.drop("__last").join(sums, ["run_id", "seg"], "left").select(
            "run_id", "seg", "__end", F.coalesce(F.sum("__no").over(place), F.lit(0)).alias("__no"), F.coalesce(F.sum("__sum").over(place), F.lit(0)).alias("__sum"),
        )
        both = df.unionByName(hits.select("run_id", "seg", F.col("lo").alias("pos"), F.struct("hi", "n", "new").alias("_hit")), allowMissingColumns=True)
        w = Window.partitionBy("run_id", "seg").orderBy("pos", F.col("_hit").isNull())
        both = both.withColumns({"_hi": F.last("_hit.hi", True).over(w), "_no": F.count_if("_hit.new").over(w), "_sum": F.coalesce(F.sum("_hit.n").over(w), F.lit(0))})
        out = self._joined(both.where("_hit IS NULL").drop("_hit"), table, [])
        return out.withColumns({"_no": F.col("_no") + F.col("__no"), "_sum": F.col("_sum") + F.col("__sum"), "_end": F.col("pos") == F.col("__end")}).drop("__no", "__sum", "__end")


WHOLE = Whole()

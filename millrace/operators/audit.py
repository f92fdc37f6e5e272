"""Audits that nothing needed was lost: each gives the violations, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import patterns as P
from . import scans as Z

#: Headers of failures as the audits see them, on purpose not those that compaction looks for (fixed values).
AUDIT_HEADER = r"^\s*\d+\)\s|^\s*●|^\s*not ok \d+|AssertionError|^\s*--- FAIL:|^\s*Traceback \(most recent call last\)"


def _shown(text: Column) -> Column:
    """A line without what may be taken off it: escapes, redraws, the end of a line."""
    return L.resolve_redraw(L.strip_ansi(L.normalize_eol(text)))


def _nth(df: DataFrame, order: str) -> DataFrame:
    """``nth``: which of the run's lines of this text a line is."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "text").orderBy(order)))


def failures_survive(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """A1: failure lines of the input that the output lacks, or holds out of order.

    kept: with ``src_line_no`` by lineage; without it (the output of another tool) the n-th failure line of a text
    in the input is the n-th of that text in the output, and each must stand after all that came before it.
    """
    clean = _shown(F.col("text"))
    need = lines.where(L.is_failure(clean)).select("run_id", "line_no", "text")
    if "src_line_no" not in kept.columns:
        return _survive_by_text(need.withColumn("text", clean), kept.select("run_id", "out_no", clean.alias("text")).where(L.is_failure(F.col("text"))))
    out = kept.where("src_line_no IS NOT NULL").select("run_id", F.col("src_line_no").alias("line_no"), "out_no")
    lost = need.join(out, ["run_id", "line_no"], "left_anti").withColumn("problem", F.lit("missing"))
    both = need.join(out, ["run_id", "line_no"])
    back = F.lag("out_no").over(Window.partitionBy("run_id").orderBy("line_no")) >= F.col("out_no")
    return lost.unionByName(both.withColumn("_b", back).where("_b").drop("_b", "out_no").withColumn("problem", F.lit("out of order")))


def _survive_by_text(need: DataFrame, have: DataFrame) -> DataFrame:
    both = _nth(need, "line_no").join(_nth(have, "out_no"), ["run_id", "text", "nth"], "left")
    above = F.max("out_no").over(Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    problem = F.when(F.col("out_no").isNull(), "missing").when(F.col("out_no") < F.col("_above"), "out of order")
    return both.withColumn("_above", above).select("run_id", "line_no", "text", problem.alias("problem")).where("problem IS NOT NULL")


def silent_gaps(lines: DataFrame, kept: DataFrame, prefix: str = "[millrace]") -> DataFrame:
    """A2 for outputs without lineage: failure blocks that break off in the output without a marker there.

    A block is a header (``AUDIT_HEADER``) and the deeper lines below it, blank ones where a deeper line follows. The
    n-th line of a header's text in the output is where the block of the n-th in the input must go on line by line,
    markers aside. Gives run_id, header_no, line_no and text of the first line that fails; blocks whose
    header is not in the output are the business of A1. kept: run_id, out_no, text.
    """
    t = F.col("text")
    w = Window.partitionBy("run_id").orderBy("line_no")
    base = lines.select("run_id", "line_no", _shown(t).alias("text")).withColumns({"_head": t.rlike(P.java(AUDIT_HEADER)), "_i": L.indent_of(t)})
    base = base.withColumn("_i", F.when(L.is_blank(t), F.coalesce(F.lead("_i").over(w), F.lit(-1))).otherwise(F.col("_i")))
    rows = base.select("run_id", F.col("line_no").alias("pos"), F.when(F.col("_head"), Z.Blocks.OPENS).otherwise(0).alias("bits"), F.col("_i").alias("indent"))
    hits = Z.intervals(rows, Z.Blocks(), F.col("bits") > 0).where("n > 1")
    inside = Z.spread(base.withColumn("pos", F.col("line_no")), hits).where("pos <= _hi")
    first = Window.partitionBy("run_id", "_no")
    inside = inside.withColumns({"header_no": F.min("line_no").over(first), "j": F.row_number().over(first.orderBy("line_no")) - 1})
    heads = _nth(base.where("_head").select("run_id", "text", F.col("line_no").alias("header_no")), "header_no")
    out = kept.select("run_id", "out_no", _shown(t).alias("text"))
    mark = L.is_marker(t, prefix)
    place = Window.partitionBy("run_id").orderBy("out_no")
    out = out.withColumns({"_m": F.sum((~mark).cast("long")).over(place), "_mark": mark, "_last": F.max("out_no").over(Window.partitionBy("run_id"))})
    shown = out.where("NOT _mark").withColumn("_after", F.lag("out_no").over(place))
    starts = _nth(shown.where(t.rlike(P.java(AUDIT_HEADER))).select("run_id", "text", "out_no", "_m", "_last"), "out_no")
    starts = heads.join(starts.select("run_id", "text", "nth", "_m", "_last"), ["run_id", "text", "nth"]).select("run_id", "header_no", F.col("_m").alias("_m0"), "_last")
    ends = shown.select("run_id", "_m", F.col("out_no").alias("_out"), F.col("text").alias("_text"), "_after")
    lined = inside.join(starts, ["run_id", "header_no"]).withColumn("_m", F.col("_m0") + F.col("j")).join(ends, ["run_id", "_m"], "left")
    wrong = lined.where(~F.col("text").eqNullSafe(F.col("_text")))
    wrong = wrong.withColumn("_nth", F.row_number().over(Window.partitionBy("run_id", "header_no").orderBy("j"))).where("_nth = 1")
    # At the end of the output the line before is the last one that is no marker.
    last = shown.groupBy("run_id").agg(F.max("out_no").alias("_fin"))
    wrong = wrong.join(last, "run_id", "left")
    marked = F.when(F.col("_out").isNull(), F.col("_last") > F.col("_fin")).otherwise(F.col("_out") > F.col("_after") + 1)
    return wrong.where(~F.coalesce(marked, F.lit(False))).select("run_id", "header_no", "line_no", "text")


def block_gaps(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """A2: gaps inside simple failure blocks (a header and deeper indented lines) without a marker in between."""
    t = F.col("text")
    w = Window.partitionBy("run_id").orderBy("line_no")
    base = lines.withColumn("_i", L.indent_of(t)).withColumn("_h", F.when(L.is_block_start(t) & ~L.is_block_end(t), F.col("line_no")))
    base = base.withColumn("_head", F.last("_h", True).over(w))
    depth = F.first("_i").over(Window.partitionBy("run_id", "_head").orderBy("line_no"))
    shallow = F.coalesce(F.max(((F.col("line_no") > F.col("_head")) & (F.col("_i") <= F.col("_d"))).cast("int")).over(Window.partitionBy("run_id", "_head").orderBy("line_no")), F.lit(0))
    blocks = base.where("_head IS NOT NULL").withColumn("_d", depth).withColumn("_s", shallow).where("_s = 0").select("run_id", "line_no", "_head")
    out = kept.withColumn("_m", F.sum(F.col("is_marker").cast("long")).over(Window.partitionBy("run_id").orderBy("out_no")))
    have = blocks.join(out.where("src_line_no IS NOT NULL").select("run_id", F.col("src_line_no").alias("line_no"), "_m"), ["run_id", "line_no"])
    b = Window.partitionBy("run_id", "_head").orderBy("line_no")
    have = have.withColumn("after_line", F.lag("line_no").over(b)).withColumn("_p", F.lag("_m").over(b))
    return have.where("line_no > after_line + 1 AND _m = _p").select("run_id", "after_line", F.col("line_no").alias("before_line"))


def never_grows(stats: DataFrame) -> DataFrame:
    """A3: runs whose output is larger than their input."""
    return stats.where("bytes_out > raw_bytes").select("run_id", "raw_bytes", "bytes_out")


def queries_complete(lines: DataFrame, kept: DataFrame, runs: DataFrame) -> DataFrame:
    """A4: lines of query runs that the output lacks.

    Compared by what compaction compares: the text without escapes and redraws, log lines and progress by shape
    (of a pair of equal shape the first text is shown twice). Repeats aside.
    """

    def shapes(df: DataFrame) -> DataFrame:
        t = _shown(F.col("text"))
        return df.select("run_id", t.alias("text")).select("run_id", F.when(L.is_progress(F.col("text")), L.similarity_key(F.col("text"))).otherwise(L.dedup_key(F.col("text"))).alias("shape"), "text")

    query = lines.join(runs.where("kind = 'query'").select("run_id"), "run_id", "left_semi")
    return shapes(query).groupBy("run_id", "shape").agg(F.min("text").alias("text")).join(shapes(kept), ["run_id", "shape"], "left_anti").select("run_id", "text")


def multiset(lines: DataFrame, kept: DataFrame, pattern: str = r"^\s*[-+]") -> DataFrame:
    """A5: matching lines that occur less often in the output than in the input."""
    count = lambda df: df.where(F.col("text").rlike(P.java(pattern))).groupBy("run_id", "text").agg(F.count("*").alias("n"))
    had, has = count(lines).withColumnRenamed("n", "n_in"), count(kept).withColumnRenamed("n", "n_out")
    out = had.join(has, ["run_id", "text"], "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))
    return out.where("n_out < n_in")


def must_keep(kept: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (run_id, needle) whose text no line of the run holds."""
    joined = rules.join(kept.select("run_id", "text"), "run_id", "left")
    found = joined.groupBy("run_id", "needle").agg(F.coalesce(F.bool_or(F.contains("text", "needle")), F.lit(False)).alias("found"))
    return found.where("NOT found").drop("found")


def savings_floor(stats: DataFrame, floors: DataFrame) -> DataFrame:
    """Runs that saved a smaller share than their floor (run_id, min_saving)."""
    share = F.when(F.col("raw_bytes") > 0, 1.0 - F.col("bytes_out") / F.col("raw_bytes")).otherwise(0.0)
    return stats.join(floors, "run_id").withColumn("saving", share).where("saving < min_saving").select("run_id", "saving", "min_saving")


def no_escapes(kept: DataFrame) -> DataFrame:
    """Output lines that hold an escape or a carriage return."""
    return kept.where(F.contains("text", F.lit("\x1b")) | F.contains("text", F.lit("\r"))).select("run_id", "out_no", "text")


def block_equality(lines: DataFrame, kept: DataFrame, header: str = r"^\s*\d+\)\s") -> DataFrame:
    """Failure blocks, numbered within a run, that differ but for markers and trailing blanks."""

    def blocks(df: DataFrame, order: str) -> DataFrame:
        is_head = F.col("text").rlike(P.java(header))
        n = F.sum(is_head.cast("long")).over(Window.partitionBy("run_id").orderBy(order))
        body = df.withColumn("block_no", n).where("block_no > 0")
        body = body.groupBy("run_id", "block_no").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("_l"))
        return body.withColumn("body", F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["text"]), "\n"), r"\s+\z", "")).drop("_l")

    a = blocks(lines, "line_no").withColumnRenamed("body", "expected")
    b = blocks(kept.where("NOT is_marker"), "out_no").withColumnRenamed("body", "got")
    return a.join(b, ["run_id", "block_no"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("got")))


def diff_outputs(expected: DataFrame, got: DataFrame, limit: int = 0) -> DataFrame:
    """A10: lines that differ by position; limit > 0 gives the first ones only."""
    a = expected.select("run_id", "out_no", F.col("text").alias("expected"))
    b = got.select("run_id", "out_no", F.col("text").alias("got"))
    out = a.join(b, ["run_id", "out_no"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("got"))).orderBy("run_id", "out_no")
    return out.limit(limit) if limit > 0 else out

"""Ledger analytics: totals, savings by command, top commands, the report."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.commands import command_key
from .order import Segments

_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def entry_saved(raw: Column, out: Column) -> Column:
    return F.greatest(F.lit(0), raw - out)


def parse_since(text: str, now: datetime) -> datetime | None:
    """``7d``, ``2w``, ``12h``, ``1h30m``: the cutoff; None for none. ValueError for anything else."""
    text = text.strip()
    if not text:
        return None
    if m := re.fullmatch(r"\+?(\d+)([dw])", text):
        return now - timedelta(days=int(m[1]) * (7 if m[2] == "w" else 1))
    if m := re.fullmatch(r"([+-]?)((?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|ms|s|m|h))+|0)", text):
        total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", m[2]))
        return now - timedelta(seconds=-total if m[1] == "-" else total)
    raise ValueError(f"invalid duration {text!r} (try 7d, 12h or 30m)")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """One row; the saving is that of the totals, not below 0."""
    filtered = F.count_if(F.coalesce(F.size("filters"), F.lit(0)) > 0)
    g = ledger.agg(
        F.count("*").alias("runs"), filtered.alias("filtered_runs"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("out_bytes"), F.lit(0)).alias("out_bytes")
    )
    g = g.withColumn("passed_through", F.col("runs") - F.col("filtered_runs")).withColumn("saved", entry_saved(F.col("raw_bytes"), F.col("out_bytes")))
    g = g.withColumn("pct", F.when(F.col("raw_bytes") > 0, 100.0 * F.col("saved") / F.col("raw_bytes")).otherwise(0.0))
    return g.withColumns({f"tokens_{c}": L.tokens_of_bytes(F.col(c)) for c in ("raw_bytes", "out_bytes", "saved")})


def savings_by_command(ledger: DataFrame) -> DataFrame:
    # Summed by command first, so that the key is worked out once for each distinct command.
    g = ledger.groupBy("command").agg(F.count("*").alias("runs"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("out_bytes").alias("out_bytes"))
    g = g.groupBy(command_key(F.col("command")).alias("command_key")).agg(*[F.sum(c).alias(c) for c in ("runs", "raw_bytes", "out_bytes")])
    g = g.withColumn("saved", entry_saved(F.col("raw_bytes"), F.col("out_bytes")))
    return g.withColumn("pct", F.when(F.col("raw_bytes") > 0, 100.0 * F.col("saved") / F.col("raw_bytes")).otherwise(0.0))


def top_commands(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Most saved first, then by name; n <= 0 gives all."""
    out = savings_by_command(ledger).orderBy(F.desc("saved"), "command_key")
    return out.limit(n) if n > 0 else out


def report(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Formatted rows of the top commands; one row that says so for an empty ledger. All keys (n <= 0) are ranked by a
    range exchange, so no task has more than its share of them."""
    top = top_commands(ledger, n)
    order = [F.desc("saved"), F.col("command_key")]
    if n > 0:
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        top = Segments(1_000_000).numbered(savings_by_command(ledger).withColumn("run_id", F.lit(0)), "rank", order)
    name = F.when(F.octet_length("command_key") > 40, F.concat(L._cut(F.col("command_key"), 39), F.lit("…"))).otherwise(F.col("command_key"))
    line = F.format_string("%-40s  %4d %-4s  %9s saved  (%.0f%%)", name, "runs", L.plural(F.col("runs"), "run"), L.human_bytes(F.col("saved")), "pct")
    empty = ledger.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("rank"), F.lit("No runs recorded.").alias("line"))
    return top.select(F.col("rank").cast("int").alias("rank"), line.alias("line")).unionByName(empty)

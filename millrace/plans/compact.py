"""The compaction plan: classify, clean, protect, drop, collapse, truncate, and decide which form is smaller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.commands import classify_kind, decided_values
from ..operators import stages as S
from ..operators.order import WHOLE, Segments, Whole
from ..sources.tables import stored
from .config import Config

#: Stages in order: name, the kinds they serve (None: all), function of frame, options, whether it is active, and order.
STAGES: list[tuple[str, tuple[str, ...] | None, Callable]] = [
    ("ansi", None, lambda df, cfg, on, w: S.collapse_progress(df, on, w)),
    ("guard", None, S.guard),
    ("node-install", ("node-install", "node-script"), S.drop_install_noise),
    ("test-runner", ("node-script",), lambda df, cfg, on, w: S.drop_passing_tests(S.detect_test_output(df, on, w), cfg, F.col("detected"), w).drop("detected")),
    ("docker-build", ("docker-build",), S.docker_steps),
    ("dotnet", ("dotnet",), S.drop_dotnet_noise),
    ("dedup", None, lambda df, cfg, on, w: S.dedup(df, cfg, on, F.col("kind") != "query", w)),
    ("truncate", ("node-install", "node-script", "docker-build", "dotnet", "generic"), S.head_tail),
]


def register_stage(name: str, kinds: tuple[str, ...] | None, fn: Callable[[DataFrame, Config, Column], DataFrame], before: str = "dedup") -> None:
    """Adds a stage fn(df, cfg, active) ahead of another; Config.off switches it by name."""
    at = next(i for i, s in enumerate(STAGES) if s[0] == before)
    STAGES.insert(at, (name, kinds, lambda df, cfg, on, w: fn(df, cfg, on)))


def passthrough(lines: DataFrame, cfg: Config = Config()) -> DataFrame:
    """run_id, raw_lines, raw_bytes, small (such runs are left as they are)."""
    out = lines.groupBy("run_id").agg(F.count("*").alias("raw_lines"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("raw_bytes"))
    return out.withColumn("small", (F.col("raw_lines") <= cfg.passthrough_lines) & (F.col("raw_bytes") <= cfg.passthrough_bytes))


def staged(lines: DataFrame, runs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every line with what became of it: the working frame after all stages, and the decision of its run.

    lines: run_id, line_no, text; runs: run_id, argv. A run without argv is generic. Adds raw_text, kind,
    small, raw_lines, raw_bytes, lines_out, bytes_out, changed, use_raw.

    The frame is written after the line features, and after the stages of ``Config.cuts``; each part between two
    writes deals the lines by run once, and its windows share that exchange. Runs of more than ``Config.segment``
    lines go the same way by segments (see ``order``), in which no task has more than a segment. Calling this
    runs those jobs.
    """
    kinds, present = decided_values(runs.select("run_id", "argv"), "argv", "kind", F.coalesce(classify_kind(F.col("argv")), F.lit("generic")))
    kinds, present = kinds.select("run_id", "kind"), present | {"generic"}  # stages of other kinds are left out
    if cfg.segment <= 0:
        return _through(lines, kinds, present, cfg, WHOLE)
    giants = stored(lines.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > cfg.segment).select("run_id"))
    if not giants.take(1):
        return _through(lines, kinds, present, cfg, WHOLE)
    few = F.broadcast(giants)  # at most one for each segment's worth of lines
    usual = _through(lines.join(few, "run_id", "left_anti"), kinds, present, cfg, WHOLE)
    cut = _through(lines.join(few, "run_id", "left_semi"), kinds.join(few, "run_id", "left_semi"), present, cfg, Segments(cfg.segment))
    return usual.unionByName(cut.drop("seg"))


def _through(lines: DataFrame, kinds: DataFrame, present: set[str], cfg: Config, w: Whole | Segments) -> DataFrame:
    df = S.start(lines.select("run_id", "line_no", "text", F.coalesce("text", F.lit("")).alias("raw_text")))
    df = w.cut(df) if isinstance(w, Segments) else df
    df = df.join(kinds, "run_id", "left").withColumns({"kind": F.coalesce("kind", F.lit("generic")), "text": L.normalize_eol(F.col("text"))})
    df = w.totals(df, {"raw_lines": ("count", F.lit(1)), "raw_bytes": ("sum", F.octet_length("raw_text") + 1)})
    small = (F.col("raw_lines") <= cfg.passthrough_lines) & (F.col("raw_bytes") <= cfg.passthrough_bytes) & F.lit(not cfg.always_filter)
    df = df.withColumns({"small": small | F.lit(not cfg.enabled), "clean_bytes": F.octet_length("text") + 1})
    for name, kinds_, fn in STAGES:
        if kinds_ and not present & set(kinds_):
            continue
        if name == "guard":
            df = stored(S.featured(df.withColumn("rewritten", F.col("text") != L.normalize_eol(F.col("raw_text")))))
        if name == "guard" or cfg.on(name):  # protection can't be switched off
            on = ~F.col("small") & (F.col("kind").isin(*kinds_) if kinds_ else F.lit(True))
            df = fn(df, cfg, on, w)
        if name in cfg.cuts:
            df = stored(df)
    df = df.drop("_f", "_indent")
    alive = F.col("dropped_by").isNull()
    df = df.withColumn("rewritten", F.col("rewritten") & ~F.col("marker"))
    df = w.totals(df, {
        "lines_out": ("sum", alive.cast("long")), "bytes_out": ("sum", F.when(alive, F.octet_length("text") + 1).otherwise(0)),
        "changed": ("max", ~alive | F.col("rewritten") | F.col("marker")),
    }).withColumn("lines_in", F.col("raw_lines"))
    footer = F.when(F.lit(cfg.footer) & F.col("changed"), F.octet_length(_footer(cfg)) + 1).otherwise(0)
    raw = (F.col("raw_bytes") <= cfg.decision_bytes) & (F.col("bytes_out") + footer >= F.col("raw_bytes"))
    return df.withColumn("use_raw", F.col("small") | raw)


def _footer(cfg: Config) -> Column:
    gone = F.col("raw_lines") - F.col("lines_out")
    what = F.when(gone > 0, F.concat(gone.cast("string"), F.lit(" lines elided"))).otherwise("output rewritten")
    return F.concat(F.lit(f"{cfg.prefix} "), what, F.lit(" — full output: run "), F.col("run_id").cast("string"))


def kept_lines(done: DataFrame, cfg: Config = Config()) -> DataFrame:
    """run_id, out_no, src_line_no, text, is_marker, protected, footer last. With ``Config.segment``, lines are
    numbered by a range exchange in place of a window by run."""
    source = F.col("use_raw") & F.col("src").isNotNull()
    chosen = done.where(source | (~F.col("use_raw") & F.col("dropped_by").isNull()))
    w = Segments(cfg.segment) if cfg.segment > 0 else WHOLE
    chosen = w.numbered(chosen, "out_no", [F.when(F.col("use_raw"), F.col("src")).otherwise(F.col("pos"))])
    last = F.col("out_no") == F.when(F.col("use_raw"), F.col("raw_lines")).otherwise(F.col("lines_out"))
    row = lambda n, src, t, m, p: F.struct(n.alias("out_no"), src.alias("src_line_no"), t.alias("text"), m.alias("is_marker"), p.alias("protected"))
    own = row(F.col("out_no"), F.col("src"), F.when(F.col("use_raw"), F.col("raw_text")).otherwise(F.col("text")), F.col("marker"), F.col("protected"))
    foot = row(F.col("out_no") + 1, F.lit(None).cast("long"), _footer(cfg), F.lit(True), F.lit(False))
    add = F.lit(cfg.footer) & last & ~F.col("use_raw") & F.col("changed")
    return chosen.select("run_id", F.explode(F.array_compact(F.array(own, F.when(add, foot)))).alias("x")).select("run_id", "x.*")


def elided(done: DataFrame) -> DataFrame:
    """What was removed, with the stage that did it."""
    gone = ~F.col("use_raw") & F.col("dropped_by").isNotNull() & F.col("src").isNotNull()
    return done.where(gone).select("run_id", F.col("src").alias("line_no"), F.col("raw_text").alias("text"), F.col("dropped_by").alias("stage"))


def run_stats(done: DataFrame) -> DataFrame:
    """One row per run: lines and bytes in and out, whether it was filtered, and by which stages."""
    names = [name for name, _, _ in STAGES]
    hit = {n: F.max((F.col("dropped_by") == n) | (F.col("rewritten") if n == "ansi" else F.lit(False))) for n in names}
    g = done.groupBy("run_id").agg(
        F.first("kind").alias("kind"), F.first("use_raw").alias("use_raw"), F.first("raw_lines").alias("lines_in"), F.first("raw_bytes").alias("raw_bytes"),
        F.sum(F.when(F.col("src").isNotNull(), F.col("clean_bytes")).otherwise(0)).alias("clean_bytes"),
        F.first("lines_out").alias("n_out"), F.first("bytes_out").alias("b_out"), *[F.coalesce(h, F.lit(False)).alias(f"_{i}") for i, h in enumerate(hit.values())],
    )
    used = ~F.col("use_raw")
    filters = F.array_compact(F.array(*[F.when(used & F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(hit)]))
    return g.select(
        "run_id", "kind", "lines_in", F.when(used, F.col("n_out")).otherwise(F.col("lines_in")).alias("lines_out"),
        F.when(used, F.col("clean_bytes")).otherwise(F.col("raw_bytes")).alias("bytes_in"), F.when(used, F.col("b_out")).otherwise(F.col("raw_bytes")).alias("bytes_out"),
        "raw_bytes", used.alias("filtered"), filters.alias("filters"),
    )


def savings_line(stats: DataFrame) -> DataFrame:
    """run_id and one line that says what was saved."""
    pct = F.when(F.col("bytes_in") > 0, F.greatest(F.lit(0.0), 100.0 * (F.col("bytes_in") - F.col("bytes_out")) / F.col("bytes_in"))).otherwise(0.0)
    tokens = lambda c: L.thousands(L.tokens_of_bytes(F.col(c)))
    # Halves go to the even number; %.0f of the engine would round them up.
    text = F.format_string("%d -> %d lines, ~%s -> ~%s tok (-%.0f%%)", "lines_in", "lines_out", tokens("bytes_in"), tokens("bytes_out"), F.rint(pct))
    return stats.select("run_id", text.alias("line"))


def compact(lines: DataFrame, runs: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """kept_lines, elided, run_stats. Write ``staged`` first where all three are needed at scale."""
    done = staged(lines, runs, cfg)
    return kept_lines(done, cfg), elided(done), run_stats(done)

"""Ordered stages over lines: windows and gaps-and-islands, each partitioned by ``run_id``.

A stage takes and returns the working frame of ``start``: run_id, pos (order within a run; unique, with room
for markers between lines, see ``dense``), src (line number, null for markers), text, protected, in_block, dropped_by (null while a line is alive) and marker, besides
columns it does not know. Dropped lines stay in the frame, so everything that goes can be shown. Markers are
added by exploding a row, so the partitioning by run stays and all stages share one exchange. The two stages
that scan (failure blocks, passing tests) add intervals by a union ahead of that exchange, and read narrow
rows on the side (see ``scans``). ``active`` limits a stage to some runs.

What a stage asks about the order of lines it asks of ``w`` (see ``order``): of windows by run, or of segments.

``featured`` works out once what the text of a line is; stages use its bits where the frame has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import patterns as P
from ..plans.config import Config
from . import scans as Z
from .order import WHOLE, Segments, Whole

COLUMNS = ("run_id", "pos", "src", "text", "protected", "in_block", "dropped_by", "marker")
#: Lines stand STEP apart. A stage puts its markers at an offset of its own from a line, smaller than those of the
#: stages before it, so positions stay unique without numbering anew; notes at the end of a run follow END, stage by stage.
STEP, END, _NOTES = 4096, 2**61, 2**54
#: Bits of ``_f``.
BLANK, HEADER, ENDS, DETAIL, FAIL, NEED = 1, 2, 4, 8, 16, 32


def _features(t: Column) -> Column:
    bit = lambda c, b: F.when(c, b).otherwise(0)
    fail = F.when(L.is_failure(t), F.lit(FAIL) + bit(~L._is(t, P.SELF_CONTAINED), NEED)).otherwise(0)
    return bit(L.is_blank(t), BLANK) + bit(L.is_block_start(t), HEADER) + bit(L.is_block_end(t), ENDS) + bit(L.is_failure_detail(t), DETAIL) + fail


def featured(df: DataFrame) -> DataFrame:
    """``df`` with ``_f``, bits of what the text of a line is, and ``_indent``."""
    return df if "_f" in df.columns else df.withColumns({"_f": _features(F.col("text")), "_indent": L.indent_of(F.col("text"))})


def _has(df: DataFrame, bit: int) -> Column:
    if "_f" in df.columns:
        return F.col("_f").bitwiseAND(bit) != 0
    return {BLANK: L.is_blank, HEADER: L.is_block_start, ENDS: L.is_block_end, DETAIL: L.is_failure_detail, FAIL: L.is_failure, NEED: L.needs_context}[bit](F.col("text"))


def start(lines: DataFrame) -> DataFrame:
    """The working frame from run_id, line_no, text (null text counts as empty)."""
    known = [c for c in lines.columns if c not in ("run_id", "line_no", "text")]
    return lines.select(
        "run_id", (F.col("line_no").cast("long") * STEP).alias("pos"), F.col("line_no").cast("long").alias("src"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(False).alias("protected"), F.lit(False).alias("in_block"), F.lit(None).cast("string").alias("dropped_by"), F.lit(False).alias("marker"), *known,
    )


def _alive() -> Column:
    return F.col("dropped_by").isNull()


def _segment(df: DataFrame) -> list[str]:
    return ["seg"] if "seg" in df.columns else []


def _drop(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return df.withColumn("dropped_by", F.when(_alive() & condition, F.lit(name)).otherwise(F.col("dropped_by")))


def dense(df: DataFrame) -> DataFrame:
    """``df`` with pos as row numbers within a run."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")).cast("long"))


def _mark(df: DataFrame, *marks: tuple[Column, Column, int, Column]) -> DataFrame:
    """Adds marker rows (condition, anchor, offset, text), which stand at anchor + offset."""
    own = F.struct(F.col("pos").alias("p"), F.col("text").alias("t"), F.lit(False).alias("m"))
    new = [F.when(c, F.struct((a + b).cast("long").alias("p"), t.alias("t"), F.lit(True).alias("m"))) for c, a, b, t in marks]
    df = df.withColumn("_x", F.explode(F.array_compact(F.array(own, *new))))
    fresh = F.col("_x.m")
    features = [F.when(fresh, _features(F.col("_x.t"))).otherwise(F.col("_f")).alias("_f"), F.when(fresh, L.indent_of(F.col("_x.t"))).otherwise(F.col("_indent")).alias("_indent")]
    return df.select(
        "run_id", F.col("_x.p").alias("pos"), F.when(~fresh, F.col("src")).alias("src"), F.col("_x.t").alias("text"),
        (F.col("protected") & ~fresh).alias("protected"), (F.col("in_block") & ~fresh).alias("in_block"),
        F.when(~fresh, F.col("dropped_by")).alias("dropped_by"), (F.col("marker") | fresh).alias("marker"),
        *[c for c in df.columns if c not in (*COLUMNS, "_x", "_f", "_indent")], *(features if "_f" in df.columns else []),
    )


def collapse_progress(df: DataFrame, active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """Cleans the text; of consecutive progress lines of one shape the last stays."""
    active = F.lit(True) if active is None else active
    df = df.withColumn("text", F.when(active & _alive(), L.resolve_redraw(L.strip_ansi(F.col("text")))).otherwise(F.col("text")))
    df = df.withColumn("_k", F.when(L.is_progress(F.col("text")), L.similarity_key(F.col("text"))))
    df = w.beside(df, {"_next": (F.col("_k"), 1)}, _alive())
    return _drop(df, "ansi", active & (F.col("_k") == F.col("_next"))).drop("_k", "_next")


def failure_blocks(df: DataFrame, active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """``block``, the number of the failure block of a line, null outside.

    A block opens at a header that is no summary; it goes on over blank lines, deeper indents, and failure
    lines or details that are no header; a line that ends it may open the next. Only flags of runs that hold
    a header go through the scan.
    """
    active = F.lit(True) if active is None else active
    own = featured(df)
    has = lambda *bits: F.col("_f").bitwiseAND(sum(bits)) != 0
    bit = lambda c, b: F.when(c, b).otherwise(0)
    m = Z.Blocks
    bits = bit(has(BLANK), m.BLANK) + bit(active & has(HEADER) & ~has(ENDS), m.OPENS) + bit(has(HEADER), m.HEADER) + bit(has(ENDS), m.ENDS) + bit(has(DETAIL, FAIL), m.DETAIL)
    rows = own.where(_alive()).select("run_id", "pos", *_segment(df), bits.alias("bits"), F.col("_indent").alias("indent"))
    out = w.scanned(df, rows, m(), F.col("bits").bitwiseAND(m.OPENS) != 0)
    return out.withColumn("block", F.when(_alive() & (F.col("pos") <= F.col("_hi")), F.col("_no"))).drop("_hi", "_no", "_sum", "_end")


def cap_blocks(df: DataFrame, cfg: Config = Config(), w: Whole | Segments = WHOLE) -> DataFrame:
    """Marks block lines protected and caps a block; needs ``block``. Adds ``region``."""
    inside, blank = _alive() & F.col("block").isNotNull(), _has(df, BLANK)
    df = w.totals(df.withColumn("region", inside), {"_last": ("max", F.when(inside & ~blank, F.col("pos")))}, "block")
    df = w.running(df, {"_n": F.lit(1)}, "block")
    body = F.col("region") & (F.col("pos") <= F.col("_last"))
    df = df.withColumn("_over", F.coalesce(body & ~blank & (F.col("_n") > cfg.max_block), F.lit(False)))
    df = w.totals(df, {"_gone": ("sum", F.col("_over").cast("long"))}, "block").withColumns({
        "protected": F.col("protected") | F.col("region"), "in_block": F.coalesce(body & ~F.col("_over"), F.lit(False)),
        "dropped_by": F.when(_alive() & F.col("_over"), "guard").otherwise(F.col("dropped_by")),
    })
    text = F.concat(F.lit(cfg.prefix + " "), F.col("_gone").cast("string"), F.lit(" "), L.plural(F.col("_gone"), "line"), F.lit(" elided from this failure; see the full output log"))
    cut = F.coalesce((F.col("pos") == F.col("_last")) & F.col("block").isNotNull() & (F.col("_gone") > 0), F.lit(False))
    df = w.settled(_mark(df, (cut, F.col("pos"), STEP // 2, text)))
    return df.withColumns({"block": F.when(~F.col("marker"), F.col("block")), "region": F.col("region") & ~F.col("marker")}).drop("_last", "_n", "_over", "_gone")


def context_window(df: DataFrame, cfg: Config = Config(), w: Whole | Segments = WHOLE) -> DataFrame:
    """Protects failure lines, and lines before and after those that need context and around blocks.

    Needs ``block`` and ``region`` (see cap_blocks). Blank rows and lines a cap elided belong to the region.
    """
    region, own = F.col("region"), ~F.col("marker")
    fail, need = own & _has(df, FAIL), own & _has(df, NEED)
    df = w.beside(df, {"_above": (F.col("block"), -1)}, own)
    same = F.coalesce(F.col("_above") == F.col("block"), F.lit(False))
    df = df.withColumns({"_fail": fail, "_need": need & ~region, "_opens": region & ~same, "_closes": F.col("_above").isNotNull() & ~same, "_cand": ~region & ~fail})
    df = w.soon(df, "_near", F.col("_need") | F.col("_opens"), cfg.before, own) if cfg.before > 0 else df.withColumn("_near", F.lit(False))
    df = w.running(df.withColumn("_near", F.col("_near") & ~region), {"_g": (F.col("_need") | F.col("_closes")).cast("long")}, own)
    df = w.running(df, {"_count": F.col("_cand").cast("long")}, own, "_g")
    after = (F.col("_g") > 0) & F.col("_cand") & (F.col("_count") <= cfg.after)
    df = df.withColumn("protected", F.col("protected") | (own & (F.col("_near") | after | (F.col("_fail") & ~region))))
    return df.drop("_fail", "_need", "_above", "_opens", "_closes", "_near", "_g", "_cand", "_count")


def guard(df: DataFrame, cfg: Config = Config(), active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """W2 to W4 in order; other stages leave what is protected alone. Nothing is protected where ``active`` is false."""
    df = cap_blocks(failure_blocks(df, active, w), cfg, w)
    hidden = F.col("_hide")
    df = df.withColumn("_hide", ~(_alive() | (F.col("dropped_by") == "guard"))).withColumn("marker", F.col("marker") | hidden)
    df = context_window(df, cfg, w)
    own = F.col("protected") if active is None else F.col("protected") & active
    return df.withColumns({"marker": F.col("marker") & ~hidden, "protected": own}).drop("_hide", "block", "region")


def drop_install_noise(df: DataFrame, cfg: Config = Config(), active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """Deprecations and progress of package managers go; one marker at the end counts them."""
    active = F.lit(True) if active is None else active
    t = F.col("text")
    free = active & _alive() & ~F.col("protected") & ~L._is(t, P.INSTALL_SUMMARY)
    old = free & L._is(t, P.INSTALL_DEPRECATED)
    df = df.withColumns({"_old": old, "_noise": free & ~old & L._is(t, P.INSTALL_NOISE)})
    df = w.totals(df, {"_a": ("sum", F.col("_old").cast("long")), "_b": ("sum", F.col("_noise").cast("long")), "_end": ("max", F.col("pos"))})
    df = df.withColumns({"_end": F.col("_end") == F.col("pos"), "dropped_by": F.when(F.col("_old") | F.col("_noise"), "node-install").otherwise(F.col("dropped_by"))})
    parts = F.concat_ws(" and ", F.when(F.col("_a") > 0, F.concat(F.col("_a").cast("string"), F.lit(" deprecation warnings"))), F.when(F.col("_b") > 0, F.concat(F.col("_b").cast("string"), F.lit(" progress/notice lines"))))
    return w.settled(_mark(df, (F.col("_end") & (F.col("_a") + F.col("_b") > 0), F.lit(END), _NOTES, F.concat(F.lit(f"{cfg.prefix} dropped "), parts)))).drop("_old", "_noise", "_a", "_b", "_end")


def drop_dotnet_noise(df: DataFrame, cfg: Config = Config(), active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """Restore, build and start-up chatter goes; two markers at the end count projects."""
    active = F.lit(True) if active is None else active
    t = F.col("text")
    free = active & _alive() & ~F.col("protected") & ~L._is(t, P.DOTNET_KEEP)
    r, b = L._is(t, P.DOTNET_RESTORED), L._is(t, P.DOTNET_BUILT)
    df = df.withColumns({"_r": free & r, "_b": free & ~r & b, "_c": free & ~r & ~b & L._is(t, P.DOTNET_CHATTER)})
    df = w.totals(df, {"_nr": ("sum", F.col("_r").cast("long")), "_nb": ("sum", F.col("_b").cast("long")), "_end": ("max", F.col("pos"))})
    df = df.withColumns({"_end": F.col("_end") == F.col("pos"), "dropped_by": F.when(F.col("_r") | F.col("_b") | F.col("_c"), "dotnet").otherwise(F.col("dropped_by"))})
    line = lambda verb, n: F.concat(F.lit(f"{cfg.prefix} {verb} "), F.col(n).cast("string"), F.lit(" "), L.plural(F.col(n), "project"))
    df = _mark(df, (F.col("_end") & (F.col("_nr") > 0), F.lit(END), 5 * _NOTES, line("restored", "_nr")), (F.col("_end") & (F.col("_nb") > 0), F.lit(END), 5 * _NOTES + STEP, line("built", "_nb")))
    return w.settled(df).drop("_r", "_b", "_c", "_nr", "_nb", "_end")


def detect_test_output(df: DataFrame, active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """``detected``, from the first line on that looks like a known test runner's."""
    active = F.lit(True) if active is None else active
    df = w.totals(df, {"_first": ("min", F.when(active & _alive() & L._is(F.col("text"), P.TEST_MARKER), F.col("pos")))})
    return df.withColumn("detected", F.coalesce(F.col("pos") >= F.col("_first"), F.lit(False))).drop("_first")


def drop_passing_tests(df: DataFrame, cfg: Config = Config(), active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """Passing tests and their indented diagnostics go; failure sections stay up to the next header, and so
    does all from the first failure summary on. Only flags of runs with passing tests go through the scan."""
    active = F.lit(True) if active is None else active
    t, m = F.col("text"), Z.Tests
    own = featured(df).where(_alive() & active)
    bit = lambda c, b: F.when(c, b).otherwise(0)
    solid = (F.col("_f").bitwiseAND(BLANK | FAIL) != 0) | F.col("protected")
    bits = (
        bit(F.col("in_block"), m.IN_BLOCK) + bit(solid, m.SOLID) + bit(L._is(t, P.TEST_FAILURE), m.FAIL) + bit(L._is(t, P.TEST_HEADER), m.HEAD)
        + bit(F.col("protected") | L._is(t, P.TEST_SUMMARY) | ~L._is(t, P.TEST_PASS), m.STAYS) + bit(L._is(t, P.TAP_RESULT), m.TAP)
    )
    keep = ["run_id", "pos", *_segment(df), "bits", "indent"]
    rows = own.withColumns({"bits": bits, "indent": F.col("_indent"), "_failing": F.when(L._is(t, P.TEST_FAILING), F.lit(True))}).select(*keep, "_failing")
    rows = w.latest(rows, {"_late": F.col("_failing")}).where("_late IS NULL").select(*keep)
    df = w.scanned(df, rows, m(), F.col("bits").bitwiseAND(m.IN_BLOCK | m.FAIL | m.STAYS) == 0)
    df = _drop(df, "test-runner", F.coalesce(F.col("pos") <= F.col("_hi"), F.lit(False)))
    text = F.concat(F.lit(f"{cfg.prefix} dropped "), F.col("_sum").cast("string"), F.lit(" passing-test "), L.plural(F.col("_sum"), "line"))
    return w.settled(_mark(df, (F.col("_end") & (F.col("_sum") > 0), F.lit(END), 2 * _NOTES, text))).drop("_hi", "_no", "_sum", "_end")


def docker_steps(df: DataFrame, cfg: Config = Config(), active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """A build step's lines move to its status line; finished steps keep header and status, failed ones all."""
    active = F.lit(True) if active is None else active
    t = F.col("text")
    id_ = F.when(active & _alive() & L._is(t, P.STEP_LINE), F.regexp_extract(t, P.java(P.STEP_LINE), 1))
    df = df.withColumns({"_on": active & _alive(), "_id": id_}).withColumn("_rest", F.when(F.col("_id").isNotNull(), F.regexp_extract(t, P.java(P.STEP_LINE), 2)))
    rest = F.col("_rest")
    event = F.when(L._is(rest, P.STEP_DONE), "D").when(L._is(rest, P.STEP_ERROR), "E").when(L._is(rest, P.STEP_HEADER), "H")
    df = df.withColumns({"_ev": F.when(rest.isNotNull(), event), "_moves": F.when(rest.isNotNull(), L._is(rest, P.STEP_PROGRESS) | L.is_progress(rest))})
    df = w.latest(df, {"_before": F.col("_ev")}, "_id", own=False)
    df = df.withColumn("_open", F.col("_id").isNotNull() & F.coalesce(F.col("_before") == "H", F.lit(False)))
    opens = F.coalesce((F.col("_ev") == "H") & ~F.col("_open"), F.lit(False))
    df = df.withColumns({"_opens": opens, "_status": F.col("_open") & F.coalesce(F.col("_ev").isin("D", "E"), F.lit(False))})
    held = F.col("_open") & ~F.col("_status")
    df = df.withColumns({
        "_mine": F.col("_open") | F.col("_opens"), "_prot": held & F.col("protected"),
        "_prog": held & ~F.col("protected") & F.col("_moves"), "_body": held & ~F.col("protected") & ~F.col("_moves"),
    })
    df = w.running(df, {"_epoch": F.col("_opens").cast("long")}, "_id")
    df = w.totals(df, {"_first": ("min", F.when(F.col("_opens"), F.col("pos")))}, "_id")
    own = F.when(F.col("_mine") & (F.col("_prot") | F.col("_body")), 1).otherwise(0)
    df = w.running(df, {"_held": own}, "_id", "_epoch")  # with the line itself
    df = df.withColumn("_fit", F.col("_prot") | (F.col("_body") & (F.col("_held") <= cfg.max_step)))
    total = lambda c: ("sum", F.when(F.col("_mine") & c, 1).otherwise(0))
    df = w.totals(df, {
        "_end": ("max", F.when(F.col("_status"), F.col("pos"))),
        "_bad": ("max", F.when(F.col("_mine"), F.col("_prot") | (F.col("_status") & F.coalesce(F.col("_ev") == "E", F.lit(False))))),
        "_kept": total(F.col("_fit")), "_progs": total(F.col("_prog")), "_over": total(F.col("_body") & ~F.col("_fit")),
        "_lastmine": ("max", F.when(F.col("_mine"), F.col("pos"))),
    }, "_id", "_epoch").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    done = F.col("_end").isNotNull()
    gone = F.col("_prog") | (F.col("_body") & ~F.col("_fit")) | (held & done & ~F.col("_bad"))
    loose = F.col("_on") & F.col("_id").isNull() & _has(df, BLANK) & ~F.col("protected")
    df = _drop(df, "docker-build", F.coalesce((F.col("_mine") & gone) | loose, F.lit(False)))
    # Order: rows of a step stand where it ended, or at the end of the run in order of its first header.
    place = F.when(~F.col("_mine"), F.col("pos")).when(done, F.col("_end")).otherwise(F.lit(2 * END) + F.col("_first"))
    part = F.when(~F.col("_mine"), 0).when(F.col("_opens"), 0).when(F.col("_status"), 3).otherwise(1)
    df = df.withColumns({"_p": place.cast("long"), "_q": part, "_tail": F.col("_mine") & (F.col("pos") == F.col("_lastmine"))})
    df = w.numbered(df, "_row", [F.col("_p"), F.col("_q"), F.col("pos")])
    df = df.withColumn("pos", F.col("_row") * STEP)
    head = F.concat(F.lit("#"), F.col("_id"), F.lit(f" {cfg.prefix} "))
    n = F.col("_kept") + F.col("_progs")
    many = lambda c, tail: F.concat(head, c.cast("string"), F.lit(" "), tail)
    layer = lambda c: F.concat(L.plural(c, "line"), F.lit(" of layer/progress output elided"))
    # The marker stands before the status line, or after the last row of a step that never ended.
    return _mark(
        df,
        (F.col("_status") & ~F.col("_bad") & (n > 0), F.col("pos"), -(STEP // 4), many(n, layer(n))),
        (F.col("_status") & F.col("_bad") & (F.col("_over") > 0), F.col("pos"), -(STEP // 4), many(F.col("_over"), F.concat(F.lit("further "), L.plural(F.col("_over"), "line"), F.lit(" elided; see the full output log")))),
        (F.col("_tail") & ~done & (F.col("_progs") > 0), F.col("pos"), STEP // 4, many(F.col("_progs"), layer(F.col("_progs")))),
    ).drop("_on", "_id", "_rest", "_ev", "_moves", "_open", "_opens", "_epoch", "_status", "_prot", "_prog", "_body", "_mine", "_fit", "_end", "_bad", "_kept", "_progs", "_over", "_first", "_lastmine", "_before", "_held", "_row", "_p", "_q", "_tail")


def dedup(
    df: DataFrame, cfg: Config = Config(), active: Column | None = None, far: Column | None = None, w: Whole | Segments = WHOLE
) -> DataFrame:
    """Adjacent runs collapse to their first line and a marker; shapes seen often enough within
    ``window`` lines are dropped, with one marker a shape at the end. far: runs to which the latter applies."""
    active = F.lit(True) if active is None else active
    far = F.lit(True) if far is None else far
    t, blank = F.col("text"), _has(df, BLANK)
    run = cfg.min_run if cfg.min_run >= 2 else 3
    df = df.withColumn("_free", active & _alive() & ~F.col("protected") & ~F.col("in_block") & ~_has(df, FAIL))
    df = df.withColumn("_key", F.when(F.col("_free"), L.dedup_key(t)))
    alive = _alive()
    df = w.beside(df, {"_above": (F.col("_key"), -1)}, alive)
    df = df.withColumn("_new", ~(F.col("_free") & F.coalesce(F.col("_above") == F.col("_key"), F.lit(False))))
    df = w.totals(w.running(df, {"_n": F.lit(1)}, alive), {"_all": ("count", F.lit(1))}, alive)
    # Of the first lines of islands: the next one's number tells the size, and whether it may go where the island is settled.
    df = w.beside(df, {"_next_n": (F.col("_n"), 1), "_next": (F.col("_free").cast("int"), 1)}, alive, "_new")
    df = df.withColumns({"_c": F.coalesce("_next_n", F.col("_all") + 1) - F.col("_n"), "_lead": F.col("_free") & F.col("_new") & ~blank})
    df = df.withColumn("_flush", F.col("_n") + F.col("_c") - 1 + F.coalesce("_next", F.lit(0)))
    keyed = (alive, "_lead", "_key")
    df = w.running(w.beside(df, {"_gap": (F.col("_flush"), -1)}, *keyed), {"_nth": F.lit(1)}, *keyed)
    inside = (F.col("_c") < run) & F.lit(cfg.window > 0) & far & (F.octet_length("text") >= 24) & F.coalesce(F.col("_flush") - F.col("_gap") <= cfg.window, F.lit(False))
    df = df.withColumns({"_in": F.col("_lead") & inside, "_firstkey": F.col("_lead") & (F.col("_nth") == 1)})
    df = w.running(df, {"_past": F.when(F.col("_in"), 2).otherwise(1)}, *keyed)  # with the line itself, which is 2 where it matters
    df = df.withColumn("_sup", F.col("_in") & (F.col("_past") - 1 > max(2, cfg.min_run - 1)))
    df = w.totals(df, {"_extra": ("sum", F.when(F.col("_sup"), F.col("_c")).otherwise(0))}, *keyed)
    # What holds for an island is what was found for its first line: the last first line at or before a line, dead lines aside.
    head = F.when(alive & F.col("_new"), F.struct(F.col("_sup").alias("sup"), F.col("_c").alias("c"), t.alias("t"), F.col("_n").alias("n")))
    df = w.latest(df.withColumn("_extra", F.when(F.col("_lead"), F.col("_extra"))), {"_head": head})
    many = F.col("_free") & ~blank & (F.col("_head.c") >= run)
    df = df.withColumns({
        "_mk": many & (F.col("_n") == F.col("_head.n") + F.col("_head.c") - 1), "_xk": F.col("_firstkey") & (F.coalesce("_extra", F.lit(0)) > 0),
        # A run of two keeps its first text twice: only its shape was compared.
        "text": F.when(F.col("_free") & ~blank & (F.col("_head.c") < run), F.col("_head.t")).otherwise(t),
    })
    df = _drop(df, "dedup", F.coalesce(F.col("_free") & F.when(blank, ~F.col("_new")).otherwise(F.col("_head.sup") | ((F.col("_head.c") >= run) & ~F.col("_new"))), F.lit(False)))
    c = F.col("_head.c")
    near = F.concat(F.lit(f"{cfg.prefix} "), L.times(c), F.lit(" similar "), L.plural(c, "line"), F.lit(" collapsed"))
    more = F.concat(F.lit(f"{cfg.prefix} "), L.times(F.col("_extra")), F.lit(" further similar "), L.plural(F.col("_extra"), "line"), F.lit(": "), L.sample_text(F.col("_head.t")))
    df = w.settled(_mark(df, (F.col("_mk"), F.col("pos"), STEP // 8, near), (F.col("_xk"), F.col("pos"), END + 6 * _NOTES, more)))
    return df.drop("_free", "_key", "_above", "_new", "_n", "_all", "_next_n", "_next", "_c", "_lead", "_flush", "_gap", "_nth", "_in", "_past", "_sup", "_extra", "_firstkey", "_head", "_mk", "_xk")


def head_tail(df: DataFrame, cfg: Config = Config(), active: Column | None = None, w: Whole | Segments = WHOLE) -> DataFrame:
    """The first and the last lines, and between them what is protected."""
    active = F.lit(True) if active is None else active
    alive = _alive()
    df = w.totals(w.running(df.withColumn("_on", active & alive), {"_n": F.lit(1)}, alive), {"_all": ("count", F.lit(1))}, alive)
    tail = F.greatest(F.lit(cfg.head), F.col("_all") - cfg.tail)
    df = w.running(df, {"_rank": F.when(F.col("protected") & (F.col("_n") > cfg.head), 1).otherwise(0)}, alive)
    df = df.withColumns({"_mid": F.col("_on") & (F.col("_n") > cfg.head) & (F.col("_n") <= tail), "_tails": F.col("_all") - tail, "_first": F.col("_on") & (F.col("_n") == tail + 1)})
    held = F.col("_mid") & F.col("protected") & (F.col("_rank") <= cfg.max_protected)
    count_of = lambda c: ("sum", c.cast("long"))
    df = w.totals(df, {
        "_skip": count_of(F.col("_mid") & ~F.col("protected")), "_kept": count_of(held), "_lost": count_of(F.col("_mid") & F.col("protected") & ~held),
        "_full": ("max", F.when(F.col("_on") & F.col("protected") & (F.col("_n") > cfg.head), F.col("_rank"))),
    }, alive)
    df = df.withColumns({"_full": F.col("_full") > cfg.max_protected, "_at1": F.col("_mid") & (F.col("_n") == cfg.head + 1), "_cut": F.col("_mid") & ~held})
    df = _drop(df, "truncate", F.col("_cut"))
    some = F.col("_skip") > 0
    say = lambda *x: F.concat(F.lit(f"{cfg.prefix} ... "), *x)
    count = lambda c: F.concat(F.col(c).cast("string"), F.lit(" "), L.plural(F.col(c), "line"))
    return _mark(
        df,
        (F.col("_at1") & some & (F.col("_kept") > 0), F.col("pos"), -(STEP // 16), say(count("_skip"), F.lit(" elided; failures from the middle follow ..."))),
        (F.col("_at1") & some & (F.col("_kept") == 0), F.col("pos"), -(STEP // 16), say(count("_skip"), F.lit(" elided ..."))),
        (F.col("_first") & ((some & (F.col("_kept") > 0) & F.coalesce("_full", F.lit(False))) | (~some & (F.col("_lost") > 0))), F.col("pos"), -(STEP // 32) * 3, say(F.lit("more failure lines elided; see the full output log ..."))),
        (F.col("_first") & some & (F.col("_kept") > 0), F.col("pos"), -(STEP // 16), say(F.lit("resuming at the last "), count("_tails"), F.lit(" ..."))),
    ).drop("_on", "_n", "_all", "_rank", "_mid", "_cut", "_skip", "_kept", "_full", "_lost", "_tails", "_first", "_at1")

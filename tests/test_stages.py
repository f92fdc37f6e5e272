import random
import re

import model
import pytest
from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.operators import stages as S
from millrace.plans.config import Config


def frame(spark, streams):
    rows = [(r, i + 1, t) for r, s in enumerate(streams) for i, t in enumerate(s)]
    return S.start(spark.createDataFrame(rows, "run_id long, line_no long, text string"))


def texts(df, n):
    out = [[] for _ in range(n)]
    for r in df.where("dropped_by IS NULL").orderBy("run_id", "pos").collect():
        out[r.run_id].append(r.text)
    return out


def shape(t):
    return re.sub(r"\d+", "<n>", t) if t.startswith("info:") else t


@pytest.mark.parametrize(("min_run", "window"), [(3, 50), (3, 4), (0, 6), (5, 0), (2, 9)])
def test_dedup_equals_the_model(spark, min_run, window):
    rng = random.Random(min_run * 100 + window)
    pool = ["info: took 5 ms for the long request", "info: took 7 ms for the long request", "plain line that is long enough to go", "short", "", " ", "Error: no", "another plain line, also long enough"]
    streams = [[rng.choice(pool) for _ in range(rng.randint(1, 40))] for _ in range(150)]
    got = texts(S.dedup(frame(spark, streams), Config(prefix="[m]", min_run=min_run, window=window)), len(streams))
    want = [model.dedup(s, lambda t: not t.startswith("Error"), shape, min_run, window) for s in streams]
    assert got == want


def test_head_tail_equals_the_model(spark):
    rng = random.Random(8)
    streams = [[f"{i}{'p' if rng.random() < 0.15 else ''}" for i in range(rng.randint(1, 30))] for _ in range(150)]
    df = frame(spark, streams).withColumn("protected", F.col("text").endswith("p"))
    got = texts(S.head_tail(df, Config(prefix="[m]", head=4, tail=6)), len(streams))
    want = [[s[x] if isinstance(x, int) else x for x in model.head_tail(len(s), [t.endswith("p") for t in s], 4, 6)] for s in streams]
    assert got == want


def test_blocks_equal_the_model(spark):
    rng = random.Random(6)
    pool = ["  1) case", "     AssertionError: x", "Error: y", "   at f (a.js:1:2)", "", "plain", "      deep", "3 passing", "+ x", "  2) other", "FAIL a"]
    streams = [[rng.choice(pool) for _ in range(rng.randint(1, 30))] for _ in range(120)]
    df = frame(spark, streams)
    t = F.col("text")
    rows = df.select("run_id", "pos", L.is_blank(t).alias("blank"), L.is_block_start(t).alias("start"), L.is_block_end(t).alias("end"), (L.is_failure_detail(t) | L.is_failure(t)).alias("detail"), L.indent_of(t).alias("indent"))
    want = [[] for _ in streams]
    for r in rows.orderBy("run_id", "pos").collect():
        want[r.run_id].append(r.asDict())
    got = [[] for _ in streams]
    for r in S.failure_blocks(df).orderBy("run_id", "pos").collect():
        got[r.run_id].append(r.block)
    assert got == [model.blocks(w) for w in want]


def test_progress_keeps_the_last_of_a_run(spark):
    df = frame(spark, [["10% done", "20% done", "30% done", "x", "40% other", "5%\r6%\r"]])
    assert texts(S.collapse_progress(df), 1) == [["30% done", "x", "40% other", "6%"]]


def test_build_steps(spark):
    ok = ["#1 [1/2] RUN a", "#1 one", "#2 [2/2] RUN b", "#1 two", "", "#2 three", "#1 DONE 0.1s", "#2 ERROR: no", "#3 [x] c", "#3 open", "end"]
    assert texts(S.docker_steps(frame(spark, [ok]), Config(prefix="[m]")), 1) == [
        ["#1 [1/2] RUN a", "#1 [m] 2 lines of layer/progress output elided", "#1 DONE 0.1s", "#2 [2/2] RUN b", "#2 three", "#2 ERROR: no", "end", "#3 [x] c", "#3 open"]
    ]


def test_install_and_tests(spark):
    lines = ["npm warn deprecated a", "npm http fetch", "added 3 packages", "x"]
    assert texts(S.drop_install_noise(frame(spark, [lines]), Config(prefix="[m]")), 1) == [["added 3 packages", "x", "[m] dropped 1 deprecation warnings and 1 progress/notice lines"]]
    tap = ["TAP version 13", "ok 1 - a", "  ---", "  duration_ms: 1", "  ...", "not ok 2 - b", "  ---", "# tests 2"]
    got = texts(S.drop_passing_tests(frame(spark, [tap]), Config(prefix="[m]")), 1)[0]
    assert "not ok 2 - b" in got and "  duration_ms: 1" not in got and got[-1] == "[m] dropped 1 passing-test line"


def test_one_exchange_for_window_stages(spark):
    df = frame(spark, [["a", "b"]])
    plan = S.head_tail(S.dedup(S.collapse_progress(df)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_each_part_of_the_plan_deals_the_lines_once(spark, monkeypatch):
    """On the real frame: one exchange of the lines a part, one of runs or of narrow rows beside it, and no text in Python."""
    from millrace.operators import scans as Z
    from millrace.plans import compact as K

    plans, narrow = [], []
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    keep, mapped = K.stored, Z._mapped
    monkeypatch.setattr(K, "stored", lambda df: (plans.append(count(df)), keep(df))[1])
    monkeypatch.setattr(Z, "_mapped", lambda rows, machine: (narrow.append(tuple(rows.columns)), mapped(rows, machine))[1])
    texts = [["Error: x", "  at f (a.js:1:2)", "ok 1", "plain"] * 5] * 2
    lines = spark.createDataFrame([(r, i + 1, t) for r, s in enumerate(texts) for i, t in enumerate(s)], "run_id long, line_no long, text string")
    runs = spark.createDataFrame([(0, ["npm", "test"]), (1, ["docker", "build", "."])], "run_id long, argv array<string>")
    done = K.staged(lines, runs, Config(always_filter=True))
    assert plans == [2, 2] and count(K.run_stats(done)) == 2  # lines and runs; lines and narrow rows; the same
    assert narrow == [("run_id", "pos", "bits", "indent", "seg", "entry")] * 2
    done = K.staged(lines, runs.where("run_id = 1"), Config(always_filter=True))  # no tests, no second cut
    assert plans[2:] == [2] and count(K.run_stats(done)) == 2

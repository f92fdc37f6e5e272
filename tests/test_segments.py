"""A run in segments gives what the same run gives as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import stages as S
from millrace.operators.order import NOTES, Segments
from millrace.plans import compact as K
from millrace.plans.config import Config

POOL = [
    "Error: event failed", "    at run (app.js:7:5)", "  1) suite case", "     AssertionError: expected 5", "      + expected - actual", "      -5", "", "   ",
    "10%", "20%", "info: [db] SELECT {\"ms\":4}", "info: [db] SELECT {\"ms\":5}", "npm warn deprecated left-pad@1.0.1", "npm http fetch GET 200", "added 5 packages",
    "  App1 -> /src/bin/App.dll", "  Restored /src/a.csproj (in 1.2 sec).", "src/a.cs: warning CS0168: unused", "  ✓ works", "ok 7", "  duration_ms: 3", "not ok 8",
    "#0 [2/6] RUN npm ci", "#1 [2/6] RUN npm ci", "#0 sha256:abc", "#1 log line", "#0 DONE 1.2s", "#1 ERROR: no", "main.go:12:3: undefined", "plain line that is long enough 1",
    "plain line that is long enough 1", "another plain line, long enough as well", "TAP version 13",
]
ARGV = [["npm", "ci"], ["npm", "test"], ["docker", "build", "."], ["dotnet", "build"], ["make"], ["git", "log"]]


def streams(seed, n, size):
    rng = random.Random(seed)
    return [[t for _ in range(size) for t in [rng.choice(POOL)] * rng.choice([1, 1, 1, 2, 5])][:size] for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(r, i + 1, t) for r, s in enumerate(texts) for i, t in enumerate(s)], "run_id long, line_no long, text string")


def shown(df):
    out = {}
    for r in df.orderBy("run_id", "pos").collect():
        out.setdefault(r.run_id, []).append((r.src, r.text, r.protected, r.in_block, r.dropped_by, r.marker))
    return out


CFG = Config(before=2, after=2, head=6, tail=7, max_block=3, max_step=2, max_protected=9)
STAGES = {
    "progress": lambda df, w: S.collapse_progress(df, w=w),
    "guard": lambda df, w: S.guard(df, CFG, w=w),
    "install": lambda df, w: S.drop_install_noise(df, CFG, w=w),
    "dotnet": lambda df, w: S.drop_dotnet_noise(df, CFG, w=w),
    "tests": lambda df, w: S.drop_passing_tests(S.detect_test_output(df, w=w), CFG, F.col("detected"), w=w),
    "docker": lambda df, w: S.docker_steps(df, CFG, w=w),
    "dedup": lambda df, w: S.dedup(df, CFG, w=w),
    "head_tail": lambda df, w: S.head_tail(df.withColumn("protected", F.col("src") % 3 == 0), CFG, w=w),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_in_segments_equal_whole_ones(spark, name):
    df = S.start(frame(spark, streams(len(name), 12, 40)))
    w = Segments(7)
    assert shown(STAGES[name](w.cut(df), w)) == shown(STAGES[name](df, S.WHOLE))


def test_the_plan_in_segments_equals_the_whole_one(spark):
    texts = streams(5, 6, 150) + [["short run"] * 3]
    lines = frame(spark, texts)
    runs = spark.createDataFrame([(i, a) for i, a in enumerate([*ARGV, ["make"]])], "run_id long, argv array<string>")
    cfg = Config(before=2, after=2, head=10, tail=15)
    cut = Config(before=2, after=2, head=10, tail=15, segment=40)
    want, got = K.staged(lines, runs, cfg), K.staged(lines, runs, cut)
    assert shown(got) == shown(want)
    rows = lambda done, c: sorted(map(tuple, K.kept_lines(done, c).collect()), key=str)
    assert rows(got, cut) == rows(want, cfg)
    assert sorted(map(str, K.run_stats(got).collect())) == sorted(map(str, K.run_stats(want).collect()))


def test_no_task_has_more_than_a_segment(spark):
    """One run has half of all lines: its segments are even, and so are the pieces of its numbering."""
    texts = [["x"] * 40 for _ in range(20)] + [[f"line {i}" for i in range(800)]]
    w = Segments(50)
    df = w.cut(S.start(frame(spark, texts)))
    sizes = {(r.run_id, r.seg): r["count"] for r in df.groupBy("run_id", "seg").count().collect()}
    assert max(sizes.values()) <= 50 and len(sizes) >= 36
    out = w.numbered(df, "n", [F.desc("pos")])
    rows = sorted((r.run_id, r.n, r.src) for r in out.collect())
    assert rows == sorted((r, i + 1, len(t) - i) for r, t in enumerate(texts) for i in range(len(t)))
    assert out.groupBy("run_id", "seg").count().agg(F.max("count")).first()[0] <= 50 and NOTES > 16

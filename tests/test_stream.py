"""A stream of lines, cut into micro-batches anywhere, gives what the batch plan gives; killed runs and late lines."""

import random
from datetime import datetime, timedelta

import pytest

from millrace.plans.compact import compact
from millrace.plans.config import Config
from millrace.streaming.stream import LINES, compact_stream, ended_runs

CFG = Config(passthrough_lines=0, passthrough_bytes=0, head=3, tail=3, before=1, after=1)
BEGAN = datetime(2024, 1, 1)
TEXTS = {
    1: ["info: request 1 took 5 ms"] * 4 + ["Error: bad", "    at x (a.js:1:2)"] + [f"line {i} of a long output" for i in range(12)],
    2: [f"other line {i} with words of its own" for i in range(9)] + ["1) a test", "   AssertionError: no"],
    3: ["killed halfway"] * 5,
}
ROWS = {r: [(r, i + 1, t, BEGAN + timedelta(seconds=i), False) for i, t in enumerate(ts)] for r, ts in TEXTS.items()}
END = [(r, None, None, BEGAN + timedelta(seconds=60), True) for r in (1, 2)]


def source(spark, folder, batches):
    for b in batches:
        spark.createDataFrame(b, LINES).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def released(spark, stream, name, **options):
    """Lines by run in the order of release, and the late ones."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = ended_runs(stream, **options).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(key)
    rows = spark.table(name).collect()
    lines = {}
    for r in rows:
        if not r.late:
            lines.setdefault(r.run_id, []).append((r.line_no, r.text))
    return {r: sorted(x) for r, x in lines.items()}, sorted((r.run_id, r.line_no) for r in rows if r.late)


def test_micro_batches_equal_the_batch(spark, tmp_path):
    late = (1, 99, "a late line", BEGAN + timedelta(hours=2), False)
    batches = [ROWS[3] + ROWS[2][:4] + ROWS[1] + END[:1], ROWS[2][7:] + ROWS[2][4:7] + [late, *END[1:]]]
    runs = spark.createDataFrame([(1, ["make"]), (2, ["make"]), (3, ["make"])], "run_id long, argv array<string>")
    got, numbers = {}, []

    def emit(kept, gone, stats, number):
        numbers.append(number)
        for r in kept.orderBy("run_id", "out_no").collect():
            got.setdefault(r.run_id, []).append(r.text)

    stream = source(spark, str(tmp_path / "in"), batches)
    q = compact_stream(spark, stream, runs, str(tmp_path / "late"), emit, CFG, clock="ts", checkpoint=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    lines = spark.createDataFrame([r[:3] for own in ROWS.values() for r in own], "run_id long, line_no long, text string")
    want = {}
    for r in compact(lines, runs, CFG)[0].orderBy("run_id", "out_no").collect():
        want.setdefault(r.run_id, []).append(r.text)
    assert got == want and set(want) == {1, 2, 3} and numbers == sorted(set(numbers)) and len(numbers) == 3
    assert [r.text for r in spark.read.parquet(str(tmp_path / "late")).collect()] == ["a late line"]


@pytest.mark.parametrize("seed", range(4))
def test_any_split_releases_the_same_runs(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [r for own in ROWS.values() for r in own]
    rng.shuffle(rows)
    rows += [*END, (3, None, None, BEGAN + timedelta(seconds=70), True)]
    cuts = sorted({0, len(rows), *rng.sample(range(1, len(rows)), 4)})
    stream = source(spark, str(tmp_path / "in"), [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    lines, late = released(spark, stream, f"split_{seed}", clock="ts", delay=timedelta(hours=1))
    assert lines == {r: [x[1:3] for x in own] for r, own in ROWS.items()} and late == []


def test_runs_are_forgotten_and_idle_ones_released(spark, tmp_path):
    at = lambda s: BEGAN + timedelta(seconds=s)
    batches = [
        [(1, 1, "a", at(0), False), (2, 1, "x", at(0), False)], [(2, 2, "y", at(50), False)], [(9, 1, "z", at(100), False), (1, 2, "b", at(95), False)],
        [(9, 2, "z", at(500), False)], [(1, 3, "c", at(600), False)], [(9, None, None, at(900), True)],
    ]
    stream = source(spark, str(tmp_path / "in"), batches)
    lines, late = released(spark, stream, "forgotten", clock="ts", idle=timedelta(seconds=60), delay=timedelta(seconds=1), remember=timedelta(seconds=300))
    assert lines[2] == [(1, "x"), (2, "y")] and lines[9] == [(1, "z"), (2, "z")]
    # Run 1 was released when it was idle for 60 s; its second line came before it was forgotten, its third after.
    assert (1, "a") in lines[1] and (1, 3) not in late


def test_arrival_is_the_usual_clock(spark, tmp_path):
    old = [(1, 1, "a", datetime(2020, 1, 1), False)], [(1, 2, "b", datetime(1999, 1, 1), False), (2, 1, "c", datetime(2024, 1, 1), False)], [(1, None, None, None, True)]
    lines, late = released(spark, source(spark, str(tmp_path / "in"), old), "arrival")
    assert lines == {1: [(1, "a"), (2, "b")]} and late == []

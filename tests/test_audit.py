"""Audits have teeth: each finds the violation planted for it, and nothing in output that is as it should be."""

from millrace.operators import audit as A

RUN = ["start", "Error: one", "  at a (b.js:1:2)", "1) case", "   AssertionError: x", "      - a", "      + b", "", "end", "info: done"]


def tables(spark, kept, lines=RUN):
    """lines of run 1 and its output: kept holds (source line or None, text)."""
    source = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(lines)], "run_id long, line_no long, text string")
    out = [(1, i + 1, s, t, s is None) for i, (s, t) in enumerate(kept)]
    return source, spark.createDataFrame(out, "run_id long, out_no long, src_line_no long, text string, is_marker boolean")


def whole(lines=RUN):
    return [(i + 1, t) for i, t in enumerate(lines)]


def without(*gone):
    return [x for x in whole() if x[0] not in gone]


def test_failures_survive(spark):
    assert A.failures_survive(*tables(spark, whole())).count() == 0
    lost = A.failures_survive(*tables(spark, without(2))).collect()
    assert [(r.line_no, r.problem) for r in lost] == [(2, "missing")]
    swapped = [whole()[i] for i in (0, 2, 1, *range(3, 10))]
    assert [r.problem for r in A.failures_survive(*tables(spark, swapped)).collect()] == ["out of order"]


def bare(pair):
    """The output without lineage, as another tool would give it."""
    return pair[0], pair[1].select("run_id", "out_no", "text")


def test_failures_survive_without_lineage(spark):
    assert A.failures_survive(*bare(tables(spark, whole()))).count() == 0
    assert [(r.line_no, r.problem) for r in A.failures_survive(*bare(tables(spark, without(2)))).collect()] == [(2, "missing")]
    swapped = [whole()[i] for i in (0, 2, 1, *range(3, 10))]
    assert [(r.line_no, r.problem) for r in A.failures_survive(*bare(tables(spark, swapped))).collect()] == [(3, "out of order")]
    twice = ["Error: a", "x", "Error: a", "\x1b[31mError: b\x1b[0m"]
    lost = A.failures_survive(*bare(tables(spark, [(None, "Error: a"), (None, "Error: b")], twice))).collect()
    assert [(r.line_no, r.problem) for r in lost] == [(3, "missing")]


def test_silent_gaps(spark):
    find = lambda kept, lines=RUN: [(r.header_no, r.line_no) for r in A.silent_gaps(*bare(tables(spark, kept, lines))).orderBy("line_no").collect()]
    cut = lambda *x: (None, "[millrace] 1 line elided from this failure") if not x else x
    assert find(whole()) == [] and find(without(1, 9, 10)) == []
    assert find(without(6)) == [(4, 6)] and find(without(5, 6, 7)) == [(4, 5)]
    assert find([x for x in whole() if x[0] < 6] + [cut()] + [x for x in whole() if x[0] > 6]) == []
    assert find(whole()[:5]) == [(4, 6)] and find([*whole()[:5], cut()]) == [] and find(without(4, 5, 6, 7)) == []
    two = ["1) a", "   x", "", "   y", "1) a", "   x", "", "z", "Traceback (most recent call last)", "  f", "g"]
    assert find(whole(two), two) == []
    assert find([x for x in whole(two) if x[0] not in (6, 10)], two) == [(5, 6), (9, 10)]
    assert find([x for x in whole(two) if x[0] != 4], two) == [(1, 4)] and find([x for x in whole(two) if x[0] != 3], two) == [(1, 3)]


def test_block_gaps(spark):
    assert A.block_gaps(*tables(spark, whole())).count() == 0
    assert A.block_gaps(*tables(spark, without(6))).count() == 1
    marked = [x for x in whole() if x[0] < 6] + [(None, "[millrace] 1 line elided")] + [x for x in whole() if x[0] > 6]
    assert A.block_gaps(*tables(spark, marked)).count() == 0


def test_block_equality(spark):
    assert A.block_equality(*tables(spark, whole())).count() == 0
    assert A.block_equality(*tables(spark, without(7))).count() == 1
    assert A.block_equality(*tables(spark, without(4, 5, 6, 7, 8, 9, 10))).first().got is None


def test_multiset_and_must_keep(spark):
    lines, kept = tables(spark, without(6))
    assert [r.text for r in A.multiset(lines, kept).collect()] == ["      - a"]
    assert A.multiset(*tables(spark, whole())).count() == 0
    rules = spark.createDataFrame([(1, "AssertionError"), (1, "- a"), (2, "no such run")], "run_id long, needle string")
    assert sorted(r.needle for r in A.must_keep(kept, rules).collect()) == ["- a", "no such run"]


def test_queries_complete(spark):
    runs = spark.createDataFrame([(1, "query")], "run_id long, kind string")
    noisy = ["info: took 3 ms", "info: took 4 ms", "\x1b[1mbold\x1b[0m", "10%\r20%", "plain", "plain"]
    shown = [(1, "info: took 3 ms"), (2, "info: took 3 ms"), (3, "bold"), (4, "20%"), (5, "plain")]
    lines, kept = tables(spark, shown, noisy)
    assert A.queries_complete(lines, kept, runs).count() == 0
    lines, kept = tables(spark, shown[:2] + shown[3:4], noisy)
    assert sorted(r.text for r in A.queries_complete(lines, kept, runs).collect()) == ["bold", "plain"]


def test_sizes_and_escapes(spark):
    stats = spark.createDataFrame([(1, 100, 40), (2, 100, 101)], "run_id long, raw_bytes long, bytes_out long")
    assert [r.run_id for r in A.never_grows(stats).collect()] == [2]
    floors = spark.createDataFrame([(1, 0.5), (2, 0.0)], "run_id long, min_saving double")
    assert [r.run_id for r in A.savings_floor(stats, floors).collect()] == [2]
    assert [r.run_id for r in A.savings_floor(stats, floors.withColumn("min_saving", floors.min_saving + 0.2)).collect()] == [1, 2]
    _, kept = tables(spark, [(1, "a\x1b[0m"), (2, "b\rc"), (3, "fine")])
    assert [r.out_no for r in A.no_escapes(kept).orderBy("out_no").collect()] == [1, 2]

"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from millrace import catalog
from millrace.plans import compact as K
from millrace.sources import tables as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries over the plan's output: they share one run of it here.
PLANNED = {n for n in catalog.QUERIES if n.startswith("audit_") or n in ("compact_stats", "compact_kept", "compact_elided", "savings_line", "diff_outputs")}


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in ("events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    res = duck.execute(catalog.SQL[name])
    names = [x[0] for x in res.description]
    rows = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert got == sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=str)


@pytest.fixture(scope="session")
def done(spark):
    return T.stored(K.staged(catalog.event_lines(spark, SF), catalog.event_runs(spark, SF), catalog.CFG))


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - PLANNED))
def test_equals_sql(spark, duck, name):
    same(spark, duck, name)


@pytest.mark.parametrize("name", sorted(PLANNED))
def test_plan_equals_sql(spark, duck, done, name, monkeypatch):
    monkeypatch.setattr(K, "staged", lambda lines, runs, cfg: done)
    same(spark, duck, name)


def test_compaction_loses_no_failure_and_never_grows(spark, done):
    from millrace.operators import audit

    lines, runs = catalog.event_lines(spark, SF), catalog.event_runs(spark, SF)
    kept, stats = K.kept_lines(done, catalog.CFG), K.run_stats(done)
    assert audit.failures_survive(lines, kept).count() == 0
    assert audit.never_grows(stats).count() == 0
    assert K.elided(done).count() > 0
    assert K.savings_line(stats).count() == runs.count()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "run_id"

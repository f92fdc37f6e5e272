"""The savings line of given runs and its SQL."""

import duckdb

from millrace import catalog
from millrace.plans import compact as K


def test_half_percents_round_as_in_sql(spark):
    """Shares of exactly a half go to the even number, all others to the nearest."""
    pairs = [(200, 200 - n) for n in range(200)] + [(1568, 1372), (3, 2), (1, 1), (7, 9), (10**15, 875 * 10**12), (2**40, 2**40 - 2**37), (8 * 10**9, 7 * 10**9 + 1), (8 * 10**9, 7 * 10**9 - 1)]
    rows = [(i, 70, 64, a, b) for i, (a, b) in enumerate(pairs)]
    stats = spark.createDataFrame(rows, "run_id long, lines_in long, lines_out long, bytes_in long, bytes_out long")
    con = duckdb.connect()
    con.execute("CREATE TABLE z (run_id bigint, lines_in bigint, lines_out bigint, bytes_in bigint, bytes_out bigint)")
    con.executemany("INSERT INTO z VALUES (?, ?, ?, ?, ?)", rows)
    sql = catalog.SQL["savings_line"]
    want = dict(con.execute(sql[sql.rindex("SELECT run_id, printf(") :]).fetchall())
    got = {r.run_id: r.line for r in K.savings_line(stats).collect()}
    assert got == want
    assert [got[n].split("tok ")[1] for n in (25, 27, 29)] == ["(-12%)", "(-14%)", "(-14%)"]

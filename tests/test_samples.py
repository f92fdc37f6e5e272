"""Samples of text that is not ASCII, in queries and in their SQL."""

import duckdb
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import lines as L

TEXTS = ["x" * 70, "x" * 71, "é" * 35, "é" * 36, "é" * 70, "é" * 71, " " + "ñ" * 34 + "abc ", "OUÊ!! RÉ, " * 9, "日本" * 12, "😀" * 18, "😀" * 90, "a" * 69 + "é" * 2, "", "  "]


def test_samples_equal_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE lines AS SELECT unnest(?) AS text", [TEXTS])
    sql = catalog.SQL["sample_text"].replace(f"({catalog.EVT})", "(SELECT 0 AS run_id, 0 AS line_no, text FROM lines)")
    want = dict(con.execute(f"SELECT text, value FROM ({sql.replace('line_no, ', 'line_no, text, ', 1)})").fetchall())
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {r.text: r.value for r in df.select("text", L.sample_text(F.col("text")).alias("value")).collect()}
    assert got == want and want["é" * 36] == "é" * 36 + "…"


def test_compacted_documents_with_accents_equal_sql(spark, tmp_path):
    """Repeats at a distance, whose sample is cut, in lines of one to four bytes a character."""
    docs = {}
    for i, t in enumerate(["x" * 90, "OUÊ!! RÉ, " * 9, "ñ" * 36, "日本" * 40, "😀" * 90, "a" * 69 + "é" * 9]):
        docs[i] = "\n".join(x for n in range(30) for x in (t, f"line {n} of its own, number {n}"))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES["compact_documents"](spark, str(tmp_path))
    res = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL['compact_documents']})").fetchall()
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(res) and len(got) == len(docs) and all("dedup" in r[-1] for r in got)

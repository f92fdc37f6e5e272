"""Pipeline stages decide by row: rows that share an id, above all null ids, keep their own verdict."""

from helpers import documents

from millrace.llm import decontaminate, exact_dedup, jaccard_join


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def texts(df):
    return sorted(r.text or "" for r in df.collect())


def test_exact_dedup(spark):
    rows = [(None, "a"), (None, "b"), (None, "c"), (None, "c"), (None, "c "), (1, "d"), (2, "d"), (2, "e"), (3, "f"), (3, "f"), (3, "g")]
    got = exact_dedup.keep_one(documents(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a"), (0, "b"), (0, "c "), (1, "d"), (2, "e"), (3, "f"), (3, "g")]
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    hot = exact_dedup.keep_one(documents(spark, ["same"] * 3000 + ["other"], [None] * 3001))
    assert texts(hot) == ["other", "same"]


def test_jaccard_join(spark):
    a, b, c, d = (words(x) for x in "abcd")
    rows = [(None, a), (None, a + " end"), (None, b), (1, c), (2, c + " end"), (2, d), (2, d), (None, d + " end"), (None, ""), (None, ""), (5, None)]
    got = jaccard_join.keep_one(documents(spark, [t for _, t in rows], [i for i, _ in rows]))
    kept = [(r.doc_id or 0, r.text or "") for r in got.collect()]
    assert sorted(x for x in kept if x[1]) in (sorted([(0, x), (0, b), (1, c), (2, d)]) for x in (a, a + " end"))
    assert sorted(x for x in kept if not x[1]) == [(0, ""), (0, ""), (5, "")]


def test_decontamination(spark):
    items = spark.createDataFrame([(1, words("q", 12))], "item_id long, text string")
    rows = [(None, words("a")), (None, words("b") + " " + words("q", 12)), (None, None), (4, words("c")), (4, words("q", 12)), (5, words("d"))]
    got = decontaminate.clean(documents(spark, [t for _, t in rows], [i for i, _ in rows]), items)
    assert texts(got) == ["", words("a"), words("c"), words("d")]
    assert texts(decontaminate.clean(documents(spark, []), items)) == []

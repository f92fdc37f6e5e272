"""Null ids and texts, repeated rows, one id on two texts, clashing columns, long texts and empty tables."""

import zlib

import pytest
from helpers import documents, write

from millrace.llm import decontaminate, fm_dedup, hmm, licenses, pii, suffix_dedup, toxicity

TEXTS = ["one two three", "one two three", "four five", None, "", "four five", "six"]
IDS = [3, 3, 3, None, None, None, 8]


def clashing(spark, texts, ids):
    """Columns named like those that the operators make on the way."""
    return documents(spark, texts, ids).selectExpr("*", *(f"1 as {c}" for c in ("id", "u", "t", "n", "g", "uid", "words", "score", "_id", "row", "y", "sha")))


def test_hmm(spark):
    rows = hmm.score(clashing(spark, TEXTS, IDS)).collect()
    held = zlib.crc32(b"3") % 10 == 0
    train = sum(len((t or "").split()) + 1 for t, i in zip(TEXTS, IDS, strict=True) if i is None or zlib.crc32(str(i).encode()) % 10)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (0, 1), (0, 3), (3, 3), (3, 4), (3, 4), (8, 2)]
    assert {r.train_tokens for r in rows} == {train} and {r.held_out for r in rows if r.doc_id == 3} == {held}
    assert len({r.score for r in rows if r.n_tokens == 4}) == 1 and len({r.score for r in rows if r.n_tokens == 1}) == 1


def test_pii(spark):
    docs = clashing(spark, ["a@b.cd", "a@b.cd", None, "x 10.0.0.1"], [3, 3, None, None])
    rows = pii.digest(pii.detect(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip) for r in rows) == [(0, 0, 0), (0, 0, 1), (3, 1, 0), (3, 1, 0)]


def test_toxicity(spark):
    texts = [f"plain words {i}" for i in range(60)] + [f"you idiot {i}" for i in range(30)]
    ids = list(range(90))
    labels = [(i, 1, int(i >= 60)) for i in ids] + [(5, 1, 0), (None, 1, 1), (7, None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'q' as text", "1 as t")
    docs = clashing(spark, [*texts, texts[5], "another text", None, "you idiot x", "plain", ""], [*ids, 5, 5, None, None, None, 5000])
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 96 and sum(r.doc_id is None for r in rows) == 3 and sum(r.doc_id == 5 for r in rows) == 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = toxicity.accept(docs, labels)
    assert kept.columns == docs.columns
    left = [r.text for r in kept.collect()]
    assert left.count(texts[5]) == 2 and left.count(None) == 1 and "plain" in left and "you idiot x" not in left
    assert toxicity.score(documents(spark, []), labels).count() == 0 and toxicity.accept(documents(spark, []), labels).count() == 0


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    docs = clashing(spark, [item, item, "x " + item, None, "", "clean"], [3, 3, None, None, 4, 5])
    pairs = decontaminate.contained(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in pairs if r.item_id} == {(3, 1), (None, 1)}
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == ["", "", "clean"]


def test_very_long_texts(spark):
    """A text of a megabyte beside short ones; the passage that both hold is found at its end."""
    tail = " ".join(f"t{i}" for i in range(40))
    long = " ".join(f"w{i}" for i in range(150_000)) + " mit license a@b.cd " + tail
    docs = documents(spark, [tail, long])
    for op, n in ((suffix_dedup.dedup, len(tail)), (fm_dedup.dedup, 40)):
        got = {r.doc_id: r.n_removed for r in op(docs).collect()}
        assert got[0] == 0 and n <= got[1] <= n + 1
    assert {r.doc_id: r.n_email for r in pii.digest(pii.detect(docs)).collect()} == {0: 0, 1: 1}
    assert {r.doc_id: r.n_base for r in licenses.digest(licenses.detect(docs)).collect()} == {0: 0, 1: 1}
    assert {r.doc_id: r.n_tokens for r in hmm.score(docs).collect()} == {0: 41, 1: 150_044}
    items = spark.createDataFrame([(1, tail)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contained(docs, items).collect()} == {0, 1}


@pytest.mark.skipif(not __import__("importlib.util").util.find_spec("corpus_pipeline"), reason="no pipeline")
def test_pipeline_with_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    item = " ".join(f"q{i}" for i in range(30))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    own = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    texts, ids = [own[0], own[0], own[1], own[2], own[3], item, None, ""], [None, None, None, 4, 4, 4, 5, 5]
    full = write(spark, tmp_path / "full", documents=documents(spark, texts, ids), labels=labels, benchmark=benchmark)
    rows = C.run(spark, full).collect()
    assert sorted({r.doc_id or 0 for r in rows}) == [0, 4, 5]
    pieces = [sum((r.doc_id or 0) == i and r.start == 0 for r in rows) for i in (0, 4, 5)]
    assert pieces == [2, 2, 1]  # both texts of no id and of id 4 stay, the copy and the leak are gone
    empty = write(spark, tmp_path / "empty", documents=documents(spark, []), labels=labels.limit(0), benchmark=benchmark.limit(0))
    assert C.run(spark, empty).count() == 0

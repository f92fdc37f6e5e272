"""Quality: tables against their trees, held-out accuracy, and odd rows."""

import random

import numpy as np
import pytest
from helpers import documents

from millrace.llm import quality as Q


def prose(rng, n):
    words = ["the", "river", "house", "over", "light", "often", "made", "stone", "water", "green", "and", "with"]
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def junk(rng, n):
    kind = rng.randrange(3)
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w for w in words[: n // 10 + 1] for _ in range(10))
    return " ".join(w.upper() + "!!" for w in words) if kind == 1 else " | ".join(words)


def test_figures():
    at = {k: i for i, k in enumerate(Q.FIGURES)}
    x = Q.figures("AB cd!! cd!!\ncd!! 12 é")
    assert x[at["upper"]] == pytest.approx(2 / 22) and x[at["bang"]] == pytest.approx(6 / 22) and x[at["repeat"]] == pytest.approx(2 / 6)
    assert x[at["edge"]] == pytest.approx(3 / 6) and x[at["bar"]] == pytest.approx(1 / 6) and x[at["log_lines"]] == pytest.approx(np.log(3))
    assert (Q.figures("") == 0).all() and np.isfinite(Q.figures(" \n ")).all() and np.isfinite(Q.figures("x")).all()
    clean = prose(random.Random(1), 400)
    part = Q.figures(clean + " " + " ".join(["AAA!!"] * 40))
    assert part[at["worst_edge"]] > 0.5 > part[at["edge"]]


def test_a_tree_cuts_where_it_gains_most():
    g, h = np.array([-3.0, -3, 5, 5, 5, -3]), np.full(6, 20.0)
    out = Q.tree(g, h, 3)
    assert len(set(out.round(6))) == 3 and out[0] == out[1] < 0 < out[2] == out[4] and out[5] < 0


def test_pairs_find_what_single_figures_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.train(x, y, 120)
    fresh = rng.random((1000, 3))
    want = (fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)
    assert ((model.score(fresh) > 0.5) == want).mean() > 0.9 and (0, 1) in model.pairs
    alone = Q.Additive(model.constant, model.cuts, model.singles)
    assert ((alone.score(fresh) > 0.5) == want).mean() < 0.7


def test_scores_are_sums_of_looked_up_values():
    model = Q.Additive(0.5, [np.array([1.0, 2.0]), np.array([0.0])], [np.array([1.0, 2.0, 3.0]), np.array([-1.0, 1.0])], [np.array([1.5]), np.array([0.0])], {(0, 1): np.array([[0.1, 0.2], [0.3, 0.4]])})
    assert model.logit(np.array([[0.5, 1.0], [2.5, -1.0], [2.0, 0.0]])) == pytest.approx([0.5 + 1 + 1 + 0.2, 0.5 + 3 - 1 + 0.3, 0.5 + 2 - 1 + 0.3])


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(5)
    marks = [int(rng.random() < 0.7) for _ in range(500)]
    texts = [prose(rng, 80) if m else junk(rng, 80) for m in marks]
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*texts, texts[0], None, "", "x"], [*range(500), 0, None, None, 9999]).selectExpr("*", "1 as id", "2 as x", "'q' as t", "3 as held", "4 as y")
    rows = Q.score(docs, labels).collect()
    assert len(rows) == 504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score > 0.5) == marks[r.doc_id] for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert len(held) > 60 and sum(held) / len(held) > 0.95
    assert len({r.score for r in rows if r.doc_id == 0}) == 1 and sum(r.doc_id is None and not r.held_out for r in rows) == 2
    assert Q.score(documents(spark, []), labels).count() == 0
    assert {r.score for r in Q.score(documents(spark, ["a", "b"]), labels.limit(0)).collect()} == {0.5}


def test_very_long_text():
    x = Q.figures(" ".join(f"w{i}" for i in range(200_000)))
    assert np.isfinite(x).all()

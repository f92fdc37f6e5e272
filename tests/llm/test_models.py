import collections
import math
import random
import zlib

import numpy as np
import pytest
from helpers import documents, write

from millrace.llm import decontaminate, hmm, toxicity


def test_forward_equals_all_paths():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2).T
    model = hmm.Model(start, move, emit)
    docs = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 2, 5, 5, 3)]
    for d, got in zip(docs, model.log10(docs), strict=True):
        total = 0.0
        for path in np.ndindex(*(2,) * len(d)):
            p = start[0, path[0]] * emit[d[0], path[0]]
            for a, b, o in zip(path, path[1:], d[1:], strict=False):
                p *= move[a, b] * emit[o, b]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)
    first, moves, emits = model.expected(docs)
    n = sum(map(len, docs))
    assert math.isclose(first.sum(), len(docs)) and math.isclose(moves.sum(), n - len(docs)) and math.isclose(emits.sum(), n)


def test_hmm_base_by_brute_force_and_gain(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LEXICON", 20)
    rng = random.Random(2)
    tongue = [[f"a{i}" for i in range(40)], [f"é{i}," for i in range(40)]]
    texts = [" ".join(rng.choice(rng.choices(tongue[k % 2], k=30)) for _ in range(rng.randint(0, 60))) for k in range(300)] + [None, "", "A1 a1\x0ba1"]
    got = {r.doc_id: r for r in hmm.score(documents(spark, texts)).collect()}
    count, docs = collections.Counter(), []
    for i, t in enumerate(texts):
        words = [*((t or "").encode().lower().split()), None]
        docs.append(words)
        if zlib.crc32(str(i).encode()) % 10:
            count.update(words)
    n, v = sum(count.values()), len(count)
    for i, words in enumerate(docs):
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score(documents(spark, [])).count() == 0


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rng = random.Random(3)
    bad = ["scum", "idiot", "moron", "trash"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 40))]
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    sf = write(spark, tmp_path, documents=documents(spark, [*texts, None, ""]), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    held = [r for i, r in rows.items() if r.held_out and i < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    assert rows[600].score == rows[601].score and rows[600].predicted == 0 and len(rows) == 602
    field = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    spans, _ = field.tag("well you idiot there", toxicity.Known(field.cues))
    assert [(a, b) for a, b, p in spans if p > 0.5] == [(9, 14)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(documents(spark, ["a", None]), none).collect()} == {0.0}


def test_marginals_equal_all_paths():
    field = toxicity.Field({}, np.array([2.0, 1.0, -1.5]), np.array([[0.3, -0.4], [0.1, 0.8]]))
    places, cues, n = [1, 4], [(0,), (0, 1)], 6
    emit = np.ones((n, 2))
    emit[:, 1] = math.exp(-1.5)
    emit[1, 1], emit[4, 1] = math.exp(0.5), math.exp(1.5)
    total, at = 0.0, {1: 0.0, 4: 0.0}
    for path in np.ndindex(*(2,) * n):
        p = np.prod([emit[i, s] for i, s in enumerate(path)]) * np.prod([field.move[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += p
        for i in at:
            at[i] += p * (path[i] == 1)
    for got, i in zip(field.marginals(places, cues, n), (1, 4), strict=True):
        assert math.isclose(got, at[i] / total, rel_tol=1e-6)


def test_containment_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [[word() for _ in range(rng.randint(3, 60))] for _ in range(60)]
    texts = []
    for k in range(80):
        words = [word() for _ in range(rng.randint(0, 400))]
        if k % 2:
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, 2)):
                item[rng.randrange(len(item))] = word()
            words[rng.randint(0, len(words)) : 0] = item
        texts.append(" ".join(words).upper())
    texts += [None, "", " ".join(items[0])]
    grams = lambda w: {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()
    want = set()
    for i, t in enumerate(texts):
        d = grams((t or "").lower().split())
        for j, item in enumerate(items):
            s = grams(item)
            if len(s & d) >= 0.75 * len(s):
                want.add((i, j, len(s & d), len(s)))
    table = spark.createDataFrame([*[(j, " ".join(x)) for j, x in enumerate(items)], (None, "x"), (99, None)], "item_id long, text string")
    got = {tuple(r)[:4] for r in decontaminate.contained(documents(spark, texts), table).collect()}
    assert got == want and len(want) > 20
    assert decontaminate.contained(documents(spark, texts), table.where("false")).count() == 0


@pytest.mark.skipif(not __import__("importlib.util").util.find_spec("corpus_pipeline"), reason="no pipeline")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base, leak = text(80), text(30)
    texts = [base, base + " ", base.replace(base.split()[0], "zz", 1), text(50) + " " + leak, text(40), None, "short one"]
    labels = [(i, 1, 0) for i in range(7)]
    sf = write(
        spark, tmp_path, documents=documents(spark, texts), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"),
    )
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == list(C.COLUMNS)
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen == [[0, 1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], [1, 3, 4, 5, 6], [1, 4, 5, 6]]
    rows = C.run(spark, sf).collect()
    assert sorted({r.doc_id for r in rows}) == [1, 4, 5, 6]


def test_a_text_scores_the_same_in_every_batch():
    rng = np.random.default_rng(11)
    model = hmm.Model.first(rng.integers(1, 50, 60).astype(float))
    docs = [rng.integers(0, 60, rng.integers(1, 80)).astype(np.uint16) for _ in range(50)]
    alone = [model.log10([d])[0] for d in docs]
    for n in range(1, 51):
        assert list(model.log10(docs[:n])) == alone[:n] and list(model.log10(docs[-n:])) == alone[-n:]


def test_sums_over_thousands_of_partitions_go_in_two_levels(spark):
    rows = [(i, p, [float(p), 1.0, float(i)]) for p in range(5000) for i in (0, 1)]
    parts = spark.createDataFrame(rows, "i int, p int, v array<double>").repartition(7)
    got = {r.i: list(r.v) for r in hmm.merged(parts, 70).collect()}
    assert got == {i: [sum(range(5000)), 5000.0, 5000.0 * i] for i in (0, 1)}


def test_expected_counts_of_whole_texts_equal_all_pairs_of_places(monkeypatch):
    """Forward and backward messages from end to end, also where a long text is cut into segments."""
    rng = np.random.default_rng(5)
    start, move, emit = rng.dirichlet(np.ones(3), 2), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T
    model = hmm.Model(start, move, emit)
    docs = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 150, 64, 65, 7, 333, 2, 14)]
    starts, moves, emits = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit)
    wide = 9 * emit  # a factor for each symbol falls out of all shares and keeps the messages from underflow
    for d in docs:
        before, after = [start[0] * wide[d[0]]], [np.ones(3)]
        for x in d[1:]:
            before.append(before[-1] @ move * wide[x])
        for x in d[:0:-1]:
            after.insert(0, move @ (wide[x] * after[0]))
        total = before[-1].sum()
        starts[0] += before[0] * after[0] / total
        for t, x in enumerate(d):
            emits[x] += before[t] * after[t] / total
            if t:
                moves += np.outer(before[t - 1], wide[x] * after[t]) * move / total
    for sizes in ({}, {"SEGMENT": 7, "LONG": 13, "CELLS": 50}, {"SEGMENT": 64, "LONG": 64, "CELLS": 1}):
        for name, size in sizes.items():
            monkeypatch.setattr(hmm, name, size)
        for got, want in zip(model.expected(docs), (starts, moves, emits), strict=True):
            assert np.allclose(got, want, rtol=1e-9, atol=1e-12), sizes


def test_every_round_learns_from_every_training_text(spark):
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 30, rng.integers(1, 100)).astype(np.uint16) for _ in range(900)]
    held = [i % 10 == 0 for i in range(900)]
    rows = [(h, i, d.tobytes()) for i, (h, d) in enumerate(zip(held, docs, strict=True))]
    coded = spark.createDataFrame(rows, "held boolean, uid long, symbols binary").repartition(5)
    train = [d for d, h in zip(docs, held, strict=True) if not h]
    counts = np.bincount(np.concatenate(train), minlength=30).astype(float)
    want = hmm.Model.first(counts)
    for _ in range(3):
        want = hmm.Model.of(*want.expected(train), counts)
    got = hmm.baum_welch(coded, counts, 3)
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-9)
    none = hmm.baum_welch(coded.where("held"), counts)
    assert np.array_equal(none.emit, hmm.Model.first(counts).emit)

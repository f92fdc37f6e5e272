import hashlib
import random

from helpers import documents

from millrace.llm import fm_dedup, suffix_dedup


def corpus(rng, word, n):
    """Documents made of shared passages, own words, edits and repeats."""
    passages = [[word() for _ in range(rng.randint(10, 60))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            words += p[rng.randint(0, 3) :]
        texts.append(" ".join(words))
    texts += [texts[0], texts[1] + " ", None, "", "ab " * 80, "x" * 400, "é" * 120, "one two"]
    rng.shuffle(texts)
    return texts


def brute(seqs, span, other):
    seen, out = {}, []
    for i, s in enumerate(seqs):
        for j in range(len(s) - span + 1):
            seen.setdefault(s[j : j + span], (i, j))
    for i, s in enumerate(seqs):
        gone = [False] * len(s)
        for j in range(len(s) - span + 1):
            first = seen[s[j : j + span]]
            if (first[0] < i) if other else (first < (i, j)):
                gone[j : j + span] = [True] * span
        out.append(gone)
    return out


def test_bytes_by_brute_force(spark):
    rng = random.Random(11)
    texts = corpus(rng, lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))), 40)
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffix_dedup.dedup(documents(spark, texts)).collect()}
    for i, gone in enumerate(brute(raw, 100, False)):
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)
        assert tuple(got[i])[1:] == (len(raw[i]), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i


def test_words_by_brute_force(spark):
    rng = random.Random(12)
    texts = corpus(rng, lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3))), 60)
    seqs = [tuple((t or "").split()) for t in texts]
    got = {r.doc_id: r for r in fm_dedup.dedup(documents(spark, texts)).collect()}
    for i, gone in enumerate(brute(seqs, 13, True)):
        kept = " ".join(w for w, g in zip(seqs[i], gone, strict=True) if not g)
        assert tuple(got[i])[1:] == (len(seqs[i]), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def test_no_task_holds_a_hot_gram(spark, monkeypatch):
    """A passage that all documents share, between words of their own, is decided without a frame of its gram."""
    shared = [f"s{i}" for i in range(40)]
    texts = [" ".join([f"a{i}x{j}" for j in range(20)] + shared + [f"b{i}x{j}" for j in range(20)]) for i in range(60)]
    for op, span, seqs in ((suffix_dedup, 100, [t.encode() for t in texts]), (fm_dedup, 13, [tuple(t.split()) for t in texts])):
        seen = spark.sparkContext.accumulator(0)

        def resolve(f, own=op.resolve, seen=seen):
            seen.add(int((f["g"].value_counts() >= 20).sum()))
            return own(f)

        with monkeypatch.context() as m:
            m.setattr(op, "resolve", resolve)
            got = {r.doc_id: r.n_removed for r in op.dedup(documents(spark, texts)).collect()}
        assert got == {i: sum(gone) for i, gone in enumerate(brute(seqs, span, op is fm_dedup))}
        assert seen.value == 0


def test_owners_of_a_long_text_do_not_depend_on_the_cut():
    import numpy as np

    from millrace.llm.repeats import owners

    rng = np.random.default_rng(2)
    for width, n in ((77, 3000), (9, 700), (9, 40)):
        grams = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        grams[n // 3 : n // 3 + 10] = grams[5]
        for cut in (1, 13, 64, 512):
            for a, b in zip(owners(grams, width), owners(grams, width, cut + width, cut), strict=True):
                assert (a == b).all()


def test_repeats_across_a_cut(spark, monkeypatch):
    """The text is cut into pieces; an owner of windows on both sides of a cut keeps them all."""
    from millrace.llm import repeats

    rng = random.Random(13)
    texts = corpus(rng, lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))), 25)
    whole = repeats.owners
    for op, span, seqs in ((suffix_dedup, 100, [(t or "").encode() for t in texts]), (fm_dedup, 13, [tuple((t or "").split()) for t in texts])):
        with monkeypatch.context() as m:
            m.setattr(repeats, "owners", lambda grams, width, most=150, cut=40: whole(grams, width, most, cut))
            got = {r.doc_id: r.n_removed for r in op.dedup(documents(spark, texts)).collect()}
        assert got == {i: sum(gone) for i, gone in enumerate(brute(seqs, span, op is fm_dedup))}


def test_smallest_of_a_long_interval():
    import numpy as np

    n = (1 << 21) + 1000
    text = np.ones(n, np.int64)
    text[-1] = 0
    order = np.arange(n)
    documents_ = np.full(n, 7, np.int32)
    documents_[n // 2] = 3
    original, fm_dedup.suffix_array = fm_dedup.suffix_array, lambda text, reach: order
    try:
        index = fm_dedup.Index(text, documents_, 2)
    finally:
        fm_dedup.suffix_array = original
    assert index.smallest(np.array([0]), np.array([n]))[0] == 3


def test_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(40))
    for op in (suffix_dedup.dedup, fm_dedup.dedup):
        assert op(documents(spark, [])).count() == 0
        rows = op(documents(spark, [long, long, long, "z"], [3, 3, None, 4]).selectExpr("*", "1 as u", "2 as g")).collect()
        assert sorted((r.doc_id is None, r.n_removed > 0) for r in rows) == [(False, False)] * 3 + [(True, True)]


def test_index_counts():
    import numpy as np

    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 5, 399), 0)
    index = fm_dedup.Index(text, np.arange(400, dtype=np.int32), 8)
    windows = np.array([text[i : i + 3] for i in range(380)])
    low, high = index.search(windows)
    for i, w in enumerate(windows):
        places = [j for j in range(397) if (text[j : j + 3] == w).all()]
        assert high[i] - low[i] == len(places) and index.smallest(low[i : i + 1], high[i : i + 1])[0] == places[0]


def test_matching_statistics():
    import numpy as np

    rng = np.random.default_rng(5)
    docs = [rng.integers(1, 4, int(n)) for n in rng.integers(8, 30, 12)]
    text = np.concatenate([np.append(d, 0) for d in docs])
    index = fm_dedup.Index(text, np.repeat(np.arange(12, dtype=np.int32), [len(d) + 1 for d in docs]), 8)
    start = 0
    for i, d in enumerate(docs):
        ends = np.arange(7, len(d))
        got = index.matching(text, start + ends, np.full(len(ends), i), 8)
        earlier = [tuple(e[j : j + n]) for e in docs[:i] for n in range(1, 9) for j in range(len(e) - n + 1)]
        assert list(got) == [max([n for n in range(1, 9) if tuple(d[e - n + 1 : e + 1]) in earlier], default=0) for e in ends]
        start += len(d) + 1

import random

from helpers import documents

from millrace.llm import jaccard_join as J


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def family(rng, n, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[at] = f"x{rng.randrange(10**6)}"
            elif rng.random() < 0.5 and len(w) > 1:
                del w[at]
            else:
                w.insert(at, f"y{rng.randrange(10**6)}")
        if rng.random() < 0.3:
            base = w
        out.append(" ".join(w))
    return out


def test_components_by_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "ONE ", "a b c d", "a b c d e"]
    for size, edits in [(1, 1), (3, 1), (6, 1), (8, 1), (9, 1), (11, 1), (14, 1), (20, 1), (30, 2), (45, 2), (70, 3), (120, 5), (250, 9), (700, 25), (1500, 60)]:
        for _ in range(3):
            texts += family(rng, 8, size, edits)
    texts += ["near copy " * 3 + " ".join(f"v{i}" for i in range(60)) + f" tail{k}" for k in range(80)]
    rng.shuffle(texts)
    got = {r.doc_id: tuple(r)[1:] for r in J.jaccard_join(documents(spark, texts)).collect()}
    want = brute(texts)
    assert {i: v for i, v in got.items() if v != want[i]} == {}


def test_blocks_and_exact_parts_give_the_same(spark):
    rng = random.Random(4)
    texts = family(rng, 60, 90, 9) + family(rng, 30, 300, 30) + [f"alone {i} a b c d e f g" for i in range(20)]
    want = {i: v for i, v in brute(texts).items()}
    for exact, load in ((False, 400), (True, 400), (True, 10**6)):
        got = {r.doc_id: tuple(r)[1:] for r in J.jaccard_join(documents(spark, texts), exact, load).collect()}
        assert got == want, (exact, load)


def test_forest_joins_what_all_links_join():
    import numpy as np

    rng = np.random.default_rng(8)
    for m, size in ((2, 30), (5, 8), (40, 30), (150, 60), (300, 20)):
        base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        sets = []
        for _ in range(m):
            own = base[rng.random(size) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 62, rng.integers(1, 6), dtype=np.uint64)])))
        for left in (None, rng.random(m) < 0.5):
            root = list(range(m))
            for i in range(m):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both) and (left is None or left[i] != left[j]):
                        old, new = root[i], root[j]
                        root = [new if r == old else r for r in root]
            own = list(range(m))
            links = J.forest(sets, left)
            for i, j in links:
                assert own[i] != own[j]
                old, new = own[i], own[j]
                own = [new if r == old else r for r in own]
            assert len(set(own)) == len(set(root)) and all((own[i] == own[0]) == (root[i] == root[0]) for i in range(m))


def test_many_texts_just_below_the_threshold(spark):
    """2,000 texts that share half of their words and more, none of which is linked, cost rows and not pairs."""
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(200)]
    texts = []
    for k in range(2000):
        own = [f"o{k}x{i}" for i in range(40)]
        texts.append(" ".join(shared + own))  # 196 of 240 + 40 shingles are shared: 0.69
    texts += [texts[7] + " end", texts[11].replace(" s50 ", " other ")]
    rng.shuffle(texts)
    sets = J.shingle_sets(documents(spark, texts))
    members = J.groups(sets, spark.createDataFrame([], "sign long"))
    assert J.blocks(members, 100_000).count() < 40 * len(texts)
    rows = J.jaccard_join(documents(spark, texts), load=100_000).collect()
    linked = [r for r in rows if r.component_id != r.doc_id]
    assert len(rows) == 2002 and len(linked) == 2
    for r in linked:
        a, b = texts[r.doc_id].split(), texts[r.component_id].split()
        assert len(set(a) ^ set(b)) <= 3


def test_no_pair_is_missed_at_the_threshold():
    import numpy as np

    from millrace.llm.words import mixed

    rng = np.random.default_rng(3)
    for size in (3, 4, 7, 8, 9, 13, 21, 34, 60, 61, 90, 150, 400, 2000):
        for _ in range(40):
            union = rng.permutation(mixed(rng.choice(10**9, size, replace=False).astype(np.uint64)))
            both = -(-3 * size // 4)
            cut = int(rng.integers(both, size + 1))  # a has the first part of the rest, b the other
            a, b = np.sort(union[:cut]), np.sort(np.concatenate([union[:both], union[cut:]]))
            assert np.intersect1d(J.signatures(a), J.signatures(b)).size, (size, len(a), len(b))


def test_no_pair_is_missed_when_elements_crowd_in_one_part():
    import numpy as np

    rng = np.random.default_rng(5)
    for small, large in ((9, 12), (10, 13), (12, 16), (13, 17), (21, 28), (45, 60)):
        for _ in range(200):
            b = rng.integers(0, 1 << 58, large, dtype=np.uint64)  # all fall into the first part
            assert np.intersect1d(J.signatures(np.sort(b[:small])), J.signatures(np.sort(b))).size, (small, large)


def test_rows_without_id_link_others(spark):
    words = [f"w{i}" for i in range(40)]
    chain = [" ".join(words[i : i + 32]) for i in (0, 3, 6)]  # the ends are linked by the one between only
    rows = J.jaccard_join(documents(spark, chain, [1, None, 2])).collect()
    assert [r.component_id for r in rows] == [1, 1, 1]


def test_odd_tables(spark):
    assert J.jaccard_join(documents(spark, [])).count() == 0
    rows = J.jaccard_join(documents(spark, ["a b", "a b", "A  b", None], [7, 7, None, None]).selectExpr("*", "1 as key", "2 as n")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 0, 0), (0, 1, 7), (7, 1, 7), (7, 1, 7)]

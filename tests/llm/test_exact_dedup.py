import hashlib
import random
import re
from collections import defaultdict

from helpers import documents

from millrace.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, g in groups.items():
        for n, i in g:
            out[i] = (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(3)
    texts = [rng.choice(["a b", "ab", "a\tb ", "x", "", None, " \n", "é", "é ", f"u{i}"]) for i in range(400)] + ["hot text"] * 300
    rows = list(enumerate(texts))
    got = {r.doc_id: tuple(r)[1:] for r in X.exact_dedup(documents(spark, texts)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    docs = documents(spark, ["a", "a", "a", "b"], [5, 5, None, None]).withColumn("sha", X.F.lit("clash"))
    rows = X.exact_dedup(docs).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 2
    assert {(r.keep_id, r.group_size) for r in rows} == {(5, 3), (None, 1)}
    assert X.exact_dedup(documents(spark, [])).count() == 0
    kept = X.keep_one(documents(spark, ["a", "a", "a", "b"], [5, 5, -7, -2**63 + 1]))
    assert sorted(r.doc_id for r in kept.collect()) == [-2**63 + 1, -7] and kept.columns[0] == "doc_id"

"""The manifest against a plain recursive version, with blocks so small that several stages are needed."""

import hashlib
import zlib

import pytest
from helpers import documents

from millrace.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level):
    """All levels from the leaves to one node."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(levels, i):
    """Siblings left and right of the node above leaf i, level by level."""
    for level in levels[:-1]:
        yield (level[i - 1] if i % 2 else ""), (level[i + 1] if i % 2 == 0 and i + 1 < len(level) else "")
        i //= 2


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted results."""
    leaf = lambda r, more=0: h(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {n: climb([leaf(r) for r in trees[n]]) for n in names}
    crown = climb([levels[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(trees[n]):
            path = [*steps(levels[n], i), *steps(crown, k)]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r, 1) if touched else leaf(r)
            for left, right in path:
                fold = h(left, fold, right)
            root = crown[-1][0]
            out.append((r[0], leaf(r), levels[n][-1][0], root, h(*(x + y for x, y in path)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [2, 3])
def test_equals_a_plain_tree(spark, bits):
    from helpers import DOCS

    rows = [(i, f"text {i} é" if i % 5 else None, ("en" if i % 3 else "de") if i % 11 else None, "s" if i % 2 else None, i if i % 4 else None) for i in range(-3, 75)]
    rows += [(None, "a", "en", None, 1), (None, "a", "en", None, 1), (9, "x", "en", "s", 2), (9, "x", "en", "s", 2), (7, "", "", "s", 9), (99, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 as pos", "2 as tree", "'q' as leaf", "3 as n", "4 as block")
    got = sorted((tuple(r) for r in merkle.manifest(docs, bits).collect()), key=str)
    assert got == plain(rows) and not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_one_leaf_and_none(spark):
    one = merkle.manifest(documents(spark, ["a"], [1])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == h()
    assert merkle.manifest(documents(spark, [])).collect() == []



def test_long_text(spark):
    rows = [(1, "é" * 400_000, "en", "s", None), (2, "b", "en", "s", None)]
    assert sorted((r.doc_id, r.leaf) for r in merkle.manifest(documents(spark, [r[1] for r in rows], [1, 2])).collect()) == [(r[0], r[1]) for r in plain(rows)]

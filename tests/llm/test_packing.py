import random
import zlib

import numpy as np
from helpers import documents
from tokenizers import Tokenizer

from millrace.llm import packing as P


def verify(rows, texts, waste):
    slow = Tokenizer.from_file(P.vocabulary())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = used = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY
        used += at
        padding += 0 if at & (at - 1) == 0 else P.CAPACITY - at
    assert padding <= waste * used, (padding, used)


def test_round_trip(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé \n") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 60, 300, 1500]))) for _ in range(150)]
    texts += [None, "", "<|endoftext|> in a text", "x" * 30_000] + ["the same text again"] * 60
    verify(P.pack(documents(spark, texts)).collect(), texts, 0.01)


def test_odd_tables(spark):
    assert P.pack(documents(spark, [])).count() == 0
    rows = P.pack(documents(spark, ["a", "a", "b"], [1, 1, None]).withColumn("rank", P.F.lit(9))).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows) == [(False, 2), (False, 2), (True, 2)]


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.arange(1, 129)
    demand = rng.integers(50, 500, 128).astype(float)
    patterns, use = P.column_generation(sizes, demand, 128)
    assert (sizes @ patterns <= 128).all() and ((patterns * use).sum(axis=1) >= demand - 1e-6).all()
    assert use.sum() <= 1.01 * (sizes * demand).sum() / 128 + demand[sizes > 64].sum() * 0.5


def test_inverse_and_many_classes_after_a_spark_job(spark):
    """The linear program runs in the driver, beside Spark's workers, and must not hang there."""
    import faulthandler

    spark.range(8).selectExpr("id", "cast(id as string) as text").mapInPandas(lambda b: b, "id long, text string").count()
    rng = np.random.default_rng(1)
    faulthandler.dump_traceback_later(120, exit=True)
    matrix = rng.integers(0, 4, (60, 60)) + 9 * np.eye(60)
    assert np.allclose((P.inverted(matrix)[:, :, None] * matrix[None]).sum(axis=1), np.eye(60))
    lengths = {k: int(rng.integers(1, 400)) for k in range(1, 401)}
    places, used, sequences = P.plan(lengths)
    faulthandler.cancel_dump_traceback_later()
    total = sum(k * n for k, n in lengths.items())
    assert sum(k * n for k, n in used.items()) <= sequences * 512 <= 1.01 * total and all(used[k] <= lengths[k] for k in lengths)
    assert sum(high - low for _, low, high, *_ in places) == sum(used.values())


def test_knapsack_by_brute_force():
    import itertools

    sizes, values = np.array([2, 3, 5]), np.array([3.0, 5.0, 8.0])
    for c in range(1, 15):
        best = max(a * 3 + b * 5 + d * 8 for a, b, d in itertools.product(range(8), repeat=3) if 2 * a + 3 * b + 5 * d <= c)
        worth, counts = P.knapsack(values, sizes, c)
        assert worth == best == values @ counts and sizes @ counts <= c


def test_ids_are_those_of_the_tokenizer_over_all_planes():
    """Letters, marks, digits and signs of every plane, long runs of digits and white space, contractions."""
    rng = random.Random(17)
    slow, fast = Tokenizer.from_file(P.vocabulary()), P._encoder(P.vocabulary())
    planes = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x600), (0x900, 0xE00), (0x1E00, 0x2100), (0x2190, 0x2C00), (0x3040, 0x3100), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xE000, 0xF8FF), (0x10000, 0x10FFFF)]
    pieces = ["don't", "I'LL", "we've", "it's", "O'Neil", "\u2019s", "  ", "\n\n", "\t", " \r\n", "\u00a0", "\u3000", "0" * 40, "12345678901234567890", "3.14", "\u0663\u0664", "e\u0301", "\u200d", "\x00", "\x7f"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) if rng.random() < 0.4 else "".join(chr(rng.randint(*rng.choice(planes))) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))
        assert list(P._ids(fast, text))[:-1] == slow.encode(text, add_special_tokens=False).ids, text.encode()

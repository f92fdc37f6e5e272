"""Composed state functions against plain models, over batches cut anywhere."""

import random

import model
import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import scans as Z


def test_composition_is_what_stepping_gives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 97, 400):
        table = rng.integers(0, 5, (n, 5))
        state, want = 3, []
        for row in table:
            state = row[state]
            want.append(state)
        assert list(Z.composed(table, 3)) == want


def cut(rng, rows, names):
    """Batches (runs, pos, bits, indent) of rows (run, pos, flags), cut anywhere."""
    at = 0
    while at < len(rows):
        n = min(rng.randint(1, 40), len(rows) - at)
        part = rows[at : at + n]
        bits = [sum(bit for bit, name in names if r[2][name]) for r in part]
        yield pa.array([r[0] for r in part]), *(np.array(x, np.int64) for x in ([r[1] for r in part], bits, [r[2]["indent"] for r in part], [0] * n, [0] * n))
        at += n


def made(rng, names):
    return {name: rng.random() < 0.25 for _, name in names} | {"indent": rng.choice([0, 0, 2, 4, 6])}


BLOCKS = [(Z.Blocks.BLANK, "blank"), (Z.Blocks.OPENS, "opens"), (Z.Blocks.HEADER, "start"), (Z.Blocks.ENDS, "end"), (Z.Blocks.DETAIL, "detail")]
TESTS = [(Z.Tests.IN_BLOCK, "in_block"), (Z.Tests.SOLID, "solid"), (Z.Tests.FAIL, "fail"), (Z.Tests.HEAD, "head"), (Z.Tests.STAYS, "stays"), (Z.Tests.TAP, "tap")]


@pytest.mark.parametrize("cells", [Z.CELLS, 7])
@pytest.mark.parametrize("seed", range(30))
def test_blocks_and_tests_equal_the_models(seed, cells, monkeypatch):
    monkeypatch.setattr(Z, "CELLS", cells)
    rng = random.Random(seed)
    names = BLOCKS if seed % 2 else TESTS
    runs = [[made(rng, names) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    for r in (x for run in runs for x in run):
        r["opens"] = r.get("start") and not r.get("end")
    ids = [None, *range(1, 12)]
    rows = [(ids[k], i + 1, r) for k, run in enumerate(runs) for i, r in enumerate(run)]
    machine = Z.Blocks() if seed % 2 else Z.Tests()
    got = [x for out in Z.found(machine, cut(rng, rows, names)) for x in out]
    want = []
    for k, run in enumerate(runs):
        labels = model.blocks(run) if seed % 2 else model.passing_tests(run)
        for i, label in enumerate(labels):
            if not label:
                continue
            goes_on = i and labels[i - 1] and (label == labels[i - 1] if seed % 2 else True)
            if goes_on:
                want[-1][2:] = [i + 1, want[-1][3] + (label == 1 or seed % 2)]
            else:
                want.append([ids[k], i + 1, i + 1, int(label == 1 or seed % 2)])
    assert [list(x)[:4] for x in got] == want

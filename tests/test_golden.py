"""Recorded outputs (cmd, input.txt, golden.txt in a folder for each case) come out byte for byte; GOLDEN_DIR names their folder."""

import os
import re
from pathlib import Path

import pytest

from millrace.operators import audit as A
from millrace.plans.compact import kept_lines, run_stats, staged
from millrace.plans.config import Config

ROOT = os.environ.get("GOLDEN_DIR", "")


def split(path: Path) -> list[str]:
    out = path.read_bytes().decode("utf-8", "replace").split("\n")
    return out[:-1] if out[-1] == "" else out


@pytest.mark.skipif(not ROOT, reason="set GOLDEN_DIR to a folder of recorded cases")
def test_recorded_outputs(spark):
    cases = [c for c in sorted(Path(ROOT).iterdir()) if (c / "input.txt").exists() and (c / "golden.txt").exists()]
    want = {i: split(c / "golden.txt") for i, c in enumerate(cases)}
    note = re.compile(r"(\[\w+\]) (?:\.\.\.|×\d|dropped|restored|built|\d+ lines? )")
    prefix = next(m[1] for w in want.values() for line in w if (m := note.search(line)))
    lines = [(i, n + 1, t) for i, c in enumerate(cases) for n, t in enumerate(split(c / "input.txt"))]
    lines = spark.createDataFrame(lines, "run_id long, line_no long, text string")
    runs = spark.createDataFrame([(i, (c / "cmd").read_text().split()) for i, c in enumerate(cases)], "run_id long, argv array<string>")
    cfg = Config(prefix=prefix, always_filter=True, footer=False)
    done = staged(lines, runs, cfg).cache()
    kept = kept_lines(done, cfg).cache()
    got = {}
    for r in kept.orderBy("run_id", "out_no").collect():
        got.setdefault(r.run_id, []).append(r.text)
    assert {cases[i].name for i in want if got[i] != want[i]} == set()
    assert A.failures_survive(lines, kept).count() == 0 == A.never_grows(run_stats(done)).count()

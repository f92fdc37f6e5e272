"""Scans that no window can say: state machines over flags of lines, run as composed state functions.

A line is a function from the state before it to the state after it; functions compose associatively. So a
stretch of lines is cut into blocks, the functions inside all blocks are composed side by side, the blocks
are chained, and every line then looks up its own state: a few vectorised steps for a batch, none for a line.
The state between batches, a number and a depth, is all that is carried.

The scan reads narrow rows (run, position, flags, indent; never text) of the runs that can leave the first
state at all, and gives intervals of lines. ``spread`` brings them back to the lines by a union ahead of the
exchange that the following windows need anyway, so the lines are shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a table of state functions that are held at once.
CELLS = 4_000_000


def composed(table: np.ndarray, state: int) -> np.ndarray:
    """The state after each row; table[i, s] is the state after row i if s was the state before it."""
    n, k = table.shape
    width = max(1, math.isqrt(n))
    rows = -(-n // width)
    padded = np.empty((rows * width, k), table.dtype)
    padded[:n] = table
    padded[n:] = np.arange(k)
    padded = padded.reshape(rows, width, k)
    whole = padded.copy()
    for j in range(1, width):  # every block at once: its first j functions composed
        whole[:, j] = np.take_along_axis(padded[:, j], whole[:, j - 1], 1)
    entry = np.empty(rows, np.int64)
    for b in range(rows):
        entry[b], state = state, int(whole[b, -1, state])
    return np.take_along_axis(whole, entry[:, None, None].repeat(width, 1), 2).reshape(-1)[:n]


class Blocks:
    """Failure blocks: closed, or open at the indent of the header."""

    BLANK, OPENS, HEADER, ENDS, DETAIL = 1, 2, 4, 8, 16
    plain = 1  # states without a depth

    def openers(self, bits: np.ndarray) -> np.ndarray:
        return bits & self.OPENS > 0

    def _stays(self, bits: np.ndarray, indent: np.ndarray, depth: np.ndarray) -> np.ndarray:
        deeper = (indent > depth) | ((bits & self.HEADER == 0) & (bits & self.DETAIL > 0))
        return (bits & self.BLANK > 0) | ((bits & self.ENDS == 0) & deeper)

    def table(self, bits: np.ndarray, indent: np.ndarray, depths: np.ndarray) -> np.ndarray:
        closed = np.where(self.openers(bits), 1 + np.searchsorted(depths, indent), 0)
        stays = self._stays(bits[:, None], indent[:, None], depths[None, :])
        return np.column_stack([closed, np.where(stays, 1 + np.arange(len(depths)), closed[:, None])])

    def marks(self, before: np.ndarray, after: np.ndarray, bits: np.ndarray, indent: np.ndarray, depths: np.ndarray) -> tuple:
        """Lines that belong to an interval, those that begin one whatever came before, and those that count."""
        depth = np.append(depths, 0)[before - 1]
        stays = (before > 0) & self._stays(bits, indent, depth)
        return after > 0, (after > 0) & ~stays, after > 0


class Tests:
    """Passing tests: usual, inside a failure section, or hushing what stands deeper than a dropped result."""

    IN_BLOCK, SOLID, FAIL, HEAD, STAYS, TAP = 1, 2, 4, 8, 16, 32
    plain = 2

    def openers(self, bits: np.ndarray) -> np.ndarray:
        return bits & (self.IN_BLOCK | self.FAIL | self.STAYS | self.TAP) == self.TAP

    def table(self, bits: np.ndarray, indent: np.ndarray, depths: np.ndarray) -> np.ndarray:
        has = lambda bit: bits & bit > 0
        passes = np.where(has(self.STAYS) | ~has(self.TAP), 0, 2 + np.searchsorted(depths, indent))
        usual = np.where(has(self.IN_BLOCK), 0, np.where(has(self.FAIL), 1, passes))
        failing = np.where(has(self.IN_BLOCK) | has(self.FAIL) | ~has(self.HEAD), 1, passes)
        hushed = ~(has(self.IN_BLOCK) | has(self.SOLID))[:, None] & (indent[:, None] > depths[None, :])
        return np.column_stack([usual, failing, np.where(hushed, 2 + np.arange(len(depths)), usual[:, None])])

    def marks(self, before: np.ndarray, after: np.ndarray, bits: np.ndarray, indent: np.ndarray, depths: np.ndarray) -> tuple:
        has = lambda bit: bits & bit > 0
        depth = np.append(depths, [0, 0])[before - 2]
        hushed = (before >= 2) & ~has(self.IN_BLOCK) & ~has(self.SOLID) & (indent > depth)
        goes = ~hushed & ~has(self.IN_BLOCK) & ~has(self.FAIL) & ~((before == 1) & ~has(self.HEAD)) & ~has(self.STAYS)
        return hushed | goes, np.zeros(len(bits), bool), goes


def _portions(n: int, states: int) -> Iterator[slice]:
    step = max(1, CELLS // states)
    return (slice(i, i + step) for i in range(0, n, step))


def found(machine: Blocks | Tests, batches: Iterator) -> Iterator[list[tuple]]:
    """Intervals (run, first, last, count, seg, new) of batches (runs as an Arrow array, pos, bits, indent, seg, entry), in order.

    Rows are sorted by run, segment and position; a segment may go on in the next batch. entry: the state before a
    segment, a number below ``plain`` or ``plain`` plus a depth. new: whether no interval of the segment before goes on.
    """
    now, started, held = None, False, None
    state, depth = 0, 0  # a state from ``plain`` on has a depth, which is what is carried
    for runs, pos, bits, indent, seg, entry in batches:
        n = len(pos)
        if not n:
            continue
        code = runs.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.append(not started or (runs[0].as_py(), int(seg[0])) != now, (code[1:] != code[:-1]) | (seg[1:] != seg[:-1]))
        now, started = (runs[n - 1].as_py(), int(seg[-1])), True
        known = [depth] if state >= machine.plain else []
        depths = np.unique(np.concatenate([indent[machine.openers(bits)], known, entry[first & (entry >= machine.plain)] - machine.plain]).astype(np.int64))
        coded = np.where(entry < machine.plain, entry, machine.plain + np.searchsorted(depths, entry - machine.plain))
        before, after = np.empty(n, np.int64), np.empty(n, np.int64)
        at = state if state < machine.plain else machine.plain + int(np.searchsorted(depths, depth))
        for part in _portions(n, machine.plain + len(depths)):
            table = machine.table(bits[part], indent[part], depths)
            own = np.flatnonzero(first[part])
            table[own] = table[own, coded[part][own]][:, None]
            after[part] = composed(table, at)
            before[part] = np.append(at, after[part][:-1])
            at = int(after[part][-1])
        before[first] = coded[first]
        state, depth = min(at, machine.plain), int(depths[at - machine.plain]) if at >= machine.plain else 0
        inside, new, counts = machine.marks(before, after, bits, indent, depths)
        fresh = new | ~np.append(held is not None, inside[:-1])
        goes_on = first & (coded >= machine.plain) & ~new  # an interval of the segment before does
        new = inside & (fresh | first)
        number = np.cumsum(new)  # 0: what goes on from the batch before
        own = np.flatnonzero(inside)
        out = []
        if len(own):
            cut = np.flatnonzero(np.diff(number[own], prepend=-1))
            lo, hi = own[cut], own[np.append(cut[1:], len(own)) - 1]
            n_own = np.add.reduceat(counts[own].astype(np.int64), cut)
            columns = (runs.take(_indices(lo)).to_pylist(), pos[lo].tolist(), pos[hi].tolist(), n_own.tolist(), seg[lo].tolist(), (~goes_on[lo]).tolist())
            out = [list(x) for x in zip(*columns, strict=True)]
            if number[own[0]] == 0:
                out[0][1], out[0][3], out[0][5], held = held[1], held[3] + out[0][3], held[5], None
        if held is not None:
            out.insert(0, held)
        held = out.pop() if len(own) and own[-1] == n - 1 else None
        if out:
            yield out
    if held is not None:
        yield [held]


def _indices(at: np.ndarray):
    import pyarrow as pa

    return pa.array(at)


def function_of(table: np.ndarray) -> np.ndarray:
    """All rows of a table of state functions as one function: neighbours are composed until one is left."""
    while len(table) > 1:
        if len(table) % 2:
            table = np.concatenate([table, np.arange(table.shape[1], dtype=table.dtype)[None]])
        table = np.take_along_axis(table[1::2], table[::2], 1)
    return table[0]


def _columns(batch) -> tuple:
    return batch.column(0), *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 6))


def _mapped(rows: DataFrame, machine: Blocks | Tests) -> DataFrame:
    """Intervals of rows (run_id, pos, bits, indent, seg, entry), dealt and sorted already."""
    kind = rows.schema["run_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = None

        def kept() -> Iterator:
            nonlocal types
            for b in batches:
                types = b.schema.field(0).type
                yield _columns(b)

        for out in found(machine, kept()):
            own = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(own[0], types), *(pa.array(c, pa.int64()) for c in own[1:5]), pa.array(own[5], pa.bool_())], ["run_id", "lo", "hi", "n", "seg", "new"])

    return rows.mapInArrow(run, f"run_id {kind}, lo long, hi long, n long, seg long, new boolean")


_ROWS = ("run_id", "pos", "bits", "indent", "seg", "entry")


def intervals(rows: DataFrame, machine: Blocks | Tests, opens: Column) -> DataFrame:
    """run_id, lo, hi, n: intervals of rows (run_id, pos, bits, indent), for runs in which ``opens`` holds somewhere."""
    rows = rows.withColumn("_some", F.max(opens).over(Window.partitionBy("run_id"))).where("_some")
    rows = rows.withColumns({"seg": F.lit(0), "entry": F.lit(0)}).select(*_ROWS)
    # The window has dealt the rows by run already.
    return _mapped(rows.sortWithinPartitions("run_id", "pos"), machine).select("run_id", "lo", "hi", "n")


def segment_intervals(rows: DataFrame, machine: Blocks | Tests) -> DataFrame:
    """run_id, lo, hi, n, seg, new: the same by segments, whose ``entry`` is known."""
    rows = rows.select(*(F.coalesce("entry", F.lit(0)).alias("entry") if c == "entry" else F.col(c) for c in _ROWS))
    return _mapped(rows.repartition("run_id", "seg").sortWithinPartitions("run_id", "seg", "pos"), machine)


def entries(rows: DataFrame, machine: Blocks | Tests) -> DataFrame:
    """run_id, seg, entry: the state before each segment.

    rows: run_id, seg, pos, bits, indent and ``depths``, the run's indents at which a state may open. A segment is
    composed to one function of the states, and the functions of a run, a row for each segment, are chained.
    """
    import pandas as pd

    kind = rows.schema["run_id"].dataType.simpleString()

    def composed_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, whole, states = None, None, None
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(["run_id", "seg"], sort=False):
                if key != now:
                    if now is not None:
                        out.append((*now, states, whole.tolist()))
                    depths = np.unique(np.array(part["depths"].iloc[0], np.int64))
                    now, whole, states = key, np.arange(machine.plain + len(depths)), [*range(machine.plain), *(machine.plain + depths).tolist()]
                bits, indent = part["bits"].to_numpy(np.int64), part["indent"].to_numpy(np.int64)
                for piece in _portions(len(bits), len(whole)):
                    whole = function_of(machine.table(bits[piece], indent[piece], depths))[whole]
            yield pd.DataFrame(out, columns=["run_id", "seg", "states", "ends"])
        if now is not None:
            yield pd.DataFrame([(*now, states, whole.tolist())], columns=["run_id", "seg", "states", "ends"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, out = pdf.sort_values("seg"), 0, []
        for states, ends in zip(pdf["states"], pdf["ends"], strict=True):
            out.append(at)
            at = int(states[ends[list(states).index(at)]])
        return pd.DataFrame({"run_id": pdf["run_id"], "seg": pdf["seg"], "entry": out})

    dealt = rows.select("run_id", "seg", "pos", "bits", "indent", "depths").repartition("run_id", "seg").sortWithinPartitions("run_id", "seg", "pos")
    parts = dealt.mapInPandas(composed_segments, f"run_id {kind}, seg long, states array<long>, ends array<long>")
    return parts.groupBy("run_id").applyInPandas(chain, f"run_id {kind}, seg long, entry long")


def spread(df: DataFrame, hits: DataFrame) -> DataFrame:
    """``df`` with, for each line, the latest interval that begins at or before it: ``_hi`` (its end), ``_no`` (its
    number in the run) and ``_sum`` (the counts of all intervals up to it); and ``_end``, whether it is the run's last."""
    both = df.unionByName(hits.select("run_id", F.col("lo").alias("pos"), F.struct("hi", "n").alias("_hit")), allowMissingColumns=True)
    w = Window.partitionBy("run_id").orderBy("pos", F.col("_hit").isNull())  # an interval stands before its first line
    both = both.withColumns({"_hi": F.last("_hit.hi", True).over(w), "_no": F.count("_hit").over(w), "_sum": F.coalesce(F.sum("_hit.n").over(w), F.lit(0)), "_end": F.lead("pos").over(w).isNull()})
    return both.where("_hit IS NULL").drop("_hit")

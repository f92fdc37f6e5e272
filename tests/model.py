"""Plain models of the ordered stages as an oracle for random streams."""

from itertools import accumulate, pairwise


def dedup(lines, free, key, min_run, window, min_bytes=24):
    """Texts that the dedup stage keeps, from its closed form: islands of equal keys first, then each key's islands together.

    free: whether a line may be dropped; key: its comparison key.
    """
    run, allowed = (min_run if min_run >= 2 else 3), max(2, min_run - 1)
    keys = [key(t) if free(t) else None for t in lines]
    cuts = [i for i, k in enumerate(keys) if i == 0 or k is None or k != keys[i - 1]] + [len(lines)]
    islands = [(a, b) for a, b in pairwise(cuts) if keys[a] is not None and lines[a].strip()]
    # A key's islands are told apart by where they are settled: at the next line if that may be dropped too, else at their own last.
    settled = {(a, b): b + (b < len(lines) and keys[b] is not None) for a, b in islands}
    hidden, extra = set(), {}
    for k in dict.fromkeys(keys[a] for a, _ in islands):
        own = [x for x in islands if keys[x[0]] == k]
        gaps = [window + 1] + [settled[y] - settled[x] for x, y in pairwise(own)]
        near = [b - a < run and window > 0 and len(lines[a].encode()) >= min_bytes and gap <= window for (a, b), gap in zip(own, gaps, strict=True)]
        seen = accumulate((2 if x else 1 for x in near), initial=0)
        gone = [x for x, close, n in zip(own, near, seen, strict=False) if close and n + 1 > allowed]
        hidden.update(gone)
        if gone:
            extra[own[0][0]] = sum(b - a for a, b in gone)
    starts = {a: b for a, b in islands}
    out = []
    for a, b in pairwise(cuts):
        n = b - a
        if a not in starts:  # fixed lines are alone, blank ones shrink to one
            out.append(lines[a])
        elif (a, b) not in hidden:
            out += [lines[a], f"[m] ×{n} similar {_lines(n)} collapsed"] if n >= run else [lines[a]] * n
    for a, n in extra.items():
        text = lines[a].strip()
        out.append(f"[m] ×{n} further similar {_lines(n)}: {text[:70] + '…' if len(text) > 70 else text}")
    return out


def _lines(n):
    return "line" if n == 1 else "lines"


def head_tail(n, protected, head, tail):
    """Numbers of the lines kept, and the markers' places: (before which kept line, text)."""
    first_tail = max(head, n - tail)
    skipped = sum(not protected[i] for i in range(head, first_tail))
    middle = [i for i in range(head, first_tail) if protected[i]]
    word = lambda k: "line" if k == 1 else "lines"
    out = list(range(min(head, n)))
    if skipped:
        if middle:
            out += [f"[m] ... {skipped} {word(skipped)} elided; failures from the middle follow ...", *middle]
            out.append(f"[m] ... resuming at the last {n - first_tail} {word(n - first_tail)} ...")
        else:
            out.append(f"[m] ... {skipped} {word(skipped)} elided ...")
    else:
        out += middle
    return out + list(range(first_tail, n))


def blocks(rows):
    """rows: dicts blank, start, end, detail, indent -> number of the block or None."""
    out, number, depth = [], 0, None
    for r in rows:
        if depth is not None and (r["blank"] or (not r["end"] and (r["indent"] > depth or (not r["start"] and r["detail"])))):
            out.append(number)
            continue
        depth = None
        if r["start"] and not r["end"]:
            number, depth = number + 1, r["indent"]
            out.append(number)
        else:
            out.append(None)
    return out


def passing_tests(rows):
    """rows: dicts in_block, solid, fail, head, stays, tap, indent -> 1 for a dropped result, 2 for what it hushes, else 0."""
    out, failing, hush = [], False, None
    for r in rows:
        if hush is not None and not r["in_block"] and not r["solid"] and r["indent"] > hush:
            out.append(2)
            continue
        hush = None
        if r["in_block"]:
            out.append(0)
            continue
        failing = r["fail"] or (failing and not r["head"])
        goes = not failing and not r["stays"]
        hush = r["indent"] if goes and r["tap"] else None
        out.append(int(goes))
    return out

"""The duplexes of a sequence by a plain walk, element by element: what the search on tiles is held against."""

from __future__ import annotations

from collections.abc import Iterator

from strandloom.functions import energy as E
from strandloom.operators.search import FoldOptions


def traverse(seq: str, o: FoldOptions, other: str | None = None, tables: E.Loops | None = None) -> Iterator[tuple[int, int, str, str, float]]:
    """(i, k, l, r, energy) of every path: from each outer pair inward, with at most one bulge run and one mismatch run.

    With ``other`` the right arm is taken from that sequence and distances do not count. A mismatch run does not follow a
    bulge; either opens only while the energy is under the gate; complementary bases are never a mismatch.
    """
    tables = tables or E.Loops()
    right = other if other is not None else seq

    def walk(i, k, path, now, b_left, m_left, state, run, side):
        last = path[-1]
        if state == "P":
            dist = (k + 1) - i0 - 1  # both from 0: the right arm now begins at k + 1
            if other is None and dist < o.lo:
                return
            if (other is not None or dist <= o.hi) and len(path) >= 1:
                l, r = "".join(a for a, _ in path), "".join(b for _, b in path)  # noqa: E741
                e = E.signif(now + E.weak_end("".join(last)) + E.symmetry(l, r) + E.INITIATION)
                if e < o.minfold:
                    yield i0 + 1, k0 + 1, l, r, e
        used_l, used_r = i - i0, k0 - k
        can_l = i < len(seq) and used_l < o.depth
        can_r = k >= 0 and used_r < o.depth and (other is not None or k > i0)
        if can_l and can_r:
            x, y = seq[i], right[k]
            if x + y in E.PAIRS:
                path.append((x, y))
                if state == "P":
                    more = E.STACK["".join(path[-2])][x + y]
                else:
                    start = len(path) - 2
                    while E.element_kind(*path[start]) != "P":
                        start -= 1
                    mixed = any(E.element_kind(*c) == "M" for c in path[start + 1 : -1])
                    more = E.loop(path, start, len(path) - 1, tables) if mixed else E.bulge(path, start, len(path) - 1)
                yield from walk(i + 1, k - 1, path, now + more, b_left, m_left, "P", 0, 0)
                path.pop()
            elif x in "ACGU" and y in "ACGU" and (state == "P" and m_left and now < o.gate or state == "M" and run < o.mismatch_max):
                path.append((x, y))
                yield from walk(i + 1, k - 1, path, now, b_left, False, "M", run + 1 if state == "M" else 1, 0)
                path.pop()
        opens = state in "PM" and b_left and now < o.gate
        if can_l and seq[i] in "ACGU" and (opens or state == "B" and side == 1 and run < o.bulge_max):
            path.append((seq[i], "-"))
            yield from walk(i + 1, k, path, now, False, m_left, "B", run + 1 if state == "B" else 1, 1)
            path.pop()
        if can_r and right[k] in "ACGU" and (opens or state == "B" and side == 2 and run < o.bulge_max):
            path.append(("-", right[k]))
            yield from walk(i, k - 1, path, now, False, m_left, "B", run + 1 if state == "B" else 1, 2)
            path.pop()

    for i0, x in enumerate(seq):
        for k0 in range(len(right) - 1, -1 if other is not None else i0, -1):
            if x + right[k0] in E.PAIRS:
                yield from walk(i0 + 1, k0 - 1, [(x, right[k0])], E.weak_end(x + right[k0]), o.bulge_max > 0, o.mismatch_max > 0, "P", 0, 0)

"""Nearest-neighbour free energies of duplex paths, kcal/mol at 37 degrees.

The parameters are stated here. The tables of 1x1, 1x2 and 2x2 internal loops have thousands of values; ``Loops`` builds
them from the published rules and the measured loops that these take as given: ends, first mismatches and UU for 1x1 and
1x2; for 2x2 the mean of the two symmetric loops that share a closing pair and mismatch with it, and a correction for
what stands side by side (Xia, Mathews and Turner 1999; Mathews et al. 2004). ``Loops.from_json`` takes other values.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Xia et al. 1998 (stacks, initiation, symmetry, end), Mathews et al. 2004 (bulges and loops).
RT, INITIATION, SYMMETRY, AU_END = 0.616, 4.09, 0.43, 0.45
BULGE_EXCEPTION, AU_CLOSURE, ASYMMETRY = -0.9, 0.7, 0.6
STACK = {
    "AU": {"AU": -0.9, "UA": -1.1, "CG": -2.2, "GC": -2.1, "GU": -0.6, "UG": -1.4},
    "CG": {"AU": -2.1, "UA": -2.1, "CG": -3.3, "GC": -2.4, "GU": -1.4, "UG": -2.1},
    "GC": {"AU": -2.4, "UA": -2.2, "CG": -3.4, "GC": -3.3, "GU": -1.5, "UG": -2.5},
    "GU": {"AU": -1.3, "UA": -1.4, "CG": -2.5, "GC": -2.1, "GU": -0.5, "UG": 1.3},
    "UA": {"AU": -1.3, "UA": -0.9, "CG": -2.4, "GC": -2.1, "GU": -1.0, "UG": -1.3},
    "UG": {"AU": -1.0, "UA": -0.6, "CG": -1.5, "GC": -1.4, "GU": 0.3, "UG": -0.5},
}
BULGE_INITIATION = [3.8, 2.8, 3.2, 3.6, 4.0, 4.4, 4.6, 4.7, 4.8, 4.9, 5.0, 5.1, 5.2, 5.3, 5.4, 5.4, 5.5, 5.5, 5.6, 5.7, 5.7, 5.8, 5.8, 5.8, 5.9, 5.9, 6.0, 6.0, 6.0, 6.1]
LOOP_INITIATION = [0.0, 0.0, 0.0, 1.1, 2.0, 2.0, 2.1, 2.3, 2.4, 2.5, 2.6, 2.7, 2.8, 2.9, 2.9, 3.0, 3.1, 3.1, 3.2, 3.3, 3.3, 3.4, 3.4, 3.5, 3.5, 3.5, 3.6, 3.6, 3.7, 3.7]
# Stabilising terminal mismatches (5' base, 3' base) of 2x3 loops behind a purine-pyrimidine and another pair, and of other loops.
RY_2X3 = {"GA": -1.2, "GG": -0.8, "UU": -0.7}
YR_2X3 = {"AG": -0.5, "GA": -1.1, "GG": -0.8, "UU": -0.7}
OTHER_LOOP = {"AG": -0.8, "GA": -1.0, "GG": -1.2, "UU": -0.7}

WEAK = {"AU", "UA", "GU", "UG"}
PAIRS = {"AU", "UA", "CG", "GC", "GU", "UG"}


# Measured 1x1 loops by outer and inner pair (rows: 5' base A, C, G, U; columns: 3' base A, C, G, U).
SINGLE = {
    "CG.CG": ((0.9, -0.4, 0.5, 0.5), (0.3, 0.5, 0.5, 0.6), (-0.1, 0.5, -2.2, 0.5), (0.5, 0.0, 0.5, -0.1)),
    "CG.GC": ((0.9, 0.5, 0.5, 0.5), (0.5, 0.5, 0.5, 0.5), (0.5, 0.5, -1.4, 0.5), (0.5, 0.5, 0.5, 0.4)),
    "CG.GU": ((2.2, 1.3, 1.2, 1.2), (1.2, 1.7, 1.2, 1.2), (1.2, 1.2, -1.4, 1.2), (1.2, 1.2, 1.2, 1.1)),
    "CG.UG": ((0.6, 0.5, 1.2, 1.2), (1.2, 1.2, 1.2, 1.2), (-0.2, 1.2, -1.4, 1.2), (1.2, 1.0, 1.2, 1.1)),
    "GC.CG": ((0.8, 0.5, 0.5, 0.5), (0.5, 0.5, 0.5, 0.5), (0.5, 0.5, -2.3, 0.5), (0.5, 0.5, 0.5, -0.6)),
    "GC.GU": ((1.6, 1.2, 1.0, 1.2), (1.2, 1.2, 1.2, 1.2), (1.2, 1.2, -1.4, 1.2), (1.2, 1.2, 1.2, 0.7)),
    "GC.UG": ((1.9, 1.2, 1.5, 1.2), (1.2, 1.2, 1.2, 1.2), (1.2, 1.2, -1.4, 1.2), (1.2, 1.2, 1.2, 1.5)),
}
# 1x1 loops of U and U, by outer and inner pair.
SINGLE_UU = {
    "AU.AU": 1.5, "AU.CG": 0.8, "AU.GC": 0.8, "AU.UA": 1.2, "AU.GU": 1.6, "AU.UG": 1.2,
    "UA.AU": 1.7, "UA.CG": 1.2, "UA.GC": 1.2, "UA.GU": 1.9, "UA.UG": 1.6, "GU.GU": 1.6, "GU.UG": 1.2, "UG.GU": 1.9,
}
# 1x2 loops with no, one and two weak ends: unmatched, with a purine mismatch, and with U and U.
DOUBLE = ((2.3, 1.1, 1.5), (3.0, 1.9, 2.2), (3.7, 2.6, 3.0))
# Measured 1x2 loops: mismatch + 3' base, between CG and CG, and between GC or GU and GC or GU.
DOUBLE_CG = {"AA+A": 2.5, "GA+A": 1.7, "GG+A": 0.8, "AC+C": 1.7, "CC+C": 2.5, "UC+C": 2.2, "AA+G": 0.8, "GA+G": 1.2, "CA+U": 2.5, "UC+U": 1.7, "UU+U": 1.4}
DOUBLE_G = {"AA+A": 2.5, "AG+A": 2.1, "AA+G": 1.2, "CC+U": 1.9}
# Symmetric 2x2 loops, closed by the pair at both ends, by the mismatch next to it.
MISMATCHES = ("AA", "AC", "AG", "CA", "CC", "CU", "GA", "GG", "UC", "UU")
TANDEM = {
    "AU": (2.8, 2.5, 1.7, 2.3, 2.4, 2.4, 0.3, 1.9, 2.4, 0.6),
    "CG": (1.2, 2.0, -0.7, 1.1, 1.7, 1.4, -0.7, 0.8, 1.4, -0.4),
    "GC": (1.5, 0.9, -1.3, 1.0, 1.0, 1.1, -2.6, 0.8, 1.0, -0.5),
    "UA": (2.8, 2.8, 0.9, 1.9, 2.8, 2.2, 0.7, 2.3, 2.8, 1.1),
    "GU": (4.1, 3.4, 2.6, 3.4, 3.4, 3.4, 1.8, 3.4, 3.4, 3.4),
    "UG": (2.1, 2.8, 3.4, 2.8, 2.8, 2.8, 0.1, 2.8, 2.8, 2.8),
}
# Corrections for mismatches side by side: GG and one that is none of G and A or U and U; two of a purine
# pair and pyrimidines; AA and UU.
BESIDE_GG, BESIDE_PURINES, BESIDE_UU = -1.3, 0.6, 0.6
# Measured 2x2 loops between CG and CG (rows: the first mismatch, columns: the second, in the order above).
TANDEM_CG = (
    (1.3, 1.1, -0.3, 1.0, 1.1, 1.1, 0.4, -0.3, 1.1, 1.5),
    (0.6, 1.5, 0.1, 0.5, 1.5, 1.5, 0.3, -0.3, 1.5, 0.0),
    (0.0, -0.7, -1.6, -1.0, -0.6, 0.7, -0.7, 0.0, 0.8, 0.9),
    (1.3, 1.0, -0.7, 1.1, 1.0, 1.0, 0.7, -0.4, 1.1, -0.2),
    (2.2, 1.3, 0.7, 1.9, 1.3, 1.3, 0.7, -0.1, 1.4, -0.1),
    (1.4, 1.2, 0.0, 1.1, 1.2, 1.7, 0.6, 0.2, 1.2, 0.2),
    (-0.2, -0.4, -1.7, 0.7, 0.7, 0.7, -0.5, -0.3, 0.8, 0.9),
    (-0.1, -0.4, -0.9, -0.5, -0.4, 0.2, -0.3, 0.8, -0.5, 1.4),
    (1.4, 1.2, 0.0, 1.1, 1.2, 1.2, 0.5, -0.6, 1.2, 0.4),
    (1.4, 0.3, 0.5, 0.3, 0.3, 0.3, 1.4, 0.7, 0.3, -0.6),
)
# Measured 2x2 loops between GU and GU.
TANDEM_GU = {"AA.AA": 3.6, "AA.AG": 2.2, "AG.AA": 3.6, "GA.AG": 0.2}


@dataclass
class Loops:
    """Energies of 1x1, 1x2 and 2x2 loops. A key of ``given`` values, which go before the rules, is the outer pair, the
    loop and the inner pair, as ``AU.AA.AU``; for 1x2 ``AU.AA+C.AU``: the mismatch, then the unpaired base on the 3' side."""

    given: dict[str, float] = field(default_factory=dict)

    @classmethod
    def from_json(cls, path: str) -> Loops:
        with open(path) as f:
            return cls({k: float(v) for k, v in json.load(f).items()})

    def one_by_one(self, p: str, m: str, q: str) -> float:
        if (key := f"{p}.{m}.{q}") in self.given:
            return self.given[key]
        # a loop read from its other end is the same loop
        for a, x, b in ((p, m, q), (q[::-1], m[::-1], p[::-1])):
            if rows := SINGLE.get(f"{a}.{b}"):
                return rows["ACGU".index(x[0])]["ACGU".index(x[1])]
            if m == "UU" and f"{a}.{b}" in SINGLE_UU:
                return SINGLE_UU[f"{a}.{b}"]
        return ((0.5, 1.2, 1.9) if m != "GG" else (-2.1, -1.4, -0.7))[(p in WEAK) + (q in WEAK)]

    def one_by_two(self, p: str, m: str, base: str, q: str) -> float:
        if (key := f"{p}.{m}+{base}.{q}") in self.given:
            return self.given[key]
        if p == q == "CG" and f"{m}+{base}" in DOUBLE_CG:
            return DOUBLE_CG[f"{m}+{base}"]
        if p in ("GC", "GU") and q in ("GC", "GU") and f"{m}+{base}" in DOUBLE_G:
            return DOUBLE_G[f"{m}+{base}"]
        plain, purines, uu = DOUBLE[(p in WEAK) + (q in WEAK)]
        x, y = m
        if x == "U" and "U" in (y, base):
            return uu
        beside_p = x == "G" and y in "AG" or x == "A" and y == "G" and not _purine_first(p)
        beside_q = base == "G" and x in "AG" or base == "A" and x == "G" and _purine_first(q)
        return purines if beside_p or beside_q else plain

    def two_by_two(self, p: str, m: str, n: str, q: str) -> float:
        if (key := f"{p}.{m}.{n}.{q}") in self.given:
            return self.given[key]
        for a, x, y, b in ((p, m, n, q), (q[::-1], n[::-1], m[::-1], p[::-1])):
            if a == b == "CG":
                return TANDEM_CG[MISMATCHES.index(x)][MISMATCHES.index(y)]
            if a == b == "GU" and f"{x}.{y}" in TANDEM_GU:
                return TANDEM_GU[f"{x}.{y}"]
        total = TANDEM[p][MISMATCHES.index(m)] + TANDEM[q[::-1]][MISMATCHES.index(n[::-1])]
        both = {m, n}
        if "GG" in both and both & {"AA", "AC", "CA", "CC", "CU", "UC"}:
            total += 2 * BESIDE_GG
        elif both & {"AG", "GA"} and both & {"CC", "CU", "UC"}:
            total += 2 * BESIDE_PURINES
        elif both == {"AA", "UU"}:
            total += 2 * BESIDE_UU
        # to a tenth, halves towards zero
        return int(round(10 * total) / 2) / 10


def weak_end(pair: str, penalty: float = AU_END) -> float:
    return penalty if pair in WEAK else 0.0


def _purine_first(pair: str) -> bool:
    return pair in ("AU", "GC", "GU")


def element_kind(a: str, b: str) -> str:
    return "B" if "-" in (a, b) else "P" if a + b in PAIRS else "M"


def five_three(loop: list[tuple[str, str]], last: bool = False) -> tuple[str, str]:
    """The first (or last) base on either side of a loop; a bulge overrides an earlier base of its side, a mismatch does not."""
    five = three = ""
    for a, b in reversed(loop) if last else loop:
        if "-" in (a, b):
            if a != "-":
                five = a
            else:
                three = b
        else:
            five, three = five or a, three or b
    return five, three


def bulge(path: list[tuple[str, str]], start: int, stop: int) -> float:
    """A bulge between the pairs at start and stop; pairs before and after it with the bulged base add states."""
    p, q = "".join(path[start]), "".join(path[stop])
    first, last = path[start + 1], path[stop - 1]
    total = 0.0
    if (p == "CG" and first == ("C", "-")) or (p == "GC" and first == ("-", "C")) or (q == "CG" and last == ("C", "-")) or (q == "GC" and last == ("-", "C")):
        total += BULGE_EXCEPTION
    size = stop - start - 1
    if size > 1:
        return total + weak_end(p) + weak_end(q) + BULGE_INITIATION[size - 1]
    side = 0 if first[1] == "-" else 1
    states, base = 1, first[side]
    for step, at in ((-1, start), (1, stop)):
        # on the right the path ends at the closing pair
        while 0 <= at <= stop and element_kind(*path[at]) == "P" and path[at][side] == base:
            states, at = states + 1, at + step
    return total + BULGE_INITIATION[0] + STACK[p][q] - RT * math.log(states)


def loop(path: list[tuple[str, str]], start: int, stop: int, tables: Loops) -> float:
    """An internal loop with mismatches, and perhaps bulges, between the pairs at start and stop."""
    p, q = "".join(path[start]), "".join(path[stop])
    inner = path[start + 1 : stop]
    kinds = [element_kind(*x) for x in inner]
    m, b = kinds.count("M"), kinds.count("B")
    closure = weak_end(p, AU_CLOSURE) + weak_end(q, AU_CLOSURE)
    if not b:
        if m == 1:
            return tables.one_by_one(p, "".join(inner[0]), q)
        if m == 2:
            return tables.two_by_two(p, "".join(inner[0]), "".join(inner[1]), q)
        return closure + LOOP_INITIATION[2 * m - 1]
    if m == 1 and b == 1:
        at = kinds.index("M")
        (x, y), bulged = inner[at], inner[1 - at]
        base = bulged[0] if bulged[1] == "-" else bulged[1]
        if bulged[0] == "-":  # on the 3' side
            return tables.one_by_two(p, x + y, base, q) if at == 0 else tables.one_by_two(p, x + base, y, q)
        return tables.one_by_two(q[::-1], y + x, base, p[::-1]) if at == 1 else tables.one_by_two(q[::-1], y + base, x, p[::-1])
    total = closure + LOOP_INITIATION[2 * m + b - 1] + ASYMMETRY * b
    if m >= 2:
        i, j = five_three(inner)
        h, k = five_three(inner, last=True)
        if m == 2 and b == 1:
            total += (RY_2X3 if _purine_first(p) else YR_2X3).get(i + j, 0.0)
            total += (RY_2X3 if _purine_first(q[::-1]) else YR_2X3).get(k + h, 0.0)
        else:
            total += OTHER_LOOP.get(i + j, 0.0) + OTHER_LOOP.get(k + h, 0.0)
    return total


def running_energies(l: str, r: str, tables: Loops | None = None) -> list[float]:  # noqa: E741
    """The energy after each element: first the end penalty, then stacks and motifs as pairs close them."""
    tables = tables or Loops()
    path = list(zip(l, r, strict=True))
    out, now, before = [], 0.0, -1
    for i, (a, b) in enumerate(path):
        if element_kind(a, b) == "P":
            if before < 0:
                now += weak_end(a + b) if i == 0 else 0.0
            elif before == i - 1:
                now += STACK["".join(path[before])][a + b]
            elif any(element_kind(*x) == "M" for x in path[before + 1 : i]):
                now += loop(path, before, i, tables)
            else:
                now += bulge(path, before, i)
            before = i
        out.append(now)
    return out


def signif(x: float, digits: int = 5) -> float:
    return 0.0 if x == 0 else round(x, digits - 1 - math.floor(math.log10(abs(x))))


def symmetry(l: str, r: str) -> float:  # noqa: E741
    """The penalty of a path that reads the same from its other end, but for a middle element."""
    n = len(l)
    return SYMMETRY if all(l[i] == r[n - 1 - i] and r[i] == l[n - 1 - i] for i in range(n // 2)) else 0.0


def path_energy(l: str, r: str, tables: Loops | None = None) -> float:  # noqa: E741
    """The free energy of a whole path; 0 for an empty one."""
    if not l:
        return 0.0
    return signif(running_energies(l, r, tables)[-1] + weak_end(l[-1] + r[-1]) + symmetry(l, r) + INITIATION)


# --- column expressions -----------------------------------------------------------------------------------------------


def stack_map() -> Column:
    """Pair and next pair (four letters) to the stacking energy, as a constant map."""
    return F.create_map(*(F.lit(x) for p, row in STACK.items() for q, e in row.items() for x in (p + q, e)))


def stack(p: Column, q: Column) -> Column:
    return F.try_element_at(stack_map(), F.concat(p, q))


def end_penalty(pair: Column, penalty: float = AU_END) -> Column:
    return F.when(pair.isin(*sorted(WEAK)), penalty).otherwise(0.0)


def small_loops(tables: Loops | None = None) -> list[tuple[str, str, str, str, float]]:
    """(outer pair, 5' bases, 3' bases, inner pair, energy) of every 1x1, 1x2, 2x1 and 2x2 loop without pairs; each arm 5' to 3'."""
    t, out, bases = tables or Loops(), [], "ACGU"
    for p in sorted(PAIRS):
        for q in sorted(PAIRS):
            for m in MISMATCHES:
                out.append((p, m[0], m[1], q, t.one_by_one(p, m, q)))
                out += [(p, m[0], c + m[1], q, t.one_by_two(p, m, c, q)) for c in bases if m[0] + c not in PAIRS]
                # the other arm is the longer one: the loop as it is read from its inner pair
                out += [(p, c + m[1], m[0], q, t.one_by_two(q[::-1], m, c, p[::-1])) for c in bases if m[0] + c not in PAIRS]
                out += [(p, m[0] + n[0], n[1] + m[1], q, t.two_by_two(p, m, n, q)) for n in MISMATCHES]
    return out


def helix_energy(l: Column, r: Column) -> Column:  # noqa: E741
    """Of a path of pairs only, not rounded; one pass over its letters."""
    n = F.length(l)
    pairs = F.zip_with(F.split(l, ""), F.split(r, ""), lambda a, b: F.concat(a, b))
    steps = F.zip_with(pairs, F.slice(pairs, 2, F.greatest(n - 1, F.lit(1))), lambda p, q: F.coalesce(stack(p, q), F.lit(0.0)))
    body = F.aggregate(steps, F.lit(0.0), lambda acc, e: acc + e)
    half = F.floor(n / 2).cast("int")
    same = F.substr(l, F.lit(1), half) == F.substr(F.reverse(r), F.lit(1), half)
    same = same & (F.substr(r, F.lit(1), half) == F.substr(F.reverse(l), F.lit(1), half))
    first, last = F.concat(F.left(l, F.lit(1)), F.left(r, F.lit(1))), F.concat(F.right(l, F.lit(1)), F.right(r, F.lit(1)))
    return F.when(n == 0, 0.0).otherwise(end_penalty(first) + body + end_penalty(last) + F.when(same, SYMMETRY).otherwise(0.0) + INITIATION)

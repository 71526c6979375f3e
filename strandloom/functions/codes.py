"""Nucleotides, base pairs and duplex paths as column expressions.

A path is two strings of equal length read from the outer pair inward, ``l`` the 5' arm and ``r`` the 3' arm; ``-`` on
one side is a bulge of the other. Kinds: pair (AU, UA, CG, GC, GU, UG), mismatch (the other ten), bulge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet in code order, and the six pairs in the order of the energy tables.
BASES = "ACGU"
PAIRS = ("AU", "CG", "GC", "UA", "GU", "UG")


def code(base: Column) -> Column:
    """1 to 4 for A, C, G, U; 0 for a gap or anything else."""
    return F.greatest(F.instr(F.lit(BASES), F.when(F.length(base) == 1, base).otherwise("?")), F.lit(0))


def one_hot(base: Column) -> Column:
    """A=1, C=2, G=4, U=8, gap 0."""
    c = code(base)
    return F.when(c > 0, F.expr("shiftleft(1, 0)") * F.pow(F.lit(2), c - 1).cast("int")).otherwise(0)


def pair_index(l: Column, r: Column) -> Column:  # noqa: E741
    """1 to 16: four times the left base and the right one."""
    return 4 * (code(l) - 1) + code(r)


def bulge_index(l: Column, r: Column) -> Column:  # noqa: E741
    """1 to 8: the base, and four more on the 3' side."""
    return F.when(r == "-", code(l)).otherwise(4 + code(r))


def packed(l: Column, r: Column) -> Column:  # noqa: E741
    """A path element in eight bits: the left base's one-hot code above the right one's; a gap has none."""
    return F.shiftleft(one_hot(l), 4).bitwiseOR(one_hot(r))


def unpacked(code: Column) -> tuple[Column, Column]:
    """The two bases of a packed element."""
    base = lambda x: F.when(x == 0, "-").otherwise(F.substr(F.lit("ACGU"), F.log2(x.cast("double")).cast("int") + 1, F.lit(1)))
    return base(F.shiftright(code, 4)), base(code.bitwiseAND(15))


def kind(l: Column, r: Column) -> Column:  # noqa: E741
    return F.when((l == "-") | (r == "-"), "bulge").when(F.concat(l, r).isin(*PAIRS), "pair").otherwise("mismatch")


def purine_pyrimidine(l: Column, r: Column) -> Column:  # noqa: E741
    return F.concat(l, r).isin("AU", "GC", "GU")


def rna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "T", "U")


def dna_only(text: Column) -> Column:
    """The A, C, G and T of a text, upper-cased, and nothing else."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))


def reverse_complement(seq: Column) -> Column:
    """For DNA; other characters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def reflect(x: Column, n: Column) -> Column:
    """The position from the other end, both from 1."""
    return n - x + 1


def elements(l: Column, r: Column) -> Column:  # noqa: E741
    """The kinds of a path's elements, as an array."""
    return F.zip_with(F.split(l, ""), F.split(r, ""), kind)


def count_kind(l: Column, r: Column, what: str) -> Column:  # noqa: E741
    return F.size(F.filter(elements(l, r), lambda x: x == what))


def arm(side: Column) -> Column:
    """A side's bases without the gaps."""
    return F.replace(side, F.lit("-"), F.lit(""))


def brackets(l: Column, r: Column) -> tuple[Column, Column]:  # noqa: E741
    """(sequence, structure): the arms 5' to 3' joined by ``&``; ``(`` and ``)`` for pairs, a space for what is unpaired."""
    zipped = F.zip_with(F.split(l, ""), F.split(r, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    side = lambda f, mark: F.array_join(F.transform(F.filter(zipped, lambda x: x[f] != "-"), lambda x: F.when(kind(x["a"], x["b"]) == "pair", mark).otherwise(" ")), "")
    return F.concat(arm(l), F.lit("&"), F.reverse(arm(r))), F.concat(side("a", "("), F.lit("&"), F.reverse(side("b", ")")))


def drawing(l: Column, r: Column, energy: Column) -> Column:  # noqa: E741
    """A duplex as four lines of text: what is unpaired above and below, the pairs between; the energy after them."""
    zipped = F.zip_with(F.split(l, ""), F.split(r, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pick = lambda f: F.array_join(F.transform(zipped, f), "")
    is_pair = lambda x: kind(x["a"], x["b"]) == "pair"
    paired = lambda side: pick(lambda x: F.when(is_pair(x), x[side]).otherwise(" "))
    loose = lambda side: pick(lambda x: F.when(is_pair(x) | (x[side] == "-"), " ").otherwise(x[side]))
    lines = [F.concat(F.lit("   "), loose("a")), F.concat(F.lit("5' "), paired("a"), F.lit(" 3'")), F.concat(F.lit("3' "), paired("b"), F.lit(" 5'  \u0394G = "), energy.cast("string")), F.concat(F.lit("   "), loose("b"))]
    return F.concat_ws("\n", *lines)


def alignment_brackets(l: Column, r: Column) -> Column:  # noqa: E741
    """The structure over an alignment's columns, left arm and then right arm 5' to 3': brackets for pairs and mismatches, points for bulges."""
    side = lambda own, other, mark: F.array_join(F.zip_with(F.split(own, ""), F.split(other, ""), lambda a, b: F.when(a == "-", "").when(b == "-", ".").otherwise(mark)), "")
    return F.concat(side(l, r, "("), F.reverse(side(r, l, ")")))


def bin_key(value: Column, size: int = 50) -> Column:
    return F.floor(value / size) * size + 1


def signif(x: Column, digits: int = 5) -> Column:
    """x rounded to so many significant digits."""
    p = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * p) / p)

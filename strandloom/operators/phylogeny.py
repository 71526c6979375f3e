"""Likelihoods of alignment columns on a tree, scores of duplexes, covariance and entropy.

Columns repeat: the likelihood is computed once for each distinct pattern of bases over the leaves, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.codes import PAIRS
from strandloom.session import ship
from strandloom.sources.newick import Node

# A general time-reversible model of single sites.
SINGLE_Q = np.array(
    [
        [-3.349769077410539, 0.7275406347626509, 1.943150372974488, 0.679078069673400],
        [0.5982807571416286, -2.886424904723806, 0.5778864472526311, 1.710257700329546],
        [1.338779032790204, 0.4814930766087296, -2.232111455285279, 0.4118393458863448],
        [0.5410782831834724, 1.657519456685792, 0.4788413083474316, -2.677439048216696],
    ]
)
SINGLE_PI = np.full(4, 0.25)
# Fixed values of the paired model: frequencies of the 16 pairs AA, AC ... UU; rates of change between two pairings (to
# the second one), between a pairing and a mismatch (AU's neighbour AA), and between two mismatches (to AA).
PAIRED_PI = np.array([1.68548e-3, 3.99812e-3, 1.4503e-3, 0.158631, 4.07651e-3, 1.68548e-3, 0.229853, 2.07745e-3, 2.43023e-3, 0.24608, 2.11665e-3, 0.0495061, 0.235379, 2.19505e-3, 0.0549545, 3.88053e-3])
PAIRED_RATES = {
    ("AU", "CG"): 1.734136284173373e-07, ("AU", "GC"): 0.1156328001895630, ("AU", "GU"): 0.3939872967887371, ("AU", "UA"): 3.892347812199489e-07, ("AU", "UG"): 2.591700346017333e-06,
    ("CG", "GC"): 1.471669982351090e-07, ("CG", "GU"): 5.283847612750806e-07, ("CG", "UA"): 7.548943745833461e-02, ("CG", "UG"): 0.4033911627675549, ("GC", "GU"): 0.2883936505495478,
    ("GC", "UA"): 6.293871126712090e-08, ("GC", "UG"): 1.767868379592068e-07, ("GU", "UA"): 2.868760374276795e-06, ("GU", "UG"): 1.961592291594718e-05, ("UA", "UG"): 0.4020996700208706,
}
PAIR_TO_MISMATCH, MISMATCH_TO_MISMATCH = 2.716011990898361e-02, 1.331739324716268e-06


def paired_q() -> np.ndarray:
    """The 16 x 16 rates: an exchangeability times the target's frequency; rows add up to 0."""
    at = lambda p: 4 * "ACGU".index(p[0]) + "ACGU".index(p[1])
    paired = [at(p) for p in PAIRS]
    s = np.full((16, 16), MISMATCH_TO_MISMATCH / PAIRED_PI[0])
    s[paired, :] = s[:, paired] = PAIR_TO_MISMATCH / PAIRED_PI[0]
    for (a, b), rate in PAIRED_RATES.items():
        s[at(a), at(b)] = s[at(b), at(a)] = rate / PAIRED_PI[at(b)]
    q = s * PAIRED_PI[None]
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    return q


def expm(a: np.ndarray) -> np.ndarray:
    """The matrix exponential: a Taylor series of a scaled matrix, squared back."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    x = a / 2.0**k
    out, term = np.eye(len(a)), np.eye(len(a))
    for i in range(1, 19):
        term = term @ x / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def with_probabilities(tree: Node, q: np.ndarray) -> Node:
    """A tree whose nodes of positive length have P = exp(Q * length)."""
    out = tree.copy()
    for n in out.nodes():
        if n.length > 0:
            n.prob = expm(q * n.length)
    return out


def likelihoods(tree: Node, columns: np.ndarray, pi: np.ndarray, gapdenom: float = 1.0, pruning: str = "compat") -> np.ndarray:
    """Of each column (rows: columns, one state a leaf, -1 a gap). pruning "compat" applies an inner branch to either
    child's vector before they are multiplied; "standard" to the product."""
    order = {x: i for i, x in enumerate(tree.leaves())}
    states = len(pi)

    def visit(node: Node, branch: bool) -> np.ndarray:
        if node.children:
            a, b = (visit(c, True) for c in node.children)
            if branch and pruning == "compat":
                return (a @ node.prob.T) * (b @ node.prob.T)
            return (a * b) @ node.prob.T if branch else a * b
        state = columns[:, order[node.label]]
        out = node.prob.T[np.maximum(state, 0)]
        out = np.where((state < 0)[:, None], np.ones(states) / gapdenom, out)
        return out

    return visit(tree, False) @ pi


def _states(patterns: pd.Series, n: int) -> np.ndarray:
    """Codes of patterns of n letters; N and other letters count as A, a gap is -1."""
    code = np.zeros(256, np.int8)
    for i, letters in enumerate(("A", "C", "G", "TU")):
        code[[ord(c) for c in letters]] = i
    code[ord("-")] = -1
    return code[np.frombuffer("".join(patterns).encode("ascii", "replace"), np.uint8)].reshape(-1, n) if len(patterns) else np.zeros((0, n), np.int8)


def site_likelihoods(patterns: DataFrame, tree: Node, col: str = "pattern", q: np.ndarray = SINGLE_Q, pi: np.ndarray = SINGLE_PI, gapdenom: float = 1.0) -> DataFrame:
    """(pattern, likelihood) for each distinct pattern, a string of one base a leaf in the tree's order."""
    ship(patterns.sparkSession)
    model, n = with_probabilities(tree, q), len(tree.leaves())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({col: f[col], "likelihood": likelihoods(model, _states(f[col], n), pi, gapdenom)})

    return patterns.select(col).filter(F.length(col) == n).distinct().mapInPandas(run, f"{col} string, likelihood double")


def pair_likelihoods(patterns: DataFrame, tree: Node, first: str = "first", last: str = "last", q: np.ndarray | None = None, pi: np.ndarray = PAIRED_PI) -> DataFrame:
    """(first, last, likelihood) for each distinct pair of patterns; a gap in either is a gap."""
    ship(patterns.sparkSession)
    model, n = with_probabilities(tree, paired_q() if q is None else q), len(tree.leaves())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b = _states(f[first], n).astype(int), _states(f[last], n).astype(int)
            yield f.assign(likelihood=likelihoods(model, np.where((a < 0) | (b < 0), -1, 4 * a + b), pi))

    return patterns.select(first, last).filter((F.length(first) == n) & (F.length(last) == n)).distinct().mapInPandas(run, f"{first} string, {last} string, likelihood double")


def column_covariance(first: Column, last: Column) -> Column:
    """Covariance of two alignment columns given as strings of one base a species (Hofacker et al., 2002).

    Each pair of species that both pair there adds how many sides differ; the mean over pairs of species, times the share
    of species that pair. A gap pairs with nothing; letters other than C, G, T and U count as A.
    """
    norm = lambda c: F.translate(F.regexp_replace(c, "[^ACGTU-]", "A"), "U", "T")
    n = F.length(first)
    cells = F.zip_with(F.split(norm(first), ""), F.split(norm(last), ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    paired = F.filter(cells, lambda x: F.concat(x["a"], x["b"]).isin("AT", "TA", "CG", "GC", "GT", "TG"))
    differ = F.aggregate(paired, F.lit(0), lambda s, x: s + F.aggregate(paired, F.lit(0), lambda t, y: t + (x["a"] != y["a"]).cast("int") + (x["b"] != y["b"]).cast("int"))) / 2
    return F.when(n < 2, 0.0).otherwise(differ / (n * (n - 1) / 2) * (F.size(paired) / n))


def dinucleotide_entropy(seq: Column) -> Column:
    """Base-2 entropy of the dinucleotides of A, C, G and U (or T) in a sequence; 0 for fewer than two bases."""

    def entropy(rna: Column) -> Column:
        # looking ahead counts overlapping ones; each cell is one pass
        counts = F.array(*(F.regexp_count(rna, F.lit(f"{x}(?={y})")) for x in "ACGU" for y in "ACGU"))
        return F.element_at(F.transform(F.array(counts), of_counts), 1)

    def of_counts(counts: Column) -> Column:
        n = F.aggregate(counts, F.lit(0), lambda s, c: s + c)
        return F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))

    # as a lambda's argument the sequence and the counts are made once
    return F.element_at(F.transform(F.array(F.translate(seq, "T", "U")), entropy), 1)


def _columns(alignment: Column) -> Column:
    """An alignment (one string a species) as an array of its columns (one letter a species)."""
    letters = F.transform(alignment, lambda s: F.split(s, ""))
    return F.aggregate(F.slice(letters, 2, 1_000_000), F.element_at(letters, 1), lambda acc, s: F.zip_with(acc, s, lambda a, b: F.concat(a, b)))


def paired_columns(duplexes: DataFrame, key: str) -> DataFrame:
    """(key, at, first, last): the alignment's columns under each element of a path that is no bulge.

    ``alignment``: an array of strings, one a species, over the left arm and then the right arm, both 5' to 3'. A row's
    letters are walked once, and only the columns leave it.
    """
    cells = F.transform(F.zip_with(F.split("l", ""), F.split("r", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, i: F.struct(i.alias("at"), x["a"].alias("a"), x["b"].alias("b")))
    rows = duplexes.select(key, "l", cells.alias("cells"), _columns(F.col("alignment")).alias("cols"), F.length(F.replace("l", F.lit("-"), F.lit(""))).alias("n_left"))
    right = F.reverse(F.slice("cols", F.col("n_left") + 1, F.greatest(F.size("cols") - F.col("n_left"), F.lit(0))))

    def side(own: str, other: str, cols: Column) -> Column:
        # the side's bases in order, each with its column; then those that stand against a base
        met = F.zip_with(F.filter("cells", lambda x: x[own] != "-"), cols, lambda x, c: F.struct(x["at"].alias("at"), x[other].alias("other"), c.alias("c")))
        return F.filter(met, lambda x: x["at"].isNotNull() & (x["other"] != "-"))

    both = F.zip_with(side("a", "b", F.slice("cols", 1, F.col("n_left"))), side("b", "a", right), lambda x, y: F.struct(x["at"].alias("at"), x["c"].alias("first"), y["c"].alias("last")))
    # an empty arm splits into one empty letter, which is no element
    return rows.filter("l <> ''").select(key, F.explode(both).alias("x")).select(key, "x.*")


def duplex_scores(duplexes: DataFrame, key: str, single: Node, paired: Node) -> DataFrame:
    """(key, score): the sum of log2 likelihoods of the paired columns, less that of the two single columns."""
    cells = paired_columns(duplexes, key)
    one = site_likelihoods(cells.select(F.explode(F.array("first", "last")).alias("pattern")), single)
    two = pair_likelihoods(cells, paired).withColumnRenamed("likelihood", "p")
    a = one.select(F.col("pattern").alias("first"), F.col("likelihood").alias("x"))
    b = one.select(F.col("pattern").alias("last"), F.col("likelihood").alias("y"))
    return cells.join(two, ["first", "last"]).join(a, "first").join(b, "last").groupBy(key).agg(F.sum(F.log2("p") - F.log2("x") - F.log2("y")).alias("score"))


def duplex_covariance(duplexes: DataFrame, key: str) -> DataFrame:
    return paired_columns(duplexes, key).groupBy(key).agg(F.avg(column_covariance(F.col("first"), F.col("last"))).alias("covariance"))


def unstructured_scores(duplexes: DataFrame, key: str, single: Node, gapdenom: float = 1.0) -> DataFrame:
    """(key, score): the sum of log2 likelihoods of all columns of the alignment, each as a single site."""
    cols = duplexes.select(key, F.explode(_columns(F.col("alignment"))).alias("pattern"))
    one = site_likelihoods(cols, single, gapdenom=gapdenom)
    return cols.join(one, "pattern").groupBy(key).agg(F.sum(F.log2("likelihood")).alias("score"))

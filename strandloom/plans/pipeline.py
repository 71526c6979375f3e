"""The whole analysis: alignments and genes to scored duplexes, outliers and BED12 lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import codes
from strandloom.operators import anomaly, folding, intervals, phylogeny
from strandloom.session import cut
from strandloom.sources import maf, newick, regions


@dataclass(frozen=True)
class PipelineConfig:
    """The command line's options. Trees: Newick text; ``conserved_scale`` multiplies the conserved and paired trees' branches.

    ``conserved_single``: unpaired columns are held against the conserved tree (for conserved regions). ``supported_only``: duplexes
    whose paired model is less likely than two single ones go. ``maf_base``: 0 takes block positions as they are (as the published pipeline does), 1 adds one.
    """

    tree: str
    conserved_scale: float = 0.33
    minlength: int = 18
    minspecies: int = 2
    minscore: float = float("-inf")
    max_distance: int = 2000
    min_distance: int = 3
    depth: int = 50
    max_bulges: int = 3
    max_mismatches: int = 3
    max_deltag: float = -8.0
    contamination: float = 0.05
    flank: int = 25
    dedup_identity: float = 0.99
    name: str = "duplexes"
    maf_base: int = 0
    conserved_single: bool = False
    supported_only: bool = False
    heuristic: tuple = field(default=anomaly.HEURISTIC)


def blocks(text: DataFrame, genes: DataFrame, c: PipelineConfig, conserved: DataFrame | None = None) -> DataFrame:
    """Merged blocks over genes (and conserved regions, widened by the flank), one row a gene and block, on the gene's strand."""
    leaves = newick.parse(c.tree).leaves()
    read = cut(maf.without_reference_gaps(maf.parse(text, c.minlength, c.minscore)))  # read several times
    merged = maf.fill_species(maf.merge_adjacent(read, leaves, c.minspecies, c.minlength), leaves)
    n = F.length(F.col("alignment")[0])
    placed = merged.select("block_id", F.col("chr").alias("seqname"), (F.col("position") + c.maf_base).alias("first"), (F.col("position") + c.maf_base + n - 1).alias("last"), "alignment")
    if conserved is not None:
        wide = conserved.select("seqname", (F.col("first") - c.flank).alias("first"), (F.col("last") + c.flank).alias("last"))
        placed = intervals.overlaps(placed, [wide], "block_id")
    met = intervals.overlap_join(placed, genes.select("seqname", "first", "last", "name", "strand"))
    turned = F.when(F.col("b_strand") == "-", F.transform("alignment", codes.reverse_complement)).otherwise(F.col("alignment"))
    return met.select(F.concat_ws("|", F.col("b_name"), F.col("block_id").cast("string")).alias("seq_id"), F.col("b_name").alias("gene"), "seqname", "first", "last", F.col("b_strand").alias("strand"), turned.alias("alignment"), codes.rna(turned[0]).alias("seq"))


def duplexes(rows: DataFrame, c: PipelineConfig) -> DataFrame:
    """Folded, placed on the genome and without dominated rows; with the alignment's two arms."""
    # the distance counts on the genome, where on the minus strand the other arm is the first: arms differ by the bulges
    o = folding.FoldOptions(c.depth, c.min_distance - c.max_bulges, c.max_distance + c.max_bulges, c.max_bulges, c.max_mismatches, c.max_deltag)
    found = folding.fold(rows, o).join(rows.withColumnRenamed("seqname", "chromosome"), "seq_id")
    n_l, n_r = F.length(codes.arm(F.col("l"))), F.length(codes.arm(F.col("r")))
    i, k, size = F.col("i"), F.col("k"), F.length("seq")
    plus = F.col("strand") == "+"
    found = found.withColumns(
        {
            "seqname": F.col("chromosome"),
            "f_first": F.col("first") + F.when(plus, i - 1).otherwise(size - k),
            "f_last": F.col("first") + F.when(plus, i + n_l - 2).otherwise(size - k + n_r - 1),
            "l_first": F.col("first") + F.when(plus, k - n_r).otherwise(size - i - n_l + 1),
            "l_last": F.col("first") + F.when(plus, k - 1).otherwise(size - i),
            "n_pairs": codes.count_kind(F.col("l"), F.col("r"), "pair"),
            "alignment": F.transform("alignment", lambda s: F.concat(F.substr(s, i, n_l), F.substr(s, k - n_r + 1, n_r))),
            "duplex_id": F.concat_ws("|", "seq_id", i.cast("string"), k.cast("string"), "l", "r"),
        }
    )
    keep = ("duplex_id", "seqname", "strand", "gene", "f_first", "f_last", "l_first", "l_last", "l", "r", "energy", "n_pairs", "alignment")
    found = found.filter(intervals.arm_distance(F.col("f_first"), F.col("l_first")).between(c.min_distance, c.max_distance))
    return intervals.undominated(cut(found.select(*keep)), "duplex_id", c.dedup_identity)


def feature_rows(found: DataFrame, c: PipelineConfig) -> DataFrame:
    """duplex_id with dist, cons, deltag, npairs, entropy and covariance."""
    tree = newick.parse(c.tree)
    paired = tree.scaled(c.conserved_scale)
    scores = phylogeny.duplex_scores(found, "duplex_id", paired if c.conserved_single else tree, paired)
    if c.supported_only:
        scores = scores.filter("score >= 0")
    cov = phylogeny.duplex_covariance(found, "duplex_id")
    arm = codes.arm(F.col("l"))
    n = F.col("n_pairs")
    return found.join(scores, "duplex_id").join(cov, "duplex_id").select(
        "duplex_id", intervals.arm_distance(F.col("f_first"), F.col("l_first")).cast("double").alias("dist"), (F.col("score") / n).alias("cons"), F.col("energy").alias("deltag"), n.cast("double").alias("npairs"),
        (phylogeny.dinucleotide_entropy(arm) / (n + 5)).alias("entropy"), (F.col("covariance") * 10).alias("covariance"),
    )


def run(spark: SparkSession, maf_path: str, genes_path: str, c: PipelineConfig, out: str | None = None) -> DataFrame:
    """Outliers with their duplexes and BED12 lines; with ``out`` also features (TSV) and lines (text) written there."""
    rows = cut(blocks(maf.read_text(spark, maf_path), regions.load_bed(spark, genes_path), c))
    found = cut(duplexes(rows, c))
    features = cut(feature_rows(found, c))
    odd = anomaly.outliers(features, "duplex_id", c.contamination, heuristic=c.heuristic)
    best = found.join(odd, "duplex_id")
    if out:
        regions.save_features(features, f"{out}/features")
        regions.write_bed12(best, c.name, f"{out}/bed12")
    return best

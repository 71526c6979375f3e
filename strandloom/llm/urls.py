"""URL filters: host and path rules first, then a ratio of two character language models.

The models are variable-order Markov models with Witten-Bell smoothing over the characters of urls that the rules
accept and of those that they reject: a context of up to ``order`` characters backs off to a shorter one where it has
not been seen. A url without a rule is judged by the difference of the two log-likelihoods a character, against a
threshold calibrated on urls held out of the counts. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
COMMON = 2000
#: (verdict, host, path) of each rule; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a subdomain of it) and path; nulls if none does."""
    best = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best, verdict = F.when(fits, h + p).otherwise(best), F.when(fits, what).otherwise(verdict)
    return best, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of a url and its end: the gram of the ``order`` characters before it and itself."""
    padded = F.concat(F.lit(START * order), "body", F.lit(END))
    return urls.withColumn("padded", padded).select(
        "row", "held", "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("body") + 1), lambda i: F.substring("padded", i, order + 1))).alias("gram")
    )


def char_models(grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio) for every gram: log of its last character's probability as accepted less that as rejected.

    ``grams``: (gram, allow, block), the counts of each full gram, which may be 0. Bottom up: the shorter model's
    probability is what an order gives the mass of new characters to.
    """
    alphabet = 256.0
    lower = None
    for k in range(order + 1):
        counts = grams.withColumn("g", F.substring("gram", order + 1 - k, k + 1)).groupBy("g").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        counts = counts.withColumn("ctx", F.substring("g", 1, k))
        stats = counts.groupBy("ctx").agg(*(f(c) for c in ("allow", "block") for f in (lambda c: F.sum(c).alias(f"n_{c}"), lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}"))))
        level = counts.join(stats, "ctx")
        if lower is not None:
            level = level.withColumn("tail", F.substring("g", 2, k)).join(lower, "tail")
        cols = []
        for c in ("allow", "block"):
            base = F.lit(1 / alphabet) if lower is None else F.col(f"p_{c}")
            seen = F.col(f"n_{c}") + F.col(f"t_{c}")
            cols.append(F.when(seen > 0, (F.col(c) + F.col(f"t_{c}") * base) / seen).otherwise(base).alias(f"p_{c}"))
        level = level.select(F.col("g").alias("tail"), *cols)
        lower = cut(level)  # each order is used by the next and by nothing else
    return lower.select(F.col("tail").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def url_verdicts(pages: DataFrame, rules=RULES, order: int = 4, fold: int = 5, bins: int = 200, reach: float = 5.0) -> DataFrame:
    """Judges every url; returns page_id, host, path, rule, verdict and score (the mean log ratio a character).

    Null url or none with ``://``: empty host and path, no rule, judged by the models (null counts as empty).
    Repeated and null page ids: ordinary rows, judged each on its own. No accepted or no rejected url to learn from:
    the models agree, the score is 0 and the verdict allow. Empty table: no rows. Other columns are ignored.
    Urls whose crc32(url) mod ``fold`` is 0 are held out of the counts and calibrate the threshold: the edge of one
    of ``bins`` bins of scores in -reach..reach with the best mean of the two classes' rates.
    """
    host, path = host_and_path(F.col("url"))
    body = F.coalesce(F.col("url"), F.lit(""))
    rule, label = rule_for(F.col("host"), F.col("path"), rules)
    base = pages.select("page_id", body.alias("body"), host.alias("host"), path.alias("path")).select(
        "page_id", "body", "host", "path", rule.alias("rule"), label.alias("label"), (F.crc32(F.col("body").cast("binary")) % fold == 0).alias("held")
    )
    base = cut(base)
    # equal urls are scored once, under a number of their own
    urls = cut(base.groupBy("body").agg(F.min("label").alias("label"), F.first("held").alias("held")).withColumn("row", F.monotonically_increasing_id()))
    each = _grams(urls, order)
    learn = lambda c: F.sum(F.when((F.col("label") == c) & ~F.col("held"), 1).otherwise(0)).alias(c)
    grams = cut(each.groupBy("gram").agg(learn("allow"), learn("block"), F.count("*").alias("n")))
    model = char_models(grams, order).join(grams.select("gram", "n"), "gram")
    # a gram with more than 1 / COMMON of all places is one of fewer than COMMON, which are broadcast; the others are dealt
    # over tasks evenly enough
    total = grams.agg(F.sum("n")).first()[0] or 0
    is_common = F.col("n") > total / COMMON
    common = model.filter(is_common).select("gram", F.col("ratio").alias("known"))
    marked = each.select("row", "gram").join(F.broadcast(common), "gram", "left")
    rest = marked.filter("known is null").select("row", "gram").join(model.filter(~is_common).select("gram", "ratio"), "gram").select("row", "ratio")
    part = [x.groupBy("row").agg(F.sum(c).alias("s"), F.count("*").alias("n")) for x, c in ((marked.filter("known is not null"), "known"), (rest, "ratio"))]
    score = part[0].unionByName(part[1]).groupBy("row").agg((F.sum("s") / F.sum("n")).alias("score"))
    scored = cut(urls.join(score, "row").select("body", "label", "held", "score"))
    bin_ = F.least(F.greatest(F.floor((F.col("score") + reach) / (2 * reach) * bins), F.lit(0)), F.lit(bins - 1))
    seen = scored.filter("held and label is not null").groupBy("label", bin_.alias("bin")).agg(F.count("*").alias("n")).collect()
    cut_at = threshold({(r["label"], r["bin"]): r["n"] for r in seen}, bins, reach)
    verdict = F.coalesce("label", F.when(F.col("score") >= cut_at, "allow").otherwise("block"))
    # a url that very many pages share is one row on one side: Spark's skew join splits the other
    return (
        base.join(scored.select("body", "score"), "body")
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
    )


def threshold(seen: dict, bins: int, reach: float) -> float:
    """The lower edge of the bin at which the mean of both classes' rates is best; 0 without both classes."""
    total = {c: sum(n for (k, _), n in seen.items() if k == c) for c in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    best, at, allow, block = -1.0, 0.0, total["allow"], 0
    for b in range(bins + 1):
        rate = allow / total["allow"] + block / total["block"]
        edge = -reach + 2 * reach * b / bins
        if rate > best or rate == best and abs(edge) < abs(at):
            best, at = rate, edge
        allow -= seen.get(("allow", b), 0)
        block += seen.get(("block", b), 0)
    return at

"""Mixing of sources to target weights by Pareto order sampling.

The size of a mixture is the sum over all documents of the sources with a target; each source should
have its weight of it. How often a document is to be used on average grows with its size: c * size^POWER,
at most maxRepeat, where c makes the source reach its tokens. The whole part of that is certain copies;
the fraction f is the inclusion probability of one more. Documents are ranked by their random odds
divided by their inclusion odds, u/(1-u) : f/(1-f), and the lowest ranks are taken until the source's
tokens are reached: a Pareto sample of fixed size (in tokens) with unequal probabilities.

Documents of a source are put in classes of about equal size, STEPS a doubling; c is found from the
tokens of the classes, a table of at most 64 * STEPS rows a target source. The cut is found by adding up
tokens in BINS bins of the rank and then sorting one bin per source, so no task holds more than about
1/BINS of a source.

Defined results: documents whose source has no target are left out; documents without tokens take no
part; a source that cannot reach its target is used maxRepeat times and reported; null or negative
weights and repeats count as 0; of repeated rows of a document or target one counts; an empty corpus
gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import local_table

BINS = 4096
STEPS = 8
#: 0 uses all documents of a source alike, 1 in proportion to their size.
POWER = 0.5


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, maxRepeat, target, available, short, uses) per target source.

    sizes: (doc_id, source, tokens), one row a document; targets: (source, weight, maxRepeat), a
    table of fixed size. uses is how often the source is used on average.
    """
    weight, repeat = (F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in ("weight", "maxRepeat"))
    wanted = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(weight).cast("double").alias("weight"), F.max(repeat).cast("long").alias("maxRepeat"))
    totals = sizes.groupBy(F.col("source").alias("_gl_s")).agg(F.sum("tokens").alias("available"))
    rows = wanted.join(totals, F.col("source") == F.col("_gl_s"), "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long")).drop("_gl_s")
    # one row per target source, a fixed number
    rows = rows.withColumn("target", F.col("weight") * F.sum("available").over(Window.partitionBy(F.lit(1))))
    uses = F.when(F.col("available") > 0, F.least(F.col("target") / F.col("available"), F.col("maxRepeat").cast("double"))).otherwise(0.0)
    return rows.withColumn("short", F.col("available") * F.col("maxRepeat") < F.col("target")).withColumn("uses", uses)


def size_class(tokens: Column) -> Column:
    return F.floor(F.log2(tokens) * STEPS).cast("int")


def uses_of(classes: list[tuple[int, int]], target: float, repeat: int, power: float = POWER) -> dict[int, float]:
    """How often documents of each class are used on average; classes: (class, tokens) of one source."""
    pull = {c: 2.0 ** (c / STEPS * power) for c, _ in classes}
    left, tokens = target, dict(classes)
    uses = {}
    for c in sorted(pull, key=pull.get, reverse=True):  # the strongest reach the most repeats first
        rate = left / sum(pull[x] * tokens[x] for x in pull if x not in uses)
        if rate * pull[c] < repeat:
            return uses | {x: rate * pull[x] for x in pull if x not in uses}
        uses[c] = float(repeat)
        left -= repeat * tokens[c]
    return uses


def document_uses(sizes: DataFrame, plan: DataFrame, power: float = POWER) -> DataFrame:
    """(_gl_s, _gl_class, _gl_use, _gl_more): the average use per source and class, and the tokens of the fractions of the source."""
    of = plan.select(F.col("source").alias("_gl_s"), "target", "maxRepeat")
    per = sizes.filter(F.col("tokens") > 0).groupBy("source", size_class(F.col("tokens")).alias("_gl_class")).agg(F.sum("tokens").alias("t"))
    found: dict[str, list] = {}
    for r in per.join(F.broadcast(of), F.col("source") == F.col("_gl_s")).collect():  # at most 64 * STEPS rows a target source
        found.setdefault(r["source"], [r["target"], r["maxRepeat"], []])[2].append((r["_gl_class"], r["t"]))
    rows = []
    for source, (target, repeat, classes) in found.items():
        uses = uses_of(sorted(classes), target, repeat, power)
        more = round(sum((uses[c] - int(uses[c])) * t for c, t in classes))
        rows += [(source, c, uses[c], more) for c, _ in classes]
    return local_table(sizes.sparkSession, rows, "_gl_s string, _gl_class int, _gl_use double, _gl_more long")


def mixture(sizes: DataFrame, plan: DataFrame, seed: int = 7, power: float = POWER) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mixture with their number of copies."""
    rows = sizes.filter(F.col("tokens") > 0).join(F.broadcast(document_uses(sizes, plan, power)), (F.col("source") == F.col("_gl_s")) & (size_class(F.col("tokens")) == F.col("_gl_class")))
    rows = rows.withColumns({"_gl_whole": F.floor("_gl_use").cast("long"), "_gl_f": F.col("_gl_use") - F.floor("_gl_use")})
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2**52)) + 0.5) / float(2**52)
    f = F.col("_gl_f")
    # odds of the rank, mapped to (0, 1) in the same order; rank 1 without a fraction
    odds = F.when(f > 0, (u / (1 - u)) / (f / (1 - f)))
    rows = rows.withColumn("_gl_rank", F.coalesce(odds / (1 + odds), F.lit(1.0)))
    rows = rows.withColumn("_gl_bin", F.least(F.lit(BINS - 1), F.floor(F.col("_gl_rank") * BINS)).cast("int"))
    # documents without a fraction are none of the sample
    bins = rows.filter(f > 0).groupBy(F.col("_gl_s").alias("_gl_bs"), F.col("_gl_bin").alias("_gl_bb")).agg(F.sum("tokens").alias("_gl_t"))
    upto = Window.partitionBy("_gl_bs").orderBy("_gl_bb").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_gl_before", F.sum("_gl_t").over(upto) - F.col("_gl_t"))
    # at most BINS rows per target source
    rows = rows.join(F.broadcast(bins), (F.col("_gl_s") == F.col("_gl_bs")) & (F.col("_gl_bin") == F.col("_gl_bb")), "left")
    inside = F.coalesce((f > 0) & (F.col("_gl_before") < F.col("_gl_more")) & (F.col("_gl_before") + F.col("_gl_t") > F.col("_gl_more")), F.lit(False))
    within = Window.partitionBy("_gl_s", "_gl_bin").orderBy("_gl_rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = rows.filter(inside).withColumn("_gl_sum", F.col("_gl_before") + F.sum("tokens").over(within))
    # taken while the sum, cut at half of the document, stays within the target
    at_cut = at_cut.withColumn("_gl_take", (F.col("_gl_sum") - F.col("tokens") / 2 <= F.col("_gl_more")).cast("long")).drop("_gl_sum")
    taken = (f > 0) & (F.col("_gl_before") + F.col("_gl_t") <= F.col("_gl_more"))
    others = rows.filter(~inside).withColumn("_gl_take", F.coalesce(taken, F.lit(False)).cast("long"))
    out = at_cut.unionByName(others).withColumn("copies", F.col("_gl_whole") + F.col("_gl_take"))
    return out.filter(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")


def short_sources(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source): those that stay below their target although the mixture has every document maxRepeat times."""
    got = mixed.groupBy(F.col("source").alias("_gl_s")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.sum("tokens").alias("once"), F.min("copies").alias("least"))
    rows = plan.join(got, F.col("source") == F.col("_gl_s"), "left")
    none_left = F.coalesce((F.col("once") == F.col("available")) & (F.col("least") == F.col("maxRepeat")), (F.col("available") == 0) | (F.col("maxRepeat") == 0))
    return rows.filter(none_left & (F.coalesce("mixed", F.lit(0)) < F.col("target"))).select("source")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, weight, share, tokens, documents, copies, short): the actual shares of the mixture."""
    got = mixed.groupBy(F.col("source").alias("_gl_s")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    rows = plan.join(got, F.col("source") == F.col("_gl_s"), "left").na.fill(0, ["tokens", "documents", "copies"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    return rows.select("source", "weight", F.coalesce(share, F.lit(0.0)).alias("share"), "tokens", "documents", "copies", "short")

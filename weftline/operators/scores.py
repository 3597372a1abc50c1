"""Scores and reports: compliance steps, expected links, readiness, evaluation, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams
from .vocabulary import words

#: Words that let a relation be expected, and the relations with their confidence (fixed values).
EXPECTED = (
    ("revenue recognition|asc 606|rev rec|deferred revenue|contract asset", (("compliesWith", "ASC 606", 0.96), ("compliesWith", "IFRS 15", 0.92), ("integratesWith", "Salesforce", 0.94), ("integratesWith", "NetSuite", 0.91), ("supportsCapability", "Deferred Revenue Waterfall", 0.90))),
    ("billing|subscription|recurring|invoicing|payments|metering", (("supportsPricingModel", "Usage-Based Pricing", 0.92), ("supportsPricingModel", "Tiered Pricing", 0.89), ("integratesWith", "Stripe", 0.91), ("integratesWith", "QuickBooks", 0.88), ("compliesWith", "PCI-DSS", 0.90))),
    ("platform|enterprise|saas|software|api|cloud|security", (("compliesWith", "SOC 2 Type II", 0.93), ("compliesWith", "GDPR", 0.88), ("compliesWith", "ISO 27001", 0.85), ("integratesWith", "Workday", 0.84), ("integratesWith", "Slack", 0.82), ("integratesWith", "Snowflake", 0.83))),
)
#: Relations that a complete graph has.
BENCHMARK = 16


def runs(c: Column, most: int) -> Column:
    """The distinct runs of up to ``most`` words of a text of words."""
    return F.array_distinct(F.transform(ngrams(F.split(c, " "), most), lambda g: g["gram"]))


def longest(listed: DataFrame, c: str) -> int:
    """How many words the longest text of a list has."""
    return listed.agg(F.coalesce(F.max(F.size(F.split(c, " "))), F.lit(1))).first()[0]


def expected_links(terms: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, predicate, object, confidence): relations a subject's terms let expect and it lacks.

    ``terms`` has key and term; a trigger counts where a term contains it. The confidence is
    the relation's times min(1, 0.75 + 0.05 * triggers), to three digits. ``existing`` has key,
    predicate, object, compared without case.
    """
    low = F.lower("term")
    hits = terms.groupBy(key).agg(*[F.bool_or(F.contains(low, F.lit(w))).alias(f"{i}:{w}") for i, (words, _) in enumerate(EXPECTED) for w in words.split("|")])
    made = []
    for i, (words, links) in enumerate(EXPECTED):
        n = sum((F.col(f"`{i}:{w}`").cast("int") for w in words.split("|")), F.lit(0))
        factor = F.least(F.lit(1.0), 0.75 + 0.05 * n)
        made += [F.when(n > 0, F.struct(F.lit(p).alias("predicate"), F.lit(o).alias("object"), F.round(F.lit(c) * factor, 3).alias("confidence"))) for p, o, c in links]
    each = hits.select(key, F.explode(F.filter(F.array(*made), lambda m: m.isNotNull())).alias("m")).select(key, "m.*")
    has = existing.select(key, F.lower("predicate").alias("p"), F.lower(F.trim("object")).alias("o")).distinct()
    return each.withColumn("p", F.lower("predicate")).withColumn("o", F.lower("object")).join(has, [key, "p", "o"], "left_anti").select(key, "predicate", "object", "confidence")


def completeness(existing: DataFrame, key: str) -> DataFrame:
    return existing.groupBy(key).agg(F.count(F.lit(1)).alias("triples")).withColumn("completeness", F.least(F.lit(100.0), F.round(F.col("triples") / BENCHMARK * 100, 1)))


def compliance(objects: DataFrame, key: str, steps: DataFrame) -> DataFrame:
    """(key, standard, satisfied, steps, status) of each standard of which a subject satisfies a step.

    ``objects`` has key and object; ``steps`` standard, step, pattern (a phrase), least (steps that
    satisfy the standard). A step is satisfied where the phrase stands in an object as whole words or
    the object in the phrase; an empty object satisfies nothing. The status is compliant for all steps, satisfied from least on, else partial.
    """
    flat = lambda c: F.array_join(words(F.col(c)), " ")
    said = objects.select(key, flat("object").alias("o")).where(F.col("o") != "").distinct()
    asked = steps.select("standard", "step", flat("pattern").alias("pattern")).where(F.col("pattern") != "")
    # containment either way as an equi-join on runs of words, none longer than the longest phrase
    most = longest(asked, "pattern")
    within = said.select(key, F.explode(runs(F.col("o"), most)).alias("pattern")).join(asked, "pattern").select(key, "standard", "step")
    around = said.join(asked.select("standard", "step", F.explode(runs(F.col("pattern"), most)).alias("o")), "o").select(key, "standard", "step")
    met = within.unionByName(around).groupBy(key, "standard").agg(F.count_distinct("step").alias("satisfied"))
    totals = steps.groupBy("standard").agg(F.count_distinct("step").alias("steps"), F.max("least").alias("least"))
    status = F.when(F.col("satisfied") == F.col("steps"), "compliant").when(F.col("satisfied") >= F.col("least"), "satisfied").otherwise("partial")
    return met.join(totals, "standard").select(key, "standard", "satisfied", "steps", status.alias("status"))


def readiness(pages: DataFrame, key: str) -> DataFrame:
    """(key, mandatory, seeds, diversity, confidence, score): 40 points for mandatory fields, 30 for seeds found, 15 each for kinds of label and for the mean confidence of up to five entities.

    ``pages`` has key, mandatory, mandatory_all, seeds, seeds_all, labels, labels_all, mean_score, entities.
    """
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    parts = pages.select(key, F.round(40 * share("mandatory", "mandatory_all"), 2).alias("mandatory"), F.round(30 * share("seeds", "seeds_all"), 2).alias("seeds"), F.round(15 * share("labels", "labels_all"), 2).alias("diversity"), F.round(15 * F.coalesce("mean_score", F.lit(0.0)) * F.least(F.col("entities") / 5, F.lit(1.0)), 2).alias("confidence"))
    return parts.withColumn("score", F.round(F.col("mandatory") + F.col("seeds") + F.col("diversity") + F.col("confidence"), 2))


def precision_recall(found: DataFrame, truth: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall): found rows against reviewed ones (keys, by, correct); a row no one reviewed counts nowhere, a zero denominator gives null."""
    both = truth.select(by, *keys, "correct").join(found.select(by, *keys).distinct().withColumn("hit", F.lit(True)), [by, *keys], "left")
    hit = F.coalesce("hit", F.lit(False))
    counts = both.groupBy(by).agg(F.count_if(hit & F.col("correct")).alias("tp"), F.count_if(hit & ~F.col("correct")).alias("fp"), F.count_if(~hit & F.col("correct")).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return counts.select(by, "tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def identity_violations(groups: DataFrame, same: DataFrame, different: DataFrame) -> DataFrame:
    """(kind, a, b): pairs that should be one group and are split, and pairs that should not and are merged. ``groups`` has id and group_id; pairs count where both ids occur."""
    at = lambda pairs: pairs.join(groups.select(F.col("id").alias("a"), F.col("group_id").alias("ga")), "a").join(groups.select(F.col("id").alias("b"), F.col("group_id").alias("gb")), "b")
    split = at(same).where(F.col("ga") != F.col("gb")).select(F.lit("split").alias("kind"), "a", "b")
    return split.unionByName(at(different).where(F.col("ga") == F.col("gb")).select(F.lit("merged").alias("kind"), "a", "b"))


def discovery_confidence(pages: Column, icp_pages: Column, proposed: Column, kept: Column) -> Column:
    """0.4, plus up to 0.3 for eight pages read, plus 0.3 times the share of proposals that held (0 where two pages or more told nothing, else one half), to three digits."""
    told = F.when(proposed > 0, kept / proposed).when(icp_pages >= 2, 0.0).otherwise(0.5)
    return F.round(0.4 + 0.3 * F.least(pages, F.lit(8)) / 8 + 0.3 * told, 3)

"""Labels against terms, vocabularies with defaults, evidence by page, and stories checked against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import buyers
from .scores import longest, runs

#: Groups of pages that prove something about buyers, and by which path segments they are known (fixed values).
EVIDENCE_GROUPS = {"customer": ("customers", "customer", "customer-stories", "case-studies", "case-study", "success-stories", "stories"), "comparison": ("compare", "comparison", "vs", "alternatives", "alternative"), "industry": ("industries", "industry", "solutions", "use-cases")}


def plain(c: Column) -> Column:
    """Words in lower case, hyphens and dashes as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[-–]", " "), r"[^a-z0-9]+", " "))


def matched_labels(labels: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, concept_id, how): concepts whose label or other label a subject's terms hold.

    ``labels`` has concept_id, label, canonical; ``terms`` key and term. how is 3 for an equal canonical
    label, 2 for one within a term as whole words, 1 for another label within a term, 0 for a
    term of six characters or more within a canonical label. All of them are equi-joins on runs of words.
    """
    said = terms.select(key, plain(F.col("term")).alias("t")).where(F.col("t") != "").distinct()
    known = labels.select("concept_id", plain(F.col("label")).alias("l"), "canonical").where(F.length("l") >= 3).distinct()
    most = longest(known, "l")
    within = said.select(key, "t", F.explode(runs(F.col("t"), most)).alias("l")).join(known, "l")
    forward = within.select(key, "concept_id", F.when(F.col("canonical") & (F.col("t") == F.col("l")), 3).when(F.col("canonical"), 2).otherwise(1).alias("how"))
    pieces = known.where("canonical").select("concept_id", "l", F.explode(runs(F.col("l"), most)).alias("t")).where((F.length("t") >= 6) & (F.col("t") != F.col("l")))
    backward = said.join(pieces, "t").select(key, "concept_id", F.lit(0).alias("how"))
    return forward.unionByName(backward).groupBy(key, "concept_id").agg(F.max("how").alias("how"))


def vocabulary_or_default(values: DataFrame, default: DataFrame, group: str, field: str = "field") -> DataFrame:
    """(group, field, value): each group's values of a field, or the default ones where it has none. Values marked as found evidence are none, and the default joins what is left."""
    groups = values.select(group).distinct()
    own = values.where(F.trim("value") != "")
    curated = own.where(~F.coalesce("evidenced", F.lit(False))).select(group, field, "value")
    pure = own.groupBy(group, field).agg(F.bool_or(F.coalesce("evidenced", F.lit(False))).alias("mixed")).where(~F.col("mixed")).select(group, field)
    # the list of fields is that of the profile's schema
    fields = [r[0] for r in default.select(field).distinct().collect()]
    filled = groups.withColumn(field, F.explode(F.array(*[F.lit(f) for f in fields]).cast("array<string>"))).join(pure, [group, field], "left_anti").join(default.select(field, "value"), field).select(group, field, "value")
    return curated.unionByName(filled).distinct()


def evidence_by_page(profile: DataFrame) -> DataFrame:
    """(url, claims): of profiles (subject, field, value, url, quote) what each page is cited for, in order."""
    cited = profile.where(F.trim("url") != "")
    return cited.groupBy("url").agg(F.array_sort(F.collect_set(F.struct("subject", "field", "value", "quote"))).alias("claims"))


def evidence_group(segments: Column) -> Column:
    """The first group of EVIDENCE_GROUPS that a path's segments name."""
    out = None
    for name, hints in EVIDENCE_GROUPS.items():
        hit = F.arrays_overlap(segments, F.array(*[F.lit(h) for h in hints]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def prompt_coverage(prompts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(vertical_id, concepts, defined, aliases, prompts, stages): what a vertical gives for prompts and how many came of it."""
    have = concepts.groupBy("vertical_id").agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.coalesce(F.trim("definition") != "", F.lit(False))).alias("defined"), F.sum(F.size(F.coalesce("altlabels", F.array()))).alias("aliases"))
    made = prompts.groupBy("vertical_id").agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("stage").alias("stages"))
    return have.join(made, "vertical_id", "left").na.fill(0, ["prompts", "stages"])


def facets(stories: DataFrame) -> DataFrame:
    """(story, part, node, kinds): the parts of stories (story, part, text, quote) that their quote supports, named by a hash of what they say, with the kinds their text falls into."""
    kept = stories.where((F.trim("text") != "") & (buyers.support(F.col("text"), F.col("quote")) >= buyers.SUPPORT))
    kinds = F.when(F.col("part") == "role", F.array_compact(F.array(buyers.role(F.col("text"))))).when(F.col("part") == "trigger", F.array_compact(F.array(buyers.trigger(F.col("text"))))).when(F.col("part") == "pain", buyers.pains(F.col("quote"))).otherwise(F.array().cast("array<string>"))
    return kept.select("story", "part", F.substring(F.sha1(F.concat_ws("|", "part", "text", "quote")), 1, 16).alias("node"), kinds.alias("kinds"))


def checked_prompts(prompts: DataFrame, vendors: DataFrame) -> DataFrame:
    """The prompts (subject, text, support) with ``verdict``: too_short under six words, names_vendor where the vendor's name stands in it, unsupported where a number in it is not in what supports it, else kept. ``vendors`` has subject and vendor."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    rows = prompts.join(vendors.groupBy("subject").agg(F.min("vendor").alias("vendor")), "subject", "left")
    numbers = F.filter(words(F.col("text")), lambda w: w.rlike("[0-9]"))
    named = F.coalesce(F.contains(pad(F.col("text")), pad(F.col("vendor"))) & (F.trim("vendor") != ""), F.lit(False))
    verdict = F.when(F.size(words(F.col("text"))) < 6, "too_short").when(named, "names_vendor").when(F.size(F.array_except(numbers, words(F.col("support")))) > 0, "unsupported").otherwise("kept")
    return rows.select("subject", "text", verdict.alias("verdict"))


def added_concepts(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """(vertical_id, label, id, form_owner): proposed labels with the id they get; a label whose key another concept has is not taken and names its owner."""
    owner = existing.select("vertical_id", plain(F.col("form")).alias("k"), "concept_id").groupBy("vertical_id", "k").agg(F.min("concept_id").alias("form_owner"))
    ids = existing.select("vertical_id", F.col("concept_id").alias("id")).distinct().withColumn("taken", F.lit(True))
    rows = proposed.select("vertical_id", "label", plain(F.col("label")).alias("k"), tx.slug(F.col("label")).alias("base")).join(owner, ["vertical_id", "k"], "left")
    free = rows.where(F.col("form_owner").isNull()).join(ids.withColumnRenamed("id", "base"), ["vertical_id", "base"], "left")
    number = F.row_number().over(Window.partitionBy("vertical_id", "base").orderBy("label")) + F.coalesce(F.col("taken"), F.lit(False)).cast("int")
    named = free.withColumn("n", number).select("vertical_id", "label", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("id"), "form_owner")
    return named.unionByName(rows.where(F.col("form_owner").isNotNull()).select("vertical_id", "label", F.lit(None).cast("string").alias("id"), "form_owner"))

"""Situations of buyers: who is affected, what changed, what it costs, and whether a quote proves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Functions and levels of a role, what sets a purchase off, and what a pain costs; of the first three the first that matches counts (fixed values).
ROLE_FUNCTIONS = {
    "revops": r"\brevops\b|revenue operations|sales operations|\bsales ops\b",
    "accounting": r"accounting|accountant|\bcontroller\b|\bcomptroller\b|bookkeep",
    "finance": r"\bfinanc|\bcfo\b|fp&a|treasur",
    "people": r"\bpeople\b|\bhr\b|human resources|talent|\bculture\b|\bchro\b|\bpayroll\b",
    "it": r"\bit\b|information technology|\bcio\b|\bcto\b|security|engineering",
    "operations": r"operations|\bcoo\b",
    "executive": r"\bceo\b|founder|\bowner\b|\bpresident\b|chief executive",
}
ROLE_LEVELS = {
    "c-level": r"\bchief\b|\bc[a-z]?[a-z]o\b|\bfounder\b|\bowner\b",
    "vp": r"\bvp\b|vice president|\bsvp\b|\bevp\b",
    "head": r"\bhead of\b",
    "director": r"\bdirector\b|\bcontroller\b|\bcomptroller\b",
    "manager": r"\bmanager\b|\blead\b",
    "staff": r"specialist|analyst|coordinator|administrator|generalist|accountant",
}
TRIGGERS = {
    "new-business-model": r"\bb2b2?c?\b|usage[- ]based|new (?:pricing|business) model|evolving pricing|pricing models?|new market",
    "erp-change": r"\berp\b|netsuite|sage intacct|migrat\w* to",
    "new-entity-or-country": r"\binternational|multi[- ]entity|new (?:entity|country|region)|global",
    "new-deal-types": r"deal types?|contract (?:types|changes|structures)|mid[- ]contract|changes to (?:customer )?contracts|upgrades?|amendments?|addend",
    "audit-or-funding": r"\baudit|\bipo\b|funding|investor|board",
    "growth-in-volume": r"\bgrow|growth|scal|more customers|volume|adding customers|revenue grew|workforce|headcount|\bhires?\b|hiring|branches|locations|offices|\b(?:doubled|tripled|quadrupled)\b",
}
PAINS = {
    "revenue-leakage": r"lost revenue|losing revenue|revenue (?:loss|leak)|leakage|under-?bill|missed (?:billing|charges|revenue)",
    "vendor-support-fit": r"support from|hard to get support|get support|fit into (?:their|the)|didn'?t want to deal|not (?:flexible|responsive)|rigid|clunky|not user[- ]friendly|hard to use|difficult to use|cumbersome",
    "errors-accuracy": r"\berrors?\b|error-prone|mistakes?|inaccura|\bwrong\b",
    "slow-cycle": r"\b\d+\s*(?:days?|weeks?)\b|\b(?:two|three|four|several) (?:days|weeks)\b|weeks to|days to|took (?:too )?long|delay|\bslow\b|close the books|month-end close|\blate\b|(?:entire|whole|full) (?:whole )?(?:day|week)|\bhours? (?:a|each|every|per) (?:day|week|month)",
    "cannot-scale": r"scal(?:e|ing|able|ability)|unwieldy|outgr|keep up|not powerful enough|unsustainable|(?:not|n'?t|n’t) sustainable|out of control|fast enough|keep pace|(?:became|become|becoming|got|gotten|getting|grew) (?:all )?(?:more |increasingly )?(?:complicated|complex)|(?:could not|couldn'?t|not able to) handle|as (?:the company |we )?gr[eo]w",
    "manual-effort": r"\bmanual|by hand|time-consuming|re-?key|spreadsheet|\bexcel\b|\bpaper|sorting|data entry|re-?enter|repetitive|consumed (?:\w+ )?(?:time|hours)|inefficient|(?:neither|not) efficient",
    "missing-capability": r"not able to|was not able|did not support|(?:could not|couldn'?t|couldn’t) (?:\w+ly )?(?:handle|support|do|automate|calculate|manage|integrate|track|bill|charge|perform|process|invoice|report|connect|accommodate)|lacked|no way to|not the best platform|not suitable|not capable|incapable|unable to|no support for|not being able to|not supporting|(?:challenge|difficult|difficulty|hard) (?:to )?access|no visibility",
}
#: Words that carry no content in a claim (fixed values).
FILLER = "with that this their they them more most need needed needs used using could would from into about both also were have been which when able than very much many".split()
#: Words a quote has at least, the share of a claim's words its quote must have, and characters of a quote that are looked for on the page.
QUOTE_WORDS, SUPPORT, QUOTE_CHARS = 4, 0.5, 60


def _first(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.lower(c).rlike(p), name) for name, p in table.items()])


def role(c: Column) -> Column:
    """``function/level`` of a role's name, null where it tells neither."""
    function, level = _first(c, ROLE_FUNCTIONS), _first(c, ROLE_LEVELS)
    return F.when(function.isNotNull() | level.isNotNull(), F.concat(F.coalesce(function, F.lit("unspecified")), F.lit("/"), F.coalesce(level, F.lit("unspecified"))))


def trigger(c: Column) -> Column:
    return _first(c, TRIGGERS)


def pains(c: Column) -> Column:
    """All kinds of pain a text states, in the order of PAINS."""
    return F.filter(F.array(*[F.when(F.lower(c).rlike(p), name) for name, p in PAINS.items()]), lambda x: x.isNotNull())


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(_tokens(c), " "), F.lit(" "))


def quote_on_page(quote: Column, page: Column) -> Column:
    """Whether a quote of QUOTE_WORDS words or more stands in a page's words, in order."""
    return (F.size(_tokens(quote)) >= QUOTE_WORDS) & F.contains(_padded(page), _padded(quote))


def support(claim: Column, quote: Column) -> Column:
    """Share of a claim's content words, by their first five letters, that its quote has; 0 for a claim without any."""
    stems = lambda c: F.array_distinct(F.transform(F.filter(_tokens(c), lambda w: (F.length(w) > 3) & ~w.isin(*FILLER)), lambda w: F.substring(w, 1, 5)))
    mine = stems(claim)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, stems(quote))), F.size(mine)), F.lit(0.0))


def checked_claims(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """The claims (subject, value, url, quote) with ``verdict``: repeated, bad_url, quote_not_found, unsupported or kept.

    A value counts once a subject, case ignored, in the order of url and quote.
    The page cited must have been read, the beginning of the quote must stand on it, and the
    quote must support the value. Page texts are joined by url, so each is read once.
    """
    read = pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by("text", F.length("text")).alias("page"))
    order = Window.partitionBy("subject", F.lower("value")).orderBy("url", "quote")
    rows = claims.withColumn("again", F.row_number().over(order) > 1).join(read, "url", "left")
    start = F.substring(F.array_join(_tokens(F.col("quote")), " "), 1, QUOTE_CHARS)
    verdict = (
        F.when(F.col("again"), "repeated").when(F.col("page").isNull(), "bad_url").when((start == "") | ~F.contains(F.array_join(_tokens(F.col("page")), " "), start), "quote_not_found").when(support(F.col("value"), F.col("quote")) < SUPPORT, "unsupported").otherwise("kept")
    )
    return rows.select("subject", "value", "url", "quote", verdict.alias("verdict"))


def merged_values(existing: DataFrame, discovered: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The union of two lists of values by key, equal ones (case ignored) once, those that were there first."""
    both = existing.select(*keys, value, F.lit(0).alias("late"), order).unionByName(discovered.select(*keys, value, F.lit(1).alias("late"), order))
    low = F.lower(F.trim(value)).alias("__low")
    kept = both.where(F.trim(value) != "").groupBy(*keys, low).agg(F.min(F.struct("late", order, value)).alias("m"))
    return kept.select(*keys, F.col(f"m.{value}").alias(value), (F.col("m.late") == 1).alias("new"))


#: Words of a template that say nothing of its subject (fixed values).
TEMPLATE_WORDS = "how to is the why does what with for still best as you off on and of it need stops takes too long grow move from that vs".split()


def phrase(term: Column, keep_case: bool = False) -> Column:
    """A term as it stands within a query: words in lower case but for those of capitals, with a digit first or with a capital inside."""
    trimmed = F.trim(term)
    if keep_case:
        return trimmed
    return F.array_join(F.transform(F.filter(F.split(trimmed, r"\s+"), lambda w: w != ""), lambda w: F.when(w.rlike("^[A-Z0-9][A-Z0-9&/.-]*$") | w.rlike(".[A-Z]"), w).otherwise(F.lower(w))), " ")


def _stems(words: Column) -> Column:
    return F.transform(words, lambda w: F.substring(F.regexp_replace(F.lower(w), "y$", "i"), 1, 6))


def collides(template: Column, subject: Column) -> Column:
    """Whether a template says a word of its subject again, by the first six letters; the category's own name does not count."""
    own = F.regexp_replace(F.replace(template, F.lit("{category} software"), F.lit(" ")), r"\{\w+\}", " ")
    said = F.filter(F.regexp_extract_all(own, F.lit("([a-z]+)")), lambda w: ~w.isin(*TEMPLATE_WORDS))
    return F.coalesce(F.arrays_overlap(_stems(said), _stems(F.regexp_extract_all(subject, F.lit("([A-Za-z]+)")))), F.lit(False))


def head_to_head(competitors: DataFrame, scope: str, name: str, order: str) -> DataFrame:
    """(scope, text, source): a comparison of each competitor with the next one."""
    following = F.lead(name).over(Window.partitionBy(scope).orderBy(order, name))
    rows = competitors.where(F.trim(name) != "").withColumn("__next", following).where(F.col("__next").isNotNull())
    return rows.select(scope, F.concat_ws(" vs ", name, "__next").alias("text"), F.col(name).alias("source"))


def prompts(templates: DataFrame, subjects: DataFrame) -> DataFrame:
    """(vertical_id, stage, subject, prompt, ord) of every template of a subject's role, {subject} filled in as a phrase, templates that say a word of their subject again left out; prompts that are equal but for case and spaces count once, the best stage first."""
    made = subjects.join(templates, "role").where(~collides(F.col("template"), F.col("subject"))).withColumn("prompt", F.replace(F.col("template"), F.lit("{subject}"), phrase(F.col("subject"))))
    low = F.lower(F.regexp_replace("prompt", r"\s+", " ")).alias("__low")
    best = made.groupBy("vertical_id", low).agg(F.min(F.struct("stage", "ord", "subject", "prompt")).alias("m"))
    return best.select("vertical_id", "m.stage", "m.subject", "m.prompt", "m.ord")

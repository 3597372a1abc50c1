"""Text as columns: blocks, proof units, word windows, patterns and guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Scratch

#: Lines of page chrome that prove nothing (fixed values).
CHROME = (
    r"(?i)^(hit enter to search|skip to (main )?content|search( for)?[:.]?$|close( menu)?$|menu$|(first|last) ?name\**$|e-?mail\**$|stage$|lead source$|last call to action( details)?$"
    r"|article created .* ago$|number of comments: ?\d+$|recent activity$|promoted articles$)"
)
#: A line up to this length without a closing mark is a heading; a unit is longer than the second number.
HEADING, UNIT = 60, 15


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it: else every mention repeats the whole expression in the generated code."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Words that a byline runs together with what stands before them (fixed values).
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
TITLES = "CEO|CFO|CTO|COO|CRO|CMO|SVP|EVP|VP|Founder|Co-Founder"


def repair_glued_words(c: Column) -> Column:
    """Spaces where a byline lost them: before a month that a day follows, before a job title, between a year and a capitalised word, and after By or Blog. Null stays null."""
    out = F.regexp_replace(c, rf"(?<=[a-z])(?=(?:{MONTHS})\s+\d)", " ")
    out = F.regexp_replace(out, rf"(?<=[a-z])(?=(?:{TITLES})\b)", " ")
    out = F.regexp_replace(out, r"(?<!\d)((?:19|20)\d\d)(?=[A-Z][a-z])", "$1 ")
    return F.regexp_replace(out, r"\b(By|Blog)(?=[A-Z][a-z])", "$1 ")


def block_key(c: Column) -> Column:
    """The key of a block of prose: twelve digits of the hash of its collapsed lower-case text; null under eight characters."""
    text = F.lower(collapse(c))
    return F.when(F.length(text) >= 8, F.substring(F.sha1(text), 1, 12))


def lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., pos, line) of every line; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("pos", "line"))


def repeated_blocks(docs: DataFrame, site: str, page: str, text: str = "text", least: int = 3) -> DataFrame:
    """(site, page, pos, key, pages, dropped) of every block of every page.

    A block that stands on ``least`` pages of a site or more is boilerplate and
    dropped, except on the first page (in order of ``page``) and place where it stands. A
    null site is a site. Counts come from partial aggregation, and blocks with a great share of all rows are
    joined with theirs where they lie.
    """
    blocks = lines(docs, [site, page], text).select(F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("")).alias("at"), F.col(page).alias("page"), "pos", block_key(F.col("line")).alias("key")).where(F.col("key").isNotNull())
    blocks = Scratch(docs.sparkSession, "blocks").keep(blocks)
    counts = blocks.groupBy("at", "key").agg(F.count_distinct("page").alias("pages"), F.min(F.struct("page", "pos")).alias("first"))
    judged = lookup_join(blocks, counts, ["at", "key"], "inner")
    first = (F.col("page") == F.col("first.page")) & (F.col("pos") == F.col("first.pos"))
    own = F.when(F.col("at") == "", F.lit(None)).otherwise(F.substring("at", 2, 1 << 30))
    return judged.select(own.alias(site), F.col("page").alias(page), "pos", "key", "pages", ((F.col("pages") >= least) & ~first).alias("dropped"))


def proof_units(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, part, unit): the sentences of a text that can prove something.

    A line is a boundary; chrome lines are left out; a short line without a
    closing mark heads the lines below it and is a unit if it is long enough; a sentence below a heading
    carries it as ``heading — sentence``.
    """
    trimmed = F.trim(F.regexp_replace(F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")), r"^[-*• ]+", ""))
    rows = lines(docs, [key], text).select(key, "pos", trimmed.alias("line")).where((F.col("line") != "") & ~F.col("line").rlike(CHROME))
    short = (F.length("line") <= HEADING) & ~F.col("line").rlike("[.!?]$")
    rows = rows.withColumn("short", short)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = rows.withColumn("heading", F.last(F.when(F.col("short"), F.regexp_replace("line", ":+$", "")), ignorenulls=True).over(order))
    sentences = F.when(F.col("short"), F.array("line")).otherwise(F.split("line", r"(?<=[.!?])\s+"))
    units = headed.select(key, "pos", "short", "heading", F.posexplode(sentences).alias("part", "s")).withColumn("s", F.trim("s")).where(F.length("s") > UNIT)
    unit = F.when(F.col("short") | F.col("heading").isNull() | (F.col("heading") == ""), F.col("s")).otherwise(F.concat("heading", F.lit(" — "), "s"))
    return units.select(key, "pos", "part", unit.alias("unit"))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_windows(words: Column, size: int = 200, overlap: int = 25) -> Column:
    """Windows of ``size`` words that overlap by ``overlap``; the last one ends with the text. No words give none. ``words`` should be a column, as the windows read it again and again."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def quoted(c: Column) -> Column:
    """A value as a literal within a pattern."""
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def form_pattern(form: Column) -> Column:
    """The pattern by which a page may write a name: any case, hyphens or brackets between its words, a plural; a short name in capitals only as such."""
    words = F.regexp_extract_all(form, F.lit("([A-Za-z0-9]+)"))
    last = F.element_at(words, -1)
    cut = F.regexp_replace(last, r"(?i)^(.{3,}[^sS])s$", "$1")
    body = F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(cut)), r"[\s()-]+")
    acronym = (F.size(words) == 1) & F.get(words, F.lit(0)).rlike("^[A-Z0-9]{2,6}$")
    plain = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), body, F.lit(r"(?:s|es)?(?![A-Za-z0-9])"))
    exact = F.concat(F.lit(r"(?<![A-Za-z0-9])"), F.get(words, F.lit(0)), F.lit(r"(?![A-Za-z0-9])"))
    return F.when(F.size(words) > 0, F.when(acronym, exact).otherwise(plain))


def stems(c: Column, length: int = 7) -> Column:
    """The key of a term's spellings: each word cut to its first letters."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, length)), " ")


def initials(c: Column) -> Column:
    """The acronym of a phrase that is written out, null for others."""
    words = F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"))
    spelled = F.forall(words, lambda w: w.rlike("^[A-Za-z]") & ~w.rlike("^[A-Z0-9]{2,}s?$"))
    return F.when((F.size(words) >= 2) & spelled, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def concept_id(c: Column) -> Column:
    """A value as an id in snake case; unnamed_concept where nothing is left of it, or it is null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unnamed_concept"))


#: What stands in place of a quote where there is none (fixed values).
NO_QUOTES = ("n/a", "none", "not specified", "mentioned in text", "found on page", "various", "unknown")


def is_concept_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"), F.lit(False))


def is_quote(c: Column, least: int = 15) -> Column:
    """Whether a quote can prove something: long enough and no stand-in for one."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce((F.length(trimmed) >= least) & ~F.lower(trimmed).isin(*NO_QUOTES), F.lit(False))


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80), F.lit("")), F.lit("x"))


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: each line end as a space, and a quote before a leading sign; empty for null."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r|\n", " ")
    return F.when(flat.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), flat)).otherwise(flat)


def safe_filename(c: Column, fallback: str = "report", most: int = 100) -> Column:
    """A value as a file name: other characters as underscores, no dots, dashes or underscores at the ends, at most ``most`` characters; the fallback where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, most), F.lit("")), F.lit(fallback))


def ngrams(words: Column, most: int) -> Column:
    """All runs of up to ``most`` words as structs (pos, n, gram)."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.struct(i.alias("pos"), k.alias("n"), F.array_join(F.slice(words, i, k), " ").alias("gram")))))
    return F.filter(F.flatten(runs), lambda x: x.isNotNull())


def pick_spans(spans: Column) -> Column:
    """Of structs (pos, n, ...) those that a longest-first, left-to-right choice without overlap keeps."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).otherwise(a["pos"] - b["pos"]))
    return F.aggregate(
        ordered,
        F.filter(ordered, lambda _: F.lit(False)),
        lambda kept, x: F.when(F.exists(kept, lambda k: (k["pos"] < x["pos"] + x["n"]) & (x["pos"] < k["pos"] + k["n"])), kept).otherwise(F.array_append(kept, x)),
    )

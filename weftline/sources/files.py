"""Other sources: profiles, seed registries, event folders, sitemaps, article feeds, documents, labels and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch

CONCEPT = "struct<id: string, prefLabel: string, kind: string, definition: string, altLabels: array<string>, broader: string, governs: array<string>>"
PROFILE = f"vertical_id string, display_name string, core_seed_concepts array<string>, known_integrations array<string>, known_compliance array<string>, known_pricing array<string>, known_automation array<string>, concepts array<{CONCEPT}>"
SEED = "id string, kind string, prefLabel string, definition string, status string, aliases array<string>, domains array<string>, external map<string, string>, part_of string, parent_org string, distinct_from array<string>"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Vertical profiles, one JSON document a file."""
    return spark.read.schema(PROFILE).option("multiLine", True).json(path)


def profile_concepts(profiles: DataFrame) -> DataFrame:
    """The profiles' concepts as rows, with ``dangling``: whether the broader is no concept of the profile."""
    c = profiles.select("vertical_id", F.explode("concepts").alias("c")).select("vertical_id", "c.*")
    known = c.select("vertical_id", F.col("id").alias("broader"), F.lit(True).alias("known"))
    return c.join(known, ["vertical_id", "broader"], "left").select("vertical_id", "id", F.col("prefLabel").alias("preflabel"), "kind", "definition", F.col("altLabels").alias("altlabels"), "broader", "governs", (F.col("broader").isNotNull() & F.col("known").isNull()).alias("dangling"))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A seed registry, a JSON list of entities."""
    return spark.read.schema(SEED).option("multiLine", True).json(path)


def read_events(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Immutable event objects, one JSON document a file, as a table or as a stream of what arrives."""
    return (spark.readStream if stream else spark.read).schema(schema).option("multiLine", True).json(path)


def sitemap_urls(documents: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """(document, url): the pages that each sitemap document leads to, over any number of indexes of sitemaps that are themselves in ``documents``; an index that leads back to itself adds nothing."""
    scratch = Scratch(documents.sparkSession, "sitemaps")
    locs = documents.select(F.col(url).alias("document"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url")).distinct()
    locs = scratch.keep(locs.withColumn("inner", F.col("url").rlike(r"\.(xml|gz)$")))
    down = scratch.keep(locs.where("inner").select(F.col("document").alias("above"), F.col("url").alias("document")))
    # pages are listed once; what grows by a level each round are the pairs of an index and a map below it
    ways = [down]
    frontier = down
    while frontier.take(1):
        longer = frontier.join(down.select(F.col("above").alias("document"), F.col("document").alias("next")), "document").select("above", F.col("next").alias("document")).distinct()
        for known in ways:
            longer = longer.join(known, ["above", "document"], "left_anti")
        frontier = scratch.keep(longer)
        ways.append(frontier)
    every = locs.select("document", F.col("document").alias("map")).distinct()
    for known in ways:
        every = every.unionByName(known.select(F.col("above").alias("document"), F.col("document").alias("map")))
    pages = locs.where(~F.col("inner")).select(F.col("document").alias("map"), "url")
    return every.distinct().join(pages, "map").select("document", "url").distinct()


def articles(feeds: DataFrame, body: str = "body") -> DataFrame:
    """(id, title, url, locale, html) of help-centre responses in JSON; drafts and articles for some readers only are left out."""
    article = "struct<id: bigint, title: string, html_url: string, locale: string, body: string, draft: boolean, user_segment_id: bigint>"
    rows = feeds.select(F.explode(F.from_json(F.col(body), f"struct<articles: array<{article}>>")["articles"]).alias("a")).select("a.*")
    return rows.where(~F.coalesce("draft", F.lit(False)) & F.col("user_segment_id").isNull()).select("id", "title", F.col("html_url").alias("url"), "locale", F.col("body").alias("html"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, title) of text documents, a row a file; the title is the first heading, else the first of the first five lines of 4 to 79 characters."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("title", title(F.col("text")))


def title(text: Column) -> Column:
    lines = F.slice(F.split(text, r"\r?\n"), 1, 5)
    head = F.nullif(F.regexp_extract(text, r"(?m)^# +(.+?)\s*$", 1), F.lit(""))
    return F.coalesce(head, F.get(F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: F.length(s).between(4, 79) & ~s.startswith("{")), F.lit(0)))


#: What a document is by words in its address and title, in this order (fixed values).
CATEGORIES = {"security": ("security", "soc2", "soc-2", "compliance", "gdpr"), "api": ("api", "developer", "reference"), "pricing": ("pricing", "price"), "case_study": ("case-study", "case_study", "customer"), "whitepaper": ("whitepaper", "white-paper", "ebook", "report"), "datasheet": ("datasheet", "brochure", "overview")}


def classify_documents(links: DataFrame, limit: int | None = None) -> DataFrame:
    """(url, title, category) of links to documents, best categories and longer titles first."""
    text = F.lower(F.concat_ws(" ", "url", "title"))
    kind, rank = F.lit("other"), F.lit(len(CATEGORIES))
    for i, (name, hints) in reversed(list(enumerate(CATEGORIES.items()))):
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(text, F.lit(h))
        kind, rank = F.when(hit, name).otherwise(kind), F.when(hit, i).otherwise(rank)
    docs = links.where(F.col("url").rlike(r"(?i)\.(pdf|docx?|pptx?|xlsx?)($|\?)")).groupBy("url").agg(F.max("title").alias("title"))
    out = docs.select("url", "title", kind.alias("category"), rank.alias("rank"))
    return out if limit is None else out.orderBy("rank", F.desc(F.length(F.coalesce("title", F.lit("")))), "url").limit(limit)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed rows of a labelled CSV: rows whose ``correct`` is neither yes nor no are no negatives and left out."""
    return spark.read.csv(path, header=True).where(F.lower(F.trim("correct")).isin("yes", "no")).withColumn("correct", F.lower(F.trim("correct")) == "yes")


def cache_key(key: Column) -> Column:
    return F.sha2(F.lower(F.trim(key)), 256)


def fresh(cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The rows of a cache (key, content, stored_at) that are not older than ``seconds``, the latest of each key."""
    alive = cache.where(F.col("stored_at") > now - F.make_interval(secs=F.lit(seconds)))
    return alive.groupBy("key").agg(F.max(F.struct("stored_at", "content")).alias("m")).select("key", "m.content", "m.stored_at")

"""Sources and sinks: the test tables written in each format, read back, and held against what they held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..functions import urls as U
from ..operators import buyers, scores
from ..operators import knowledge as K
from ..plans.storage import Scratch
from ..sources import archive, files, rdf
from .tables import Query, table

#: The moment the caches and leases of these queries are looked at.
NOW = "2025-01-15 00:00:00"


def q_archive_sync(spark: SparkSession, folder: str) -> DataFrame:
    """All graphs published, the runs apart from the others, and what a store that knows only the runs has to index."""
    q, g = table(spark, folder, "quads"), table(spark, folder, "graphs")
    at = f"{Scratch(spark, 'archive').root}/published"
    run = q.join(g.where("kind = 'run'").select("graph_id"), "graph_id", "left_semi")
    rest = q.join(g.where("kind <> 'run'").select("graph_id"), "graph_id", "left_semi")
    archive.publish(run, g.where("kind = 'run'"), at)
    archive.publish(rest, g.where("kind <> 'run'"), at)
    fresh, quads = archive.sync(spark, g.where("kind = 'run'"), at)
    return fresh.select("graph_id", "kind").join(quads.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), "graph_id", "left").select("graph_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def q_archive_list(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of an archive by name: a file for each vertical of the concepts, partial files and locks hidden."""
    c = table(spark, folder, "concepts").groupBy("vertical_id").agg(F.count(F.lit(1)).cast("string").alias("value"))
    at = f"{Scratch(spark, 'listing').root}"
    for tail in (".json", ".lock", ".json.partial"):
        c.select("value", F.concat("vertical_id", F.lit(tail)).alias("name")).write.mode("append").partitionBy("name").text(f"{at}/objects")
    found = archive.listed(spark, f"{at}/objects").select(F.regexp_extract("path", r"/name=([^/]+)/[^/]+$", 1).alias("name"), "size")
    return found.where(~F.col("name").rlike(r"(\.partial|\.lock)$"))


def q_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Verticals written as profiles, a JSON document each, and their concepts read back."""
    c = table(spark, folder, "concepts")
    doc = F.struct("id", F.col("preflabel").alias("prefLabel"), "kind", "definition", F.col("altlabels").alias("altLabels"), "broader", "governs")
    profiles = c.groupBy("vertical_id").agg(F.collect_list(doc).alias("concepts"))
    at = Scratch(spark, "profiles").root
    profiles.select(F.to_json(F.struct("vertical_id", "concepts")).alias("value"), F.col("vertical_id").alias("v")).write.partitionBy("v").text(f"{at}/p")
    read = files.profile_concepts(files.read_profiles(spark, f"{at}/p/*"))
    return read.select("vertical_id", "id", "preflabel", "kind", "dangling", F.size(F.coalesce("altlabels", F.array().cast("array<string>"))).alias("labels"))


def q_seed(spark: SparkSession, folder: str) -> DataFrame:
    """The registry written as lists of entities, some hundred a file, and read back."""
    e = table(spark, folder, "entities")
    buckets = max(1, e.count() // 500)
    doc = F.struct("id", "kind", F.col("preflabel").alias("prefLabel"), "status", "domains", "part_of")
    lists = e.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets))).groupBy("b").agg(F.to_json(F.collect_list(doc)).alias("value"))
    at = Scratch(spark, "seed").root
    lists.write.partitionBy("b").text(f"{at}/s")
    return files.read_seed(spark, f"{at}/s/*").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("prefLabel").alias("preflabel"), F.max("part_of").alias("part_of"), F.max(F.size("domains")).alias("domains"))


def q_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """Every host's pages in sitemaps below three levels of indexes, and what each list leads to."""
    d = table(spark, folder, "documents").where(F.col("url").isNotNull()).select(U.host(F.col("url")).alias("host"), "url", "doc_id")
    leaf = d.select(F.format_string("https://%s/map-%d.xml", "host", F.col("doc_id") % 5).alias("at"), "host", F.concat(F.lit("<url><loc> "), "url", F.lit("\n</loc></url>")).alias("line"))
    index = lambda down, level: down.select(F.format_string("https://%s/%s.xml", "host", F.lit(level)).alias("new"), "host", F.concat(F.lit("<loc>"), "at", F.lit("</loc>")).alias("line")).distinct().withColumnRenamed("new", "at")
    one = index(leaf, "index")
    two = index(one, "all")
    three = index(two, "root")
    maps = leaf.unionByName(one).unionByName(two).unionByName(three).select(F.col("at").alias("url"), F.col("line").alias("text"))
    return files.sitemap_urls(maps).groupBy("document").agg(F.count(F.lit(1)).alias("pages"), F.min("url").alias("first"))


def q_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as the responses of a help centre, one in seven a draft, one in eleven for some readers only."""
    d = table(spark, folder, "documents")
    article = F.struct(F.col("doc_id").alias("id"), "title", F.col("url").alias("html_url"), F.col("lang").alias("locale"), F.col("text").alias("body"), (F.col("doc_id") % 7 == 0).alias("draft"), F.when(F.col("doc_id") % 11 == 0, 1).alias("user_segment_id"))
    feeds = d.select(F.to_json(F.struct(F.array(article).alias("articles"))).alias("body"))
    return files.articles(feeds).select("id", "title", "url", "locale", F.length("html").alias("length"))


def q_html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as HTML pages with navigation, embedded data and links, read back without them."""
    d = table(spark, folder, "documents").where(F.col("url").isNotNull() & F.col("title").isNotNull())
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<html><head><title>"), safe(F.col("title")), F.lit('</title><script type="application/ld+json">{"@type":"WebPage"}</script></head><body><nav><a href="/pricing#top">Pricing</a><a href="mailto:x@y">m</a></nav><div class="cookie-banner">Ok</div><main><h1>'),
        safe(F.col("title")), F.lit("</h1><p>"), safe(F.col("text")), F.lit("</p></main><footer>Imprint</footer></body></html>"),
    )
    got = html.pages(d.select("url", page.alias("html"), "doc_id"), "url", "html")
    flat = F.regexp_replace("text", "[^A-Za-z0-9]+", "")
    return got.select("url", F.length(flat).alias("letters"), F.regexp_replace("title", "[^A-Za-z0-9]+", "").alias("title"), F.array_join("schema_types", ",").alias("types"), F.size("links").alias("links"), "challenge").distinct()


def q_title_place(spark: SparkSession, folder: str) -> DataFrame:
    """The title a text carries: its first heading, else the first of its first five lines of 4 to 79 characters."""
    d = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", files.title(F.col("text")).alias("heading"))


def q_document_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pages taken for links to documents, by what they are."""
    d = table(spark, folder, "documents").where(F.col("url").isNotNull())
    return files.classify_documents(d.select(F.concat("url", F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".docx?v=1").otherwise(".html")).alias("url"), "title")).select("url", "title", "category")


def q_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates as a reviewed CSV: a row that says neither yes nor no is left out."""
    c = table(spark, folder, "candidates")
    rows = c.select("candidate_id", F.regexp_replace(F.coalesce("surface_form", F.lit("")), r"[\r\n]", " ").alias("form"), F.when(F.col("closes_gap"), " Yes").when(~F.col("closes_gap") & (F.col("candidate_id") % 2 == 0), "no").otherwise("maybe").alias("correct"))
    at = Scratch(spark, "labels").root
    rows.write.option("header", True).option("escape", '"').csv(f"{at}/l")
    return files.read_labels(spark, f"{at}/l").groupBy("candidate_id", "correct").agg(F.count(F.lit(1)).alias("n")).select(F.col("candidate_id").cast("bigint").alias("candidate_id"), "correct", "n")


def q_cache_fresh(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a cache by site, looked at for what is younger than ten days."""
    d = table(spark, folder, "documents").where(F.col("source").isNotNull())
    cache = d.select(files.cache_key(F.col("source")).alias("key"), F.col("doc_id").cast("string").alias("content"), F.col("crawled_at").cast("timestamp").alias("stored_at"))
    return files.fresh(cache, F.lit(NOW).cast("timestamp"), 10 * 86400).select("key", "content")


def q_stale_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as jobs, of which those that nobody has held for a week may be taken up."""
    r = table(spark, folder, "synonym_requests")
    jobs = r.select("request_id", F.when(F.col("request_id") % 3 == 0, "done").otherwise("running").alias("status"), F.when(F.col("request_id") % 5 != 0, F.col("requested_at")).alias("leased_at")).distinct()
    return K.stale(jobs, F.lit(NOW).cast("timestamp"), 7 * 86400).select("request_id", "status")


def q_identity_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal names against the links and the exclusions that the registry states."""
    e = table(spark, folder, "entities").where(F.col("id").isNotNull())
    groups = e.groupBy("id").agg(F.lower(F.min("preflabel")).alias("group_id")).where("group_id is not null")
    same = e.select(F.col("id").alias("a"), F.trim("merged_into").alias("b")).distinct()
    different = e.select(F.col("id").alias("a"), F.explode("distinct_from").alias("b")).select("a", F.trim("b").alias("b")).distinct()
    return scores.identity_violations(groups, same, different)


def q_discovery_confidence(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "observations").dropDuplicates(["observation_id"])
    return o.select("observation_id", scores.discovery_confidence(F.coalesce("pages_crawled", F.lit(0)), F.col("observation_id") % 4, F.size("forms"), F.size(F.filter("forms", lambda f: f["target"].isNotNull()))).alias("confidence"))


def q_merged_values(spark: SparkSession, folder: str) -> DataFrame:
    """Other labels of each vertical, joined by the forms that candidates bring."""
    old = table(spark, folder, "concepts").select("vertical_id", F.explode("altlabels").alias("value"), F.col("id").alias("ord"))
    new = table(spark, folder, "candidates").select("vertical_id", F.col("surface_form").alias("value"), F.col("candidate_id").cast("string").alias("ord"))
    return buyers.merged_values(old, new, ["vertical_id"], "value", "ord")


def q_form_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern by which pages may write each label."""
    return table(spark, folder, "concepts").select("id", T.form_pattern(F.col("preflabel")).alias("pattern"))


def q_turtle_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Quads written as Turtle and read again, counted by kind of object."""
    blocks = rdf.turtle(table(spark, folder, "quads"))
    return rdf.parse_turtle(blocks.select("graph_id", "text")).distinct().groupBy("graph_id", "o_kind").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (q_archive_sync, q_archive_list, q_profiles, q_seed, q_sitemaps, q_articles, q_html_pages, q_title_place, q_document_links, q_labels, q_cache_fresh, q_stale_jobs, q_identity_violations, q_discovery_confidence, q_merged_values, q_form_patterns, q_turtle_parse)}


def oracle_sql() -> dict[str, str]:
    return {
        "q_archive_sync": "select g.graph_id, g.kind, (select count(*) from quads q where q.graph_id = g.graph_id) as n from graphs g where g.kind <> 'run'",
        "q_archive_list": "select vertical_id || '.json' as name, length(count(*)::varchar) + 1 as size from concepts group by vertical_id",
        "q_profiles": "select vertical_id, id, preflabel, kind, broader is not null and not exists (select 1 from concepts b where b.vertical_id = c.vertical_id and b.id = c.broader) as dangling, coalesce(len(altlabels), 0) as labels from concepts c",
        "q_seed": "select id, count(*) as n, min(preflabel) as preflabel, max(part_of) as part_of, max(len(domains)) as domains from entities group by id",
        "q_sitemaps": """
            with d as (select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) as host, url, doc_id from documents where url is not null),
            m as (select distinct 'https://' || host || '/map-' || (doc_id % 5) || '.xml' as document, url from d union select distinct 'https://' || host || '/' || l || '.xml', url from d, (values ('index'), ('all'), ('root')) v(l))
            select document, count(*) as pages, min(url) as first from m group by 1""",
        "q_articles": "select doc_id as id, title, url, lang as locale, length(text) as length from documents where doc_id % 7 <> 0 and doc_id % 11 <> 0",
        "q_html_pages": """select distinct url, length(regexp_replace(coalesce(title, '') || coalesce(text, ''), '[^A-Za-z0-9]+', '', 'g')) as letters, regexp_replace(title, '[^A-Za-z0-9]+', '', 'g') as title, 'WebPage' as types, 1 as links, null as challenge
            from documents where url is not null and title is not null""",
        "q_title_place": """
            select doc_id, coalesce(nullif(regexp_extract(text, '(?m)^# +([^\\n]+?)[ \\t\\r]*$', 1), ''), list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n')[1:5], lambda s: trim(s, ' ')), lambda s: length(s) between 4 and 79 and not starts_with(s, '{'))[1]) as heading
            from documents where text is not null""",
        "q_document_links": """
            with l as (select url || case doc_id % 3 when 0 then '.pdf' when 1 then '.docx?v=1' else '.html' end as url, title from documents where url is not null),
            d as (select url, max(title) as title from l where regexp_matches(url, '(?i)\\.(pdf|docx?|pptx?|xlsx?)($|\\?)') group by url),
            t as (select *, lower(concat_ws(' ', url, title)) as t from d)
            select url, title, case when regexp_matches(t, 'security|soc2|soc-2|compliance|gdpr') then 'security' when regexp_matches(t, 'api|developer|reference') then 'api' when regexp_matches(t, 'pricing|price') then 'pricing'
              when regexp_matches(t, 'case-study|case_study|customer') then 'case_study' when regexp_matches(t, 'whitepaper|white-paper|ebook|report') then 'whitepaper' when regexp_matches(t, 'datasheet|brochure|overview') then 'datasheet' else 'other' end as category from t""",
        "q_labels": "select candidate_id, closes_gap as correct, count(*) as n from candidates where closes_gap or (not closes_gap and candidate_id % 2 = 0) group by 1, 2",
        "q_cache_fresh": f"select sha256(lower(trim(source, ' '))) as key, arg_max(doc_id::varchar, (crawled_at, doc_id::varchar)) as content from documents where source is not null and crawled_at > timestamp '{NOW}' - interval 10 day group by 1",
        "q_stale_jobs": f"select distinct request_id, 'running' as status from synonym_requests where request_id % 3 <> 0 and (request_id % 5 = 0 or requested_at is null or epoch(timestamp '{NOW}') - floor(epoch(requested_at)) >= 7 * 86400)",
        "q_identity_violations": """
            with g as (select id, lower(min(preflabel)) as group_id from entities where id is not null group by id having min(preflabel) is not null),
            pairs as (select distinct 'split' as kind, id as a, trim(merged_into, ' ') as b from entities where merged_into is not null union select distinct 'merged', id, trim(unnest(distinct_from), ' ') from entities)
            select p.kind, p.a, p.b from pairs p join g x on x.id = p.a join g y on y.id = p.b where (p.kind = 'split' and x.group_id <> y.group_id) or (p.kind = 'merged' and x.group_id = y.group_id)""",
        "q_discovery_confidence": """
            select distinct observation_id, round(0.4::double + 0.3::double * least(coalesce(pages_crawled, 0), 8) / 8 + 0.3::double * case when len(forms) > 0 then len(list_filter(forms, lambda f: f.target is not null)) / len(forms) when observation_id % 4 >= 2 then 0.0 else 0.5 end, 3) as confidence from observations""",
        "q_merged_values": """
            with b as (select vertical_id, unnest(altlabels) as value, 0 as late, id as ord from concepts union all select vertical_id, surface_form, 1, candidate_id::varchar from candidates),
            r as (select *, row_number() over (partition by vertical_id, lower(trim(value, ' ')) order by late, ord, value) as rn from b where trim(value, ' ') <> '')
            select vertical_id, value, late = 1 as new from r where rn = 1""",
        "q_form_patterns": """
            with w as (select id, regexp_extract_all(preflabel, '[A-Za-z0-9]+') as w from concepts)
            select id, case when len(w) = 0 then null when len(w) = 1 and regexp_full_match(w[1], '[A-Z0-9]{2,6}') then '(?<![A-Za-z0-9])' || w[1] || '(?![A-Za-z0-9])'
              else '(?i)(?<![A-Za-z0-9])' || array_to_string(w[:-2] || [regexp_replace(w[-1], '^(.{3,}[^sS])[sS]$', '\\1')], '[\\s()-]+') || '(?:s|es)?(?![A-Za-z0-9])' end as pattern from w""",
        "q_turtle_parse": "select graph_id, o_kind, count(*) as n from (select distinct graph_id, s, s_kind, p, o, o_kind, o_datatype, case when o_datatype is null then o_lang end as o_lang from quads) group by 1, 2",
    }

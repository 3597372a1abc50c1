"""Streams that end with what is there, buyers' situations, and texts written from quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as U
from ..operators import buyers, extraction
from ..sources import rdf
from ..streaming import folds
from .tables import Query, table


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return folds.read_table(spark, f"{folder}/{name}.parquet")


def q_stream_fold(spark: SparkSession, folder: str) -> DataFrame:
    return folds.latest_decisions(_stream(spark, folder, "vocabulary_decisions")).select("vertical_id", "key", "event_id", "decision", "label")


def q_stream_append(spark: SparkSession, folder: str) -> DataFrame:
    return folds.append_quads(_stream(spark, folder, "quads")).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


def q_stream_blocks(spark: SparkSession, folder: str) -> DataFrame:
    found = folds.repeated_blocks(_stream(spark, folder, "documents"), "source", "doc_id", "text")
    return found.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("dropped").alias("dropped"))


def q_stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    got = folds.windowed_counts(_stream(spark, folder, "events"), "ts", "event_type", late="3650 days")
    return got.select(F.unix_seconds("start").alias("start"), "key", "n")


def q_stream_yield(spark: SparkSession, folder: str) -> DataFrame:
    d = _stream(spark, folder, "documents").where(F.col("url").isNotNull())
    reads = d.select(U.host(F.col("url")).alias("site"), F.coalesce(F.element_at(U.segments(F.col("url")), 1), F.lit("home")).alias("kind"), F.col("doc_id").alias("seq"), (F.coalesce(F.col("n_chars"), F.lit(0)) > 1000).cast("int").alias("new"))
    return folds.page_yield(reads)


def q_situations(spark: SparkSession, folder: str) -> DataFrame:
    """Triggers, pains and roles that the sentences of a page state, counted."""
    s = extraction.sentences(table(spark, folder, "documents"), "doc_id")
    told = s.select("doc_id", buyers.role(F.col("sentence")).alias("role"), buyers.trigger(F.col("sentence")).alias("trigger"), F.array_join(buyers.pains(F.col("sentence")), ",").alias("pains"))
    told = told.where(F.col("role").isNotNull() | F.col("trigger").isNotNull() | (F.col("pains") != ""))
    return told.groupBy("doc_id", "role", "trigger", "pains").agg(F.count(F.lit(1)).alias("n"))


def q_situation_report(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of pain over all sites."""
    s = extraction.sentences(table(spark, folder, "documents").select("source", "text"), "source")
    return s.select("source", F.explode(buyers.pains(F.col("sentence"))).alias("pain")).groupBy("source", "pain").agg(F.count(F.lit(1)).alias("n"))


def q_situation_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of stored situations as columns: the inverse of their quads."""
    q = table(spark, folder, "quads").where(F.col("graph_id").contains("/situations/"))
    at = lambda p: F.min(F.when(F.col("p") == f"https://onto.example/terms/{p}", F.col("o"))).alias(p)
    return q.groupBy("graph_id", "s").agg(*[at(p) for p in ("before", "trigger", "pain", "need", "evidence")])


def q_claim_check(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as claims about a page, its own first line or another page's as the quote."""
    d = table(spark, folder, "documents").where(F.col("url").isNotNull() & F.col("title").isNotNull())
    claims = d.select(F.coalesce("source", F.lit("")).alias("subject"), F.col("title").alias("value"), F.when(F.col("doc_id") % 5 == 0, F.concat("url", F.lit("-gone"))).otherwise(F.col("url")).alias("url"), F.substring(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), 1, 200).alias("quote")).distinct()
    return buyers.checked_claims(claims, d.select("url", "text")).groupBy("subject", "verdict").agg(F.count(F.lit(1)).alias("n"))


#: Questions of a stage about a subject of a role (fixed values).
TEMPLATES = [("process", 1, "how do teams automate {subject}", 1), ("process", 2, "best software for {subject}", 2), ("feature", 2, "which tools offer {subject}", 3), ("standard", 1, "what does {subject} require", 4), ("standard", 3, "which vendors comply with {subject}", 5), ("pricing", 3, "how is {subject} priced", 6), ("domain", 1, "what is {subject}", 7), ("domain", 2, "best software for {subject}", 8)]


def q_prompts(spark: SparkSession, folder: str) -> DataFrame:
    templates = spark.createDataFrame(TEMPLATES, "role string, stage int, template string, ord int")
    subjects = table(spark, folder, "concepts").select("vertical_id", F.col("kind").alias("role"), F.col("preflabel").alias("subject"))
    return buyers.prompts(templates, subjects)


def q_ntriples(spark: SparkSession, folder: str) -> DataFrame:
    """Quads written as N-Triples and read again, counted by kind of object."""
    lines = rdf.ntriples(table(spark, folder, "quads"))
    return rdf.parse_ntriples(lines, "value", F.col("graph_id")).distinct().groupBy("graph_id", "o_kind", "o_datatype", "o_lang").agg(F.count(F.lit(1)).alias("n"))


def q_turtle(spark: SparkSession, folder: str) -> DataFrame:
    """The Turtle of every subject, by its digest."""
    return rdf.turtle(table(spark, folder, "quads")).select("graph_id", "s", "part", F.sha1("text").alias("text"))


def q_jsonld(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects of the subjects, read back as JSON and counted by their keys."""
    j = rdf.jsonld(table(spark, folder, "quads"))
    return j.select("graph_id", "s", "part", (F.size(F.json_object_keys("text")) - 1).alias("predicates"))


def q_claim_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Names of reified claims: twenty digits of the hash of what they state."""
    q = table(spark, folder, "quads").where(F.col("p").startswith("https://onto.example/terms/") & (F.col("o_kind") == "uri"))
    return q.select("graph_id", F.substring(F.sha1(F.concat_ws("|", "s", "p", "o", "graph_id")), 1, 20).alias("claim")).distinct()


def q_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """OWL individuals of the observed keys, one per slug."""
    o = table(spark, folder, "observations").select(F.explode("forms").alias("f")).select(F.col("f.key").alias("key"))
    return o.where(F.trim("key") != "").groupBy(tx.slug(F.col("key")).alias("slug")).agg(F.count_distinct("key").alias("spellings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (q_stream_fold, q_stream_append, q_stream_blocks, q_stream_windows, q_stream_yield, q_situations, q_situation_report, q_situation_parts, q_claim_check, q_prompts, q_ntriples, q_turtle, q_jsonld, q_claim_ids, q_slugs)}


#: The concepts that a template may be about, and how they stand in it, in SQL.
PHRASE = "array_to_string(list_transform(list_filter(regexp_split_to_array(trim(c.preflabel, ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), lambda w: case when regexp_full_match(w, '[A-Z0-9][A-Z0-9&/.-]*') or regexp_matches(w, '.[A-Z]') then w else lower(w) end), ' ')"
_STEM = "substr(regexp_replace(lower(w), 'y$', 'i'), 1, 6)"
APART = f"not list_has_any(list_transform(list_filter(regexp_extract_all(regexp_replace(t.template, '\\{{\\w+\\}}', ' ', 'g'), '[a-z]+'), lambda w: w not in ({', '.join(repr(w) for w in buyers.TEMPLATE_WORDS)})), lambda w: {_STEM}), list_transform(regexp_extract_all(c.preflabel, '[A-Za-z]+'), lambda w: {_STEM}))"


def _term(value: str, kind: str) -> str:
    """A term as SQL text."""
    safe = f"replace(replace(replace(replace({value}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"
    return f"(case {kind} when 'literal' then chr(34) || {safe} || chr(34) when 'bnode' then {value} else '<' || {value} || '>' end)"


def oracle_sql() -> dict[str, str]:
    lines = """rows_ as (select coalesce(source, '') as site, doc_id, unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) as line from documents where text is not null),
            blocks as (select site, doc_id, substr(sha1(lower(trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))), 1, 12) as key from rows_ where length(trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) >= 8)"""
    filler = ", ".join(f"'{w}'" for w in buyers.FILLER)
    prompts = " union all ".join(f"select '{r}' as role, {s} as stage, '{t}' as template, {o} as ord" for r, s, t, o in TEMPLATES)
    return {
        "q_stream_fold": "select vertical_id, key, event_id, decision, label from (select *, row_number() over (partition by vertical_id, key order by event_id desc nulls last) as rn from vocabulary_decisions) where rn = 1",
        "q_stream_append": "select graph_id, count(*) as n from (select distinct graph_id, s, p, o, o_kind, coalesce(o_datatype, ''), coalesce(o_lang, '') from quads) group by 1",
        "q_stream_windows": "select epoch(date_trunc('hour', ts::timestamp))::bigint as start, event_type as key, count(*) as n from events group by 1, 2",
        "q_stream_blocks": f"""with {lines}, per as (select site, key, doc_id, count(*) as n, row_number() over (partition by site, key order by doc_id) as i from blocks group by 1, 2, 3)
            select site, key, sum(n)::bigint as n, coalesce(sum(n) filter (i >= 3), 0)::bigint as dropped from per group by 1, 2""",
        "q_situation_parts": "select graph_id, s, " + ", ".join(f"min(o) filter (p = 'https://onto.example/terms/{p}') as {p}" for p in ("before", "trigger", "pain", "need", "evidence")) + " from quads where contains(graph_id, '/situations/') group by 1, 2",
        "q_prompts": f"""with t as ({prompts}), m as (select c.vertical_id, t.stage, t.ord, c.preflabel as subject, replace(t.template, '{{subject}}', {PHRASE}) as prompt from concepts c join t on t.role = c.kind where {APART}),
            r as (select *, row_number() over (partition by vertical_id, lower(prompt) order by stage, ord, subject, prompt) as rn from m) select vertical_id, stage, subject, prompt, ord from r where rn = 1""",
        "q_ntriples": "select graph_id, o_kind, o_datatype, case when o_datatype is null then o_lang end as o_lang, count(*) as n from (select distinct graph_id, s, s_kind, p, o, o_kind, o_datatype, case when o_datatype is null then o_lang end as o_lang from quads) group by 1, 2, 3, 4",
        "q_jsonld": "select graph_id, s, 0 as part, count(distinct p) as predicates from quads group by 1, 2",
        "q_turtle": f"""with t as (select distinct graph_id, s, s_kind, '<' || p || '> ' || ({_term('o', 'o_kind')} || case when o_kind = 'literal' then case when o_datatype is not null then '^^<' || o_datatype || '>' when o_lang is not null then '@' || o_lang else '' end else '' end) as po from quads)
            select graph_id, s, 0 as part, sha1({_term('s', 's_kind')} || ' ' || string_agg(po, ' ;' || chr(10) || '    ' order by po) || ' .') as text from t group by graph_id, s, s_kind""",
        "q_claim_check": f"""
            with d as (select * from documents where url is not null and title is not null),
            claims as (select distinct coalesce(source, '') as subject, title as value, case when doc_id % 5 = 0 then url || '-gone' else url end as url, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 200) as quote from d),
            read as (select url, arg_min(text, length(text)) as page from d group by url),
            r as (select c.*, row_number() over (partition by subject, lower(value) order by c.url nulls first, quote nulls first) as rn, read.page, read.url is not null as has from claims c left join read on read.url = c.url),
            t as (select *, substr(array_to_string(regexp_extract_all(lower(coalesce(quote, '')), '[a-z0-9]+'), ' '), 1, 60) as start, array_to_string(regexp_extract_all(lower(coalesce(page, '')), '[a-z0-9]+'), ' ') as said,
              list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce(value, '')), '[a-z0-9]+'), lambda w: length(w) > 3 and w not in ({filler})), lambda w: substr(w, 1, 5))) as mine,
              list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce(quote, '')), '[a-z0-9]+'), lambda w: length(w) > 3 and w not in ({filler})), lambda w: substr(w, 1, 5))) as theirs from r)
            select subject, case when rn > 1 then 'repeated' when page is null then 'bad_url' when start = '' or not contains(said, start) then 'quote_not_found'
              when coalesce(len(list_intersect(mine, theirs)) / nullif(len(mine), 0), 0) < 0.5 then 'unsupported' else 'kept' end as verdict, count(*) as n from t group by 1, 2""",
        "q_claim_ids": "select distinct graph_id, substr(sha1(concat_ws('|', s, p, o, graph_id)), 1, 20) as claim from quads where starts_with(p, 'https://onto.example/terms/') and o_kind = 'uri'",
        "q_slugs": """select coalesce(nullif(substr(regexp_replace(regexp_replace(lower(f.key), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'x') as slug, count(distinct f.key) as spellings
            from (select unnest(forms) as f from observations) where trim(f.key, ' ') <> '' group by 1""",
    }

"""Texts and URLs over documents and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .tables import Query, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def q_page_key(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where(F.col("url").isNotNull()).select("doc_id", U.page_key(F.col("url")).alias("page_key"), U.clean(F.col("url")).alias("clean_url"), U.locale_rank(F.col("url")).alias("locale_rank"))


def q_registrable_domain(spark: SparkSession, folder: str) -> DataFrame:
    hosts = table(spark, folder, "graphs").select(F.lower("domain").alias("host")).where(F.col("host").isNotNull()).distinct()
    return hosts.select("host", U.registrable(F.col("host")).alias("domain"), U.label(F.col("host")).alias("label"))


def q_page_kind(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder).where(F.col("url").isNotNull())
    return d.select("doc_id", U.page_kind(F.col("url"), U.host(F.col("url"))).alias("kind"))


def q_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Each page once: how often it is linked, and the copy of the best locale."""
    d = _docs(spark, folder).where(F.col("url").isNotNull())
    keyed = d.select("doc_id", "url", U.page_key(F.col("url")).alias("page_key"), U.locale_rank(F.col("url")).alias("rank"))
    return keyed.groupBy("page_key").agg(F.count(F.lit(1)).alias("inlinks"), F.min_by("url", F.struct("rank", "url")).alias("url"), F.min("doc_id").alias("first_seen"))


def q_block_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = T.lines(_docs(spark, folder), ["doc_id"]).select("doc_id", "pos", T.block_key(F.col("line")).alias("key"))
    return rows.where(F.col("key").isNotNull())


def q_repeated_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each site the boilerplate lines: on how many pages they stand and from how many they are dropped."""
    found = T.repeated_blocks(_docs(spark, folder), "source", "doc_id")
    return found.where(F.col("pages") >= 3).groupBy("source", "key", "pages").agg(F.count_if("dropped").alias("dropped"))


def q_proof_units(spark: SparkSession, folder: str) -> DataFrame:
    return T.proof_units(_docs(spark, folder), "doc_id")


def q_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder).select("doc_id", T.split_words(F.col("text")).alias("words"))
    return d.select("doc_id", F.posexplode(T.word_windows(F.col("words"))).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("length"), F.sha1("chunk").alias("chunk"))


def q_glued_words(spark: SparkSession, folder: str) -> DataFrame:
    """Titles run together with a byline, as cards of a list of articles do, and what they are taken apart to."""
    d = _docs(spark, folder).where(F.col("title").isNotNull() & F.col("crawled_at").isNotNull())
    card = F.concat(F.lit("By"), F.col("title"), F.date_format("crawled_at", "MMMM d, yyyy"), F.lit("Blog"), F.col("title"), F.lit("CEO, "), F.col("source"))
    return d.select("doc_id", T.repair_glued_words(card).alias("fixed")).where("fixed is not null")


def q_safe_cells(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidates")
    v = F.col("surface_form")
    return c.select("candidate_id", T.csv_safe(v).alias("cell"), T.concept_id(v).alias("id"), T.slug(v).alias("slug"), T.safe_filename(v).alias("file"), T.is_concept_id(v).alias("is_id"), T.is_quote(v).alias("is_quote")).distinct()


def q_term_stems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "concepts").select("id", T.stems(F.lower("preflabel")).alias("stem"), T.initials(F.col("preflabel")).alias("initials"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (q_page_key, q_registrable_domain, q_page_kind, q_candidates, q_block_keys, q_repeated_blocks, q_proof_units, q_chunks, q_glued_words, q_safe_cells, q_term_stems)}


_URL = """urls as (
  select doc_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) as host,
    list_filter(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') as parts
  from documents where url is not null
),
keyed as (
  select doc_id, url, host, parts,
    case when regexp_full_match(parts[1], 'en([-_][a-z]{2})?') then 1 when regexp_full_match(parts[2], 'en([-_][a-z]{2})?') then 2 else 0 end as cut
  from urls
),
named as (
  select doc_id, url, host, parts, regexp_replace(host, '^www\\.', '') || '/' || array_to_string(list_filter(parts, lambda s, i: i <> cut), '/') as page_key, regexp_replace(url, '[?#].*$', '') as clean_url,
    case when cut = 0 then 0 when parts[cut] in ('en', 'en-us', 'en_us') then 1 else 2 end as locale_rank
  from keyed
)"""
_LINES = """rows_ as (
  select doc_id, source, unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), 1) - 1 as pos
  from documents where text is not null
),
flat as (select *, lower(trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as f from rows_),
blocks as (select doc_id, source, pos::int as pos, substr(sha1(f), 1, 12) as key from flat where length(f) >= 8)"""


def _kind_sql() -> str:
    """The page kinds as a CASE over segment x, for the SQL of q_page_kind."""
    cases = " ".join(f"when regexp_full_match(x, '{U._pattern(h)[1:-1]}') then '{k}'" for k, h in U.PAGE_KINDS.items())
    return f"case {cases} end"


def oracle_sql() -> dict[str, str]:
    containers = ", ".join(f"'{c}'" for c in U.CONTAINERS)
    locales = ", ".join(f"'{c}'" for c in U.LOCALES)
    return {
        "q_page_key": f"with {_URL} select doc_id, page_key, clean_url, locale_rank from named",
        "q_registrable_domain": """
            with h as (select distinct lower(domain) as host from graphs where domain is not null), l as (select host, string_split(host, '.') as ls from h)
            select host, array_to_string(case when len(ls) >= 3 and ls[-2] in ('co', 'com', 'org', 'net', 'ac') and length(ls[-1]) = 2 then ls[-3:] else ls[-2:] end, '.') as domain,
              split_part(regexp_replace(host, '^www\\.', ''), '.', 1) as label from l""",
        "q_page_kind": f"""with {_URL},
            kinds as (select doc_id, url, host, parts, list_filter(list_transform(parts, lambda x: {{'s': x, 'k': {_kind_sql()}}}), lambda y: y.k is not null) as ks from named)
            select doc_id, case
              when not regexp_matches(lower(url), '^https?://') or regexp_matches(lower(array_to_string(parts, '/')), '{U.ASSETS}') or len(list_filter(ks, lambda y: y.k = 'excluded')) > 0
                or len(list_filter(parts[1:2], lambda s: regexp_full_match(s, '[a-z]{{2}}([-_][a-z]{{2}})?') and s not in ('en', 'en-us', 'en-gb', 'en_us', 'en_gb') and s[1:2] in ({locales}))) > 0 then null
              when len(parts) = 0 then 'home'
              else coalesce(list_filter(ks, lambda y: y.s not in ({containers}))[1].k, ks[1].k, 'other') end as kind from kinds""",
        "q_candidates": f"with {_URL} select page_key, count(*) as inlinks, arg_min(url, (locale_rank, url)) as url, min(doc_id) as first_seen from named group by 1",
        "q_block_keys": f"with {_LINES} select doc_id, pos, key from blocks",
        "q_repeated_blocks": f"""with {_LINES}, c as (select source, key, count(distinct doc_id) as pages, count(*) as n from blocks group by 1, 2)
            select source, key, pages, n - 1 as dropped from c where pages >= 3""",
        "q_chunks": """
            with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from documents where text is not null),
            s as (select doc_id, w, unnest(range(0, greatest(len(w) - 25 - 1, 0) + 1, 175)) as i from w where len(w) > 0),
            c as (select doc_id, (i / 175)::int as pos, array_to_string(w[i + 1:i + 200], ' ') as chunk from s)
            select doc_id, pos, length(chunk) as length, sha1(chunk) as chunk from c""",
        "q_term_stems": """
            select id, array_to_string(list_transform(string_split(lower(preflabel), ' '), lambda w: substr(w, 1, 7)), ' ') as stem,
              case when len(regexp_extract_all(preflabel, '[A-Za-z0-9]+')) >= 2 and len(list_filter(regexp_extract_all(preflabel, '[A-Za-z0-9]+'), lambda w: not regexp_matches(w, '^[A-Za-z]') or regexp_full_match(w, '[A-Z0-9]{2,}s?'))) = 0
                then upper(array_to_string(list_transform(regexp_extract_all(preflabel, '[A-Za-z0-9]+'), lambda w: w[1]), '')) end as initials
            from concepts""",
        "q_proof_units": """
            with r as (select doc_id, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as raw from (select doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from documents where text is not null)),
            t as (select doc_id, pos, trim(regexp_replace(trim(regexp_replace(raw, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), ' '), '^[-*• ]+', ''), ' ') as line from r),
            k as (select *, length(line) <= 60 and not regexp_matches(line, '[.!?]$') as short from t where line <> '' and not regexp_matches(line, '(?i)^(hit enter to search|skip to (main )?content|search( for)?[:.]?$|close( menu)?$|menu$|(first|last) ?name\\**$|e-?mail\\**$|stage$|lead source$|last call to action( details)?$|article created .* ago$|number of comments: ?\\d+$|recent activity$|promoted articles$)')),
            h as (select *, last_value(case when short then regexp_replace(line, ':+$', '') end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as heading from k),
            c as (select *, case when short then [line] else string_split(regexp_replace(line, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) end as ss from h),
            u as (select doc_id, pos, short, heading, generate_subscripts(ss, 1) - 1 as part, trim(unnest(ss), ' ') as s from c)
            select doc_id, pos, part, case when short or heading is null or heading = '' then s else heading || ' — ' || s end as unit from u where length(s) > 15""",
        "q_glued_words": """
            with cards as (select doc_id, 'By' || title || strftime(crawled_at, '%B %-d, %Y') || 'Blog' || title || 'CEO, ' || source as c from documents where title is not null and crawled_at is not null and source is not null),
            a as (select doc_id, regexp_replace(c, '([a-z])((?:January|February|March|April|May|June|July|August|September|October|November|December)[ \\t\\n\\x0B\\f\\r]+[0-9])', '\\1 \\2', 'g') as c from cards),
            b as (select doc_id, regexp_replace(c, '([a-z])((?:CEO|CFO|CTO|COO|CRO|CMO|SVP|EVP|VP|Founder|Co-Founder)\\b)', '\\1 \\2', 'g') as c from a),
            y as (select doc_id, regexp_replace(c, '(^|[^0-9])((?:19|20)[0-9][0-9])([A-Z][a-z])', '\\1\\2 \\3', 'g') as c from b)
            select doc_id, regexp_replace(c, '\\b(By|Blog)([A-Z][a-z])', '\\1 \\2', 'g') as fixed from y""",
        "q_safe_cells": """
            with c as (select distinct candidate_id, surface_form as v, replace(replace(replace(coalesce(surface_form, ''), chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' ') as flat from candidates)
            select distinct candidate_id, case when left(flat, 1) in ('=', '+', '-', '@', chr(9)) then chr(39) else '' end || flat as cell,
              coalesce(nullif(regexp_replace(regexp_replace(lower(trim(v)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed_concept') as id,
              coalesce(nullif(substr(regexp_replace(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'x') as slug,
              coalesce(nullif(left(regexp_replace(regexp_replace(coalesce(v, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 100), ''), 'report') as file,
              coalesce(regexp_full_match(v, '[a-z0-9]+(_[a-z0-9]+)*'), false) as is_id,
              coalesce(length(trim(v)) >= 15 and lower(trim(v)) not in ('n/a', 'none', 'not specified', 'mentioned in text', 'found on page', 'various', 'unknown'), false) as is_quote
            from c""",
    }

"""Vocabulary operators over documents, concepts, entities and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import extraction, hierarchy
from ..operators import vocabulary as V
from .tables import Query, table


def _found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return V.occurrences(docs, ["doc_id", "source"], V.vocabulary(table(spark, folder, "concepts")))


def q_vocab_match(spark: SparkSession, folder: str) -> DataFrame:
    """How often each form stands in each document."""
    return _found(spark, folder).groupBy("doc_id", "vertical_id", "concept_id", "form").agg(F.count(F.lit(1)).alias("n"))


def q_longest_names(spark: SparkSession, folder: str) -> DataFrame:
    return V.longest_first(_found(spark, folder), ["doc_id"])


def q_classify(spark: SparkSession, folder: str) -> DataFrame:
    return V.classify(V.evidence(_found(spark, folder), "doc_id", distinctive=True), "doc_id", least=3)


def q_seed_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Which share of each vertical's concepts a site's pages name."""
    return V.coverage(_found(spark, folder), "source", table(spark, folder, "concepts"))


def q_gap(spark: SparkSession, folder: str) -> DataFrame:
    return V.gaps(_found(spark, folder).where(F.col("source").isNotNull()), "source")


def q_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of each sentence that stand in no longer one."""
    told = extraction.sentences(table(spark, folder, "documents"), "doc_id")
    found = V.occurrences(told, ["doc_id", "sent"], V.vocabulary(table(spark, folder, "concepts")), "sentence")
    return V.without_parts(found, ["doc_id", "sent"])


def q_triples(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.triples(table(spark, folder, "documents"), "doc_id", V.vocabulary(table(spark, folder, "concepts")))


def q_label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """How many registry entries each alias names, and which where it is one."""
    e = table(spark, folder, "entities").select("id", F.explode("aliases").alias("a")).select("id", F.lower(F.trim("a.form")).alias("key"))
    return V.lookup(e.where(F.col("key") != ""), "key", "id")


def q_domain_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The registry entry of each crawled host by the longest ending of it."""
    hosts = table(spark, folder, "documents").select(urls.host(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
    entries = table(spark, folder, "entities").select("id", F.explode("domains").alias("d")).select("id", F.lower(F.trim("d")).alias("domain")).where(F.col("domain") != "")
    mixed = hosts.unionByName(entries.select(F.concat(F.lit("shop.www2."), "domain").alias("host")))
    return V.by_domain(mixed.distinct(), entries)


def q_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Every concept with each concept above it."""
    c = table(spark, folder, "concepts")
    links = c.select(F.col("vertical_id").alias("scope"), F.col("id").alias("node"), F.nullif(F.trim("broader"), F.lit("")).alias("parent"))
    return hierarchy.closure(hierarchy.contract(links, paths=True))


def q_top2_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector's two nearest references, the reference of a label being its vector with the smallest id."""
    e = table(spark, folder, "embeddings")
    refs = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).withColumnRenamed("label", "ref")
    return V.top_two(e, refs).select("vec_id", "best", F.round("score", 3).alias("score"), "kept")


def q_term_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each observed key within a vertical and in all others."""
    o = table(spark, folder, "observations").dropDuplicates(["observation_id"])
    rows = o.where(F.col("vertical_id").isNotNull()).select("vertical_id", F.explode("forms").alias("f")).select("vertical_id", F.lower(F.trim("f.key")).alias("key"), F.coalesce("f.pages", F.lit(0)).alias("pages"))
    return V.contrast(rows.where(F.col("key") != ""), "key", "vertical_id", "pages")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (q_vocab_match, q_longest_names, q_classify, q_seed_cover, q_gap, q_overlap, q_triples, q_label_lookup, q_domain_lookup, q_ancestors, q_top2_similarity, q_term_contrast)}


_FORMS = """labels as (
  select vertical_id, id as concept_id, kind, preflabel as label, true as canonical from concepts
  union all select vertical_id, id, kind, unnest(altlabels), false from concepts
),
forms as (
  select vertical_id, concept_id, kind, array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') as form, bool_or(canonical) as canonical
  from labels group by 1, 2, 3, 4 having array_to_string(regexp_extract_all(lower(any_value(label)), '[a-z0-9]+'), ' ') <> ''
)"""


def _runs(rows: str, keys: str, text: str) -> str:
    """SQL for all word runs of a text joined with the forms."""
    return f"""worded as (select {keys}, regexp_extract_all(lower({text}), '[a-z0-9]+') as w from {rows} where {text} is not null),
starts as (select {keys}, w, unnest(range(1, len(w) + 1)) as pos from worded),
runs as (select {keys}, pos, n, array_to_string(w[pos:pos + n - 1], ' ') as form, len(w) as size from starts, (select unnest(range(1, 12)) as n) where pos + n - 1 <= len(w)),
found as (select r.* exclude (size), f.vertical_id, f.concept_id, f.kind from runs r join forms f using (form))"""


_DOCS = f"{_FORMS}, {_runs('documents', 'doc_id, source', 'text')}"
_SENTENCES = f"""{_FORMS},
split_ as (select doc_id, string_split(regexp_replace(text, '([.!?\\n])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null),
told as (select doc_id, generate_subscripts(p, 1) - 1 as pos0, trim(regexp_replace(unnest(p), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as sentence from split_),
kept_ as (select doc_id, pos0, sentence from told where length(sentence) > 12),
{_runs('kept_', 'doc_id, pos0', 'sentence')},
once as (select distinct doc_id, pos0, form from found),
alone as (
  select a.* from once a where not exists (
    select 1 from once b where b.doc_id = a.doc_id and b.pos0 = a.pos0 and length(b.form) > length(a.form) and contains(' ' || b.form || ' ', ' ' || a.form || ' '))
)"""


def _rules_sql() -> str:
    parts = []
    for i, r in enumerate(extraction.RULES):
        cue = " or ".join(f"contains(lower(sentence), '{c}')" for c in r.cues)
        kinds = ", ".join(f"'{k}'" for k in r.kinds)
        need = f"and ({cue})" if r.required else ""
        parts.append(f"select doc_id, pos0, concept_id, form, sentence, {i} as rule, '{r.predicate}' as predicate, case when {cue} then {r.cued} else {r.uncued} end as confidence from matched where kind in ({kinds}) {need}")
    return " union all ".join(parts)


def facts_sql() -> str:
    """CTEs that end with facts (doc_id, predicate, object, confidence, evidence)."""
    return f"""{_SENTENCES},
            matched as (select a.doc_id, a.pos0, f.concept_id, f.kind, a.form, k.sentence from alone a join (select distinct form, concept_id, kind from forms) f using (form) join kept_ k on k.doc_id = a.doc_id and k.pos0 = a.pos0),
            made as ({_rules_sql()}),
            facts as (select doc_id, predicate, concept_id as object, arg_min(confidence, (rule, pos0, form)) as confidence, substr(arg_min(sentence, (rule, pos0, form)), 1, 160) as evidence from made where length(form) >= 3 group by 1, 2, 3)"""


def oracle_sql() -> dict[str, str]:
    return {
        "q_vocab_match": f"with {_DOCS} select doc_id, vertical_id, concept_id, form, count(*) as n from found group by 1, 2, 3, 4",
        "q_classify": f"""with {_DOCS}, shared as (select form from found group by 1 having count(distinct vertical_id) > 1),
            counts as (select doc_id, vertical_id, count(distinct form) as terms from found where form not in (select form from shared) group by 1, 2),
            ranked as (select *, row_number() over (partition by doc_id order by terms desc, vertical_id) as place, coalesce(lead(terms) over (partition by doc_id order by terms desc, vertical_id), 0) as runner_up from counts)
            select doc_id, case when terms >= 3 and terms >= 1.5 * runner_up then vertical_id end as vertical_id, terms as best, runner_up, terms >= 10 and terms >= 1.5 * runner_up as confident from ranked where place = 1""",
        "q_seed_cover": f"""with {_DOCS}, totals as (select vertical_id, count(*) as total from concepts group by 1), c as (select source, vertical_id, count(distinct concept_id) as covered from found group by 1, 2)
            select source, vertical_id, covered, total, round(least(100.0, covered * 100 / total), 1) as score from c join totals using (vertical_id)""",
        "q_gap": f"""with {_DOCS}, has as (select distinct source, vertical_id, concept_id from found where source is not null),
            spread as (select vertical_id, concept_id, count(*) as others from has group by 1, 2)
            select s.source, s.vertical_id, p.concept_id, p.others, case when p.others >= 2 then 'High' else 'Medium' end as priority
            from (select distinct source, vertical_id from has) s join spread p using (vertical_id)
            where not exists (select 1 from has h where h.source = s.source and h.vertical_id = s.vertical_id and h.concept_id = p.concept_id)""",
        "q_overlap": f"with {_SENTENCES} select doc_id, pos0::int as sent, form from alone",
        "q_triples": f"with {facts_sql()} select doc_id, predicate, object, confidence, evidence from facts",
        "q_label_lookup": "with k as (select id, lower(trim(a.form)) as key from (select id, unnest(aliases) as a from entities)) select key, count(distinct id) as n, case when count(distinct id) = 1 then min(id) end as id from k where key <> '' group by 1",
        "q_domain_lookup": """
            with entries as (select distinct id, lower(trim(d)) as domain from (select id, unnest(domains) as d from entities) where trim(d) <> ''),
            hosts as (select distinct lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) as host from documents where url is not null union select distinct 'shop.www2.' || domain from entries),
            found as (select h.host, e.id, e.domain from hosts h join entries e on regexp_replace(h.host, '^www\\.', '') = e.domain or ends_with(regexp_replace(h.host, '^www\\.', ''), '.' || e.domain))
            select host, arg_min(domain, (-length(domain), id)) as domain, arg_min(id, (-length(domain), id)) as id from found group by host""",
        "q_ancestors": """
            with recursive up as (
              select vertical_id as scope, id as node, broader as ancestor, 1::bigint as distance from concepts where trim(broader) <> ''
              union all select u.scope, u.node, c.broader, u.distance + 1 from up u join concepts c on c.id = u.ancestor and c.vertical_id = u.scope where trim(c.broader) <> ''
            ) select scope, ancestor, node, distance from up""",
        "q_top2_similarity": """
            with refs as (select label as ref, arg_min(embedding, vec_id)::double[] as v from embeddings group by 1),
            s as (select e.vec_id, r.ref, round(list_dot_product(e.embedding::double[], r.v) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(r.v, r.v))), 6) as score from embeddings e, refs r),
            k as (select *, row_number() over (partition by vec_id order by score desc, ref) as place, lead(score) over (partition by vec_id order by score desc, ref) as next_ from s)
            select vec_id, ref as best, round(score, 3) as score, score >= 0.6 and round(score - next_, 6) >= 0.05 as kept from k where place = 1""",
        "q_term_contrast": """
            with once as (select distinct on (observation_id) * from observations), k as (select vertical_id, lower(trim(f.key)) as key, coalesce(f.pages, 0) as pages from (select vertical_id, unnest(forms) as f from once where vertical_id is not null)),
            own as (select vertical_id, key, sum(pages)::bigint as here from k where key <> '' group by 1, 2)
            select vertical_id, key, here, (sum(here) over (partition by key) - here)::bigint as elsewhere from own""",
    }

"""Labels against observed terms, evidence, prompts and new concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import alignment as A
from ..operators import registry as R
from ..operators import vocabulary as V
from .streams import q_prompts
from .tables import Query, table


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "observations").select(F.lower(F.trim("domain")).alias("domain"), F.explode("forms").alias("f"))
    return o.where(F.col("domain") != "").select("domain", F.col("f.key").alias("term"))


def q_label_match(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "concepts")
    labels = c.select(F.col("id").alias("concept_id"), F.col("preflabel").alias("label"), F.lit(True).alias("canonical")).unionByName(c.select(F.col("id").alias("concept_id"), F.explode("altlabels").alias("label"), F.lit(False).alias("canonical")))
    return A.matched_labels(labels, _terms(spark, folder), "domain")


def q_evidence_group(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(F.col("url").isNotNull())
    return d.select("doc_id", A.evidence_group(U.segments(F.col("url"))).alias("grp")).where(F.col("grp").isNotNull())


def q_evidence_pages(spark: SparkSession, folder: str) -> DataFrame:
    """What each page is cited for by the claims of runs."""
    q = table(spark, folder, "quads").where(F.col("p").isin("prov:wasDerivedFrom", "rdf:object"))
    s = q.groupBy("graph_id", "s").agg(F.min(F.when(F.col("p") == "rdf:object", F.col("o"))).alias("value"), F.min(F.when(F.col("p") == "prov:wasDerivedFrom", F.col("o"))).alias("url"))
    rows = s.where(F.col("value").isNotNull()).select(F.col("graph_id").alias("subject"), F.lit("claim").alias("field"), "value", "url", F.lit(None).cast("string").alias("quote"))
    return A.evidence_by_page(rows).select("url", F.size("claims").alias("claims"))


def q_prompt_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return A.prompt_coverage(q_prompts(spark, folder), table(spark, folder, "concepts"))


def q_prompt_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of a vertical against its first concept as the vendor and its own subject as support."""
    p = q_prompts(spark, folder).select(F.col("vertical_id").alias("subject"), F.col("prompt").alias("text"), F.col("subject").alias("support"))
    v = table(spark, folder, "concepts").groupBy(F.col("vertical_id").alias("subject")).agg(F.min("preflabel").alias("vendor"))
    return A.checked_prompts(p, v).groupBy("subject", "verdict").agg(F.count(F.lit(1)).alias("n"))


def q_facets(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of stored situations as facets, each its own quote."""
    q = table(spark, folder, "quads").where(F.col("graph_id").contains("/situations/") & F.col("p").isin(*[f"https://onto.example/terms/{p}" for p in ("trigger", "pain", "need", "before")]))
    rows = q.select(F.col("s").alias("story"), F.regexp_extract("p", "([a-z]+)$", 1).alias("part"), F.col("o").alias("text"), F.col("o").alias("quote")).distinct()
    return A.facets(rows).select("story", "part", "node", F.array_join("kinds", ",").alias("kinds"))


def q_added_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """The approved decisions as concepts to add to the list."""
    c = V.vocabulary(table(spark, folder, "concepts")).select("vertical_id", "concept_id", "form")
    a = R.approved_concepts(R.decisions(table(spark, folder, "vocabulary_decisions"))).select("vertical_id", "label")
    return A.added_concepts(c, a)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (q_label_match, q_evidence_group, q_evidence_pages, q_prompt_coverage, q_prompt_checks, q_facets, q_added_concepts)}


def oracle_sql() -> dict[str, str]:
    from .registries import oracle_sql as registry_sql
    from .streams import APART, PHRASE, TEMPLATES

    approved = registry_sql()["q_approved_concepts"]

    plain = "trim(regexp_replace(regexp_replace(lower({0}), '[-–]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    groups = " ".join(f"when list_has_any(parts, [{', '.join(repr(h) for h in hints)}]) then '{g}'" for g, hints in A.EVIDENCE_GROUPS.items())
    prompts = " union all ".join(f"select '{r}' as role, {s} as stage, '{t}' as template" for r, s, t, _ in TEMPLATES)
    asked = " union all ".join(f"select '{r}' as role, {s} as stage, {o} as ord, '{t}' as template" for r, s, t, o in TEMPLATES)
    slug = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'x')"
    words = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
    pad = lambda c: f"' ' || array_to_string({words.format(c)}, ' ') || ' '"
    return {
        "q_prompt_checks": f"""with t as ({asked}), m as (select c.vertical_id as g, t.stage, t.ord, c.preflabel as support, replace(t.template, '{{subject}}', {PHRASE}) as text from concepts c join t on t.role = c.kind where {APART}),
            r as (select *, row_number() over (partition by g, lower(text) order by stage, ord, support, text) as rn from m), v as (select vertical_id as g, min(preflabel) as vendor from concepts group by 1),
            x as (select r.g as subject, case when len({words.format('text')}) < 6 then 'too_short' when coalesce(trim(vendor, ' ') <> '' and contains({pad('text')}, {pad('vendor')}), false) then 'names_vendor'
              when len(list_filter({words.format('text')}, lambda w: regexp_matches(w, '[0-9]') and not list_contains({words.format('support')}, w))) > 0 then 'unsupported' else 'kept' end as verdict from r left join v on v.g = r.g where rn = 1)
            select subject, verdict, count(*) as n from x group by 1, 2""",
        "q_added_concepts": f"""with approved as ({approved}),
            existing as (select vertical_id, id as concept_id, array_to_string(regexp_extract_all(lower(l), '[a-z0-9]+'), ' ') as k from (select vertical_id, id, preflabel as l from concepts union all select vertical_id, id, unnest(altlabels) from concepts)),
            owner as (select vertical_id, k, min(concept_id) as form_owner from existing where k <> '' group by 1, 2),
            p as (select a.vertical_id, a.label, {plain.format('a.label')} as k, {slug.format('a.label')} as base from approved a),
            o as (select p.*, owner.form_owner from p left join owner on owner.vertical_id = p.vertical_id and owner.k = p.k),
            n as (select o.*, row_number() over (partition by o.vertical_id, base order by label) + (case when exists (select 1 from concepts c where c.vertical_id = o.vertical_id and c.id = o.base) then 1 else 0 end) as i from o where form_owner is null)
            select vertical_id, label, case when i = 1 then base else base || '-' || i end as id, form_owner from n union all select vertical_id, label, null, form_owner from o where form_owner is not null""",
        "q_label_match": f"""with labels as (select id as concept_id, preflabel as label, true as canonical from concepts union all select id, unnest(altlabels), false from concepts),
            known as (select distinct concept_id, {plain.format('label')} as l, canonical from labels where length({plain.format('label')}) >= 3),
            said as (select distinct lower(trim(domain)) as domain, {plain.format('f.key')} as t from (select domain, unnest(forms) as f from observations) where trim(domain) <> '' and {plain.format('f.key')} <> ''),
            hits as (select domain, concept_id, case when canonical and t = l then 3 when canonical then 2 else 1 end as how from said join known on contains(' ' || t || ' ', ' ' || l || ' ')
              union all select domain, concept_id, 0 from said join known on canonical and t <> l and length(t) >= 6 and contains(' ' || l || ' ', ' ' || t || ' '))
            select domain, concept_id, max(how) as how from hits group by 1, 2""",
        "q_evidence_group": f"""with p as (select doc_id, list_filter(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') as parts from documents where url is not null)
            select * from (select doc_id, case {groups} end as grp from p) where grp is not null""",
        "q_evidence_pages": """with s as (select graph_id, s, min(o) filter (p = 'rdf:object') as value, min(o) filter (p = 'prov:wasDerivedFrom') as url from quads where p in ('prov:wasDerivedFrom', 'rdf:object') group by 1, 2)
            select url, count(distinct (graph_id, value)) as claims from s where value is not null and trim(url) <> '' group by 1""",
        "q_prompt_coverage": f"""with t as ({prompts}), m as (select distinct c.vertical_id, lower(replace(t.template, '{{subject}}', {PHRASE})) as prompt, min(t.stage) over (partition by c.vertical_id, lower(replace(t.template, '{{subject}}', {PHRASE}))) as stage from concepts c join t on t.role = c.kind where {APART}),
            p as (select vertical_id, count(distinct prompt) as prompts, count(distinct stage) as stages from m group by 1)
            select c.vertical_id, count(*) as concepts, count(*) filter (coalesce(trim(definition) <> '', false)) as defined, sum(len(altlabels))::bigint as aliases, any_value(p.prompts) as prompts, any_value(p.stages) as stages from concepts c join p using (vertical_id) group by 1""",
    }

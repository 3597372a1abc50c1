"""Relations that sentences state, over statements made of the registry's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as R
from .tables import Query, table

#: What is said of an entry, %s being its name; every entry gets every third sentence from the length of its id on.
SAID = (
    "%s automates revenue recognition and dunning runs for finance teams. ",
    "It integrates with Salesforce, %s and Slack. ",
    "%s complies with SOC 2 Type II and GDPR; ISO 27001 audits are yearly. ",
    "Usage-based pricing and tiered plans are billed monthly by %s. ",
    "%s offers Automated Invoicing, an Audit Trail and Data Export. ",
    "Eliminate manual journal entries and spreadsheets with %s! ",
    "Built for Mid-Market and Enterprise buyers in Insurance and HealthTech, %s grows. ",
    "The Cloud-Native platform of %s is hosted on Kubernetes in a Private Cloud. ",
    "Developers get a REST API, Webhooks and an SDK from %s. ",
    "%s is available in Germany, Japan and the United Kingdom. ",
    "We guarantee 99.95% uptime and 24/7 Support at %s. ",
    "Unlike Zuora or Chargebee, %s needs no consultants. ",
    "Jane Roe, director of billing at %s, tells more. ",
    "Read the %s case study today. ",
    "The app streamlines invoice approvals for %s. ",
    "%s syncs with Sage Intacct; QuickBooks is a partner of %s. ",
)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    # the search of the texts costs far more than their bytes tell, so they are not put together into few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = table(spark, folder, "entities").where(F.trim("preflabel") != "").select("id", "preflabel").repartition(tasks, "id").groupBy("id").agg(F.min("preflabel").alias("name"))
    parts = [F.when((F.length("id") + i) % 3 == 0, F.replace(F.lit(s), F.lit("%s"), F.col("name"))).otherwise("") for i, s in enumerate(SAID)]
    return named.select("id", "name", F.concat(*parts).alias("text"))


def q_relations(spark: SparkSession, folder: str) -> DataFrame:
    return R.relations(_docs(spark, folder), "id", vendor="name")


def queries() -> dict[str, Query]:
    return {"q_relations": q_relations}


def _any(words: tuple[str, ...], yes: str = "true") -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")" if words else yes


def oracle_sql() -> dict[str, str]:
    text = " || ".join(f"case when (length(id) + {i}) % 3 = 0 then replace('{s}', '%s', name) else '' end" for i, s in enumerate(SAID))
    made = []
    for i, r in enumerate(R.RULES):
        if not r.terms:
            continue
        terms = ", ".join(f"({k}, '{t}')" for k, t in enumerate(r.terms))
        stands = "contains(low, lower(t))"
        if r.whole:
            stands = "regexp_matches(low, '\\b' || regexp_replace(lower(t), '([^a-z0-9 ])', '\\\\\\1', 'g') || '\\b')"
        if r.field == "pricing":
            stands += f" or ({_any(R.PRICING_CUES)} and contains(low, replace(replace(lower(t), ' pricing', ''), ' billing', '')))"
        if r.instead:
            stands += f" or {_any(r.instead)}"
        gate = "true" if r.uncued is not None else _any(r.cues)
        confidence = f"case when {_any(r.cues)} then {r.confidence} else {r.uncued} end" if r.uncued is not None else str(r.confidence)
        made.append(f"select id, sent, sentence, {r.step} as step, {i} as rule, k as place, '{r.predicate}' as predicate, t as object, {confidence} as confidence from told, (values {terms}) v(k, t) where {gate} and {_any(r.beside)} and not {_any(r.unless, 'false')} and ({stands})")
    bare = "regexp_replace(o, '^[ ,.]+|[ ,.]+$', '', 'g')"
    title = "array_to_string(list_transform(string_split({0}, '-'), lambda a: array_to_string(list_transform(string_split(a, ' '), lambda b: upper(b[1]) || b[2:]), ' ')), '-')"
    opened = [
        (13, 98, "guarantees", 0.90, f"list_transform(regexp_extract_all(low, '{R.UPTIME}', 1)[1:1], lambda o: {title.format('o')})", "true"),
        (16, 100, "hasCustomer", 0.86, f"list_transform(regexp_extract_all(sentence, '{R.AT_COMPANY}', 1), lambda o: {bare})", "o <> '' and lower(o) <> lower(trim(name))"),
        (16, 101, "hasCustomer", 0.82, f"list_transform(regexp_extract_all(sentence, '{R.CASE_STUDY}', 1), lambda o: {bare})", "o <> '' and lower(o) <> lower(trim(name))"),
        (17, 102, "automates", 0.80, f"list_transform(list_filter(list_transform(regexp_extract_all(sentence, '{R.AUTOMATES}', 1), lambda o: list_filter(regexp_split_to_array(trim(lower(o)), ' +'), lambda w: w not in ('the', 'all', 'your', 'our', 'their', 'and', 'or', 'a', 'an'))), lambda w: len(w) between 1 and 4), lambda w: {title.format('''array_to_string(w, ' ')''')})", "length(o) >= 4 and lower(o) <> lower(trim(name)) and not regexp_matches(lower(o), 'http|www|cookie')"),
        (18, 103, "integratesWith", 0.82, f"list_transform(flatten(list_transform(regexp_extract_all(sentence, '{R.CONNECTS}', 1), lambda s: regexp_split_to_array(s, ', *| +and +'))), lambda o: {bare})", "length(o) >= 2 and lower(o) <> lower(trim(name)) and lower(o) not in ('the', 'all', 'your', 'our', 'seamlessly', 'easily')"),
    ]
    for step, rule, predicate, confidence, objects, where in opened:
        made.append(f"select id, sent, sentence, {step}, {rule}, place, '{predicate}', o, {confidence} from (select id, name, sent, sentence, unnest(os) as o, generate_subscripts(os, 1) as place from (select *, {objects} as os from told)) where {where}")
    return {
        "q_relations": f"""
            with named as (select id, min(preflabel) as name from entities where trim(preflabel) <> '' group by id),
            docs as (select id, name, {text} as text from named),
            parts as (select id, name, string_split(regexp_replace(text, '([.!?\\n])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) as p from docs),
            split_ as (select id, name, generate_subscripts(p, 1) - 1 as sent, trim(regexp_replace(unnest(p), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as sentence from parts),
            told as (select *, lower(sentence) as low from split_ where length(sentence) > 12),
            made as ({' union all '.join(made)}),
            clean as (select id, sent, step, rule, place, predicate, regexp_replace(object, '^[ ,.:\\-\\n\\t"'']+|[ ,.:\\-\\n\\t"'']+$', '', 'g') as object, confidence, substr(sentence, 1, 160) as evidence from made),
            facts as (select id, predicate, lower(object) as low, arg_min(object, (step, sent, rule, place)) as object, arg_min(confidence, (step, sent, rule, place)) as confidence, arg_min(evidence, (step, sent, rule, place)) as evidence from clean where length(object) >= 3 group by 1, 2, 3)
            select id, predicate, object, confidence, evidence from facts f where not exists (
              select 1 from facts g where g.id = f.id and g.evidence = f.evidence and length(g.low) > length(f.low) and regexp_matches(g.low, '\\b' || regexp_replace(f.low, '([^a-z0-9 ])', '\\\\\\1', 'g') || '\\b'))""",
    }

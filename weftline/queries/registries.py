"""Folds of event logs, and resolution against the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quads as store
from ..operators import registry as R
from ..operators import vocabulary as V
from .tables import Query, table


def q_vocab_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return R.decisions(table(spark, folder, "vocabulary_decisions")).select("vertical_id", "key", "event_id", "decision", "label")


def q_generic_keys(spark: SparkSession, folder: str) -> DataFrame:
    return R.generic_keys(R.decisions(table(spark, folder, "vocabulary_decisions")))


def q_approved_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return R.approved_concepts(R.decisions(table(spark, folder, "vocabulary_decisions")))


def q_synonym_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The requests as proposals, the reviewers' candidates as decisions: a high score approves, a low one rejects."""
    c = table(spark, folder, "candidates").where(F.col("score").isNotNull() & ~F.isnan("score"))
    low = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit(""))
    key = F.concat(F.when(low("vertical_id") != "", F.concat(low("vertical_id"), F.lit("|"))).otherwise(""), low("concept"), F.lit("|"), low("surface_form"))
    decided = c.select(F.lpad(F.col("candidate_id").cast("string"), 12, "0").alias("event_id"), F.when(F.col("score") >= 0.6, "approved").otherwise("rejected").alias("decision"), F.col("surface_form").alias("surface"), "vertical_id", key.alias("key"), F.coalesce("closes_gap", F.lit(False)).alias("withdraws"))
    return R.synonym_queue(table(spark, folder, "synonym_requests"), decided.distinct())


def q_registry_fold(spark: SparkSession, folder: str) -> DataFrame:
    s = R.registry_state(table(spark, folder, "entities"))
    return s.select("id", "kind", "preflabel", "status", "merged_into", F.array_join("aliases", "|").alias("aliases"), F.array_join("domains", "|").alias("domains"), "undone")


def q_latest_run(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "graphs").where((F.col("kind") == "run") & F.col("domain").isNotNull()).select("domain", "graph_id", "created_at")
    return store.latest(g, ["domain"], [F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz"))])


def q_form_keys(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "entities").where(F.col("preflabel").isNotNull())
    k = R.key(F.col("preflabel"))
    return e.select("preflabel", k.alias("key"), R.fold_key(k).alias("fold"), R.is_generic(k).alias("generic")).distinct()


def q_site_forms(spark: SparkSession, folder: str) -> DataFrame:
    return R.forms_by_key(table(spark, folder, "observations"))


def q_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Each observed key of a site with what it was resolved to, and how."""
    e = table(spark, folder, "entities").where(F.coalesce(F.trim("merged_into"), F.lit("")) == "")
    forms = e.select("id", R.key(F.col("preflabel")).alias("form")).unionByName(e.select("id", F.explode("aliases").alias("a")).select("id", R.key(F.col("a.form")).alias("form")))
    concepts = V.vocabulary(table(spark, folder, "concepts")).select("form", "concept_id")
    blocked = R.generic_keys(R.decisions(table(spark, folder, "vocabulary_decisions")))
    return R.resolve_keys(R.forms_by_key(table(spark, folder, "observations")), forms, concepts, blocked)


def q_resolution_summary(spark: SparkSession, folder: str) -> DataFrame:
    return q_resolution(spark, folder).groupBy("domain", "method").agg(F.count(F.lit(1)).alias("n"))


def q_vocab_proposals(spark: SparkSession, folder: str) -> DataFrame:
    return R.proposals(table(spark, folder, "observations"), R.decisions(table(spark, folder, "vocabulary_decisions")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (q_vocab_decisions, q_generic_keys, q_approved_concepts, q_synonym_fold, q_registry_fold, q_latest_run, q_form_keys, q_site_forms, q_resolution, q_resolution_summary, q_vocab_proposals)}


_STANDS = "stands as (select * from (select *, row_number() over (partition by vertical_id, key order by event_id desc nulls last) as rn from vocabulary_decisions) where rn = 1)"
_KEYED = "(case when coalesce(lower(trim(vertical_id, ' ')), '') <> '' then lower(trim(vertical_id, ' ')) || '|' else '' end)"


_ENDED = "case when length({0}) <= 4 then {0} when {0} like '%ies' then regexp_replace({0}, 'ies$', 'y') when regexp_matches({0}, '(sses|shes|ches|xes)$') then regexp_replace({0}, 'es$', '') when {0} like '%s' and not regexp_matches({0}, '(ss|us|is)$') then regexp_replace({0}, 's$', '') else {0} end"


def keyed_sql(rows: str, form: str, into: str) -> str:
    """CTEs from ``rows`` to ``into``, the rows with k, the key of their form."""
    generic = ", ".join(f"'{w}'" for w in R.GENERIC)
    return f"""{into}_a as (select *, regexp_replace(replace(replace(trim({form}, ' '), '’', chr(39)), '&', ' and '), '([A-Za-z0-9])\\.(com|io|ai|co|net|org|app)\\b', '\\1', 'gi') as f from {rows}),
            {into}_b as (select * replace (regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(f, chr(39) || 's\\b', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' '), '^(the|a|an) (.)', '\\2', 'i'), '(.)(( (inc|incorporated|llc|ltd|limited|plc|corp|corporation|gmbh))+)$', '\\1', 'i') as f) from {into}_a),
            {into}_c as (select *, regexp_extract(f, '([A-Za-z0-9]+)$', 1) as z from {into}_b),
            {into}_d as (select *, lower(z) as l, {_ENDED.format('lower(z)')} as one from {into}_c),
            {into} as (select * exclude (f, z, l, one), regexp_replace(lower(f), '[a-z0-9]+$', '') || case when regexp_full_match(z, '[A-Z]{{2,}}s') then regexp_replace(l, 's$', '') when z = l or one in ({generic}) or l in ({generic}) then one else l end as k from {into}_d)"""


def resolved_sql() -> str:
    """CTEs that end with resolved (domain, key, target_kind, target, method)."""
    generic = ", ".join(f"'{w}'" for w in R.GENERIC)
    affixes = ", ".join(f"'{w}'" for w in ("", *R.AFFIXES))
    fold = lambda k: f"replace(regexp_replace({k}, '[a-z0-9]+$', '') || {_ENDED.format('regexp_extract(' + k + ', ' + chr(39) + '([a-z0-9]+)$' + chr(39) + ', 1)')}, ' ', '')"
    label = "split_part(regexp_replace(domain, '^www\\.', ''), '.', 1)"
    pick = lambda kind, target, method: f"{{'kind': '{kind}', 'target': {target}, 'method': '{method}'}}"
    return f"""{_STANDS}, blocks as (select distinct key from stands where decision = 'generic'),
            site_forms as ({oracle_sql()['q_site_forms']}),
            named as (select id, preflabel as form from entities where coalesce(trim(merged_into, ' '), '') = '' union all select id, a.form from (select id, unnest(aliases) as a from entities where coalesce(trim(merged_into, ' '), '') = '')),
            {keyed_sql('named', 'form', 'keyed')},
            entry as (select k, count(distinct id) as n, min(id) as id from keyed where k <> '' group by k),
            words as (select id as concept_id, array_to_string(regexp_extract_all(lower(l), '[a-z0-9]+'), ' ') as k from (select id, preflabel as l from concepts union all select id, unnest(altlabels) from concepts)),
            concept as (select k, min(concept_id) as cid from words where k <> '' group by k having count(distinct concept_id) = 1),
            rests as (select domain, key, display, regexp_replace(key, ' ({'|'.join(R.PRODUCT_WORDS)})$', '') as r from site_forms),
            base as (select domain, key, display, case when r <> key and length(replace(r, ' ', '')) >= 3 then r end as rest from rests),
            hit as (select b.*, e.n, e.id, c.cid, er.id as rid, cr.cid as rcid, replace(b.key, ' ', '') as joined, {label} as label from base b left join entry e on e.k = b.key left join concept c on c.k = b.key
              left join entry er on er.k = b.rest and er.n = 1 left join concept cr on cr.k = b.rest),
            chosen as (select domain, key, display, {fold('key')} as fold, case when key in (from blocks) then {pick('mention', 'key', 'blocked')} when n = 1 then {pick('entity', 'id', 'registry')} when n > 1 then {pick('observed', 'key', 'ambiguous')} when cid is not null then {pick('concept', 'cid', 'concept')}
              when length(joined) >= 4 and len(list_filter([{affixes}], lambda a: joined || a = label or a || joined = label)) > 0 then {pick('brand', 'domain', 'brand')}
              when rid is not null then {pick('entity', 'rid', 'suffix')} when rcid is not null then {pick('concept', 'rcid', 'suffix')}
              when len(list_filter(string_split(key, ' '), lambda w: not (w in ({generic}) or {_ENDED.format('w')} in ({generic})))) = 0 or not regexp_matches(coalesce(display, key), '[A-Z]') then {pick('mention', 'key', 'mention')}
              else {pick('observed', 'key', 'observed')} end as c from hit),
            ranked as (select *, case when c.kind in ('entity', 'concept', 'brand') then 0 when c.kind = 'observed' then 1 else 2 end as o from chosen),
            best as (select domain, fold, arg_min(key, (o, key)) as bkey, arg_min(c, (o, key)) as bc from ranked group by 1, 2),
            moved as (select r.domain, r.key, r.display, r.c, b.bc, r.c.kind in ('observed', 'mention') and b.bkey <> r.key and r.c.method not in ('ambiguous', 'blocked') as moves from ranked r join best b using (domain, fold)),
            spelled as (select domain, key, display, case when moves then {{'kind': bc.kind, 'target': bc.target, 'method': 'spelling'}} else c end as c from moved),
            long as (select domain, array_to_string(list_transform(string_split(key, ' '), lambda w: w[1]), '') as key, {{'kind': c.kind, 'target': c.target}} as t from spelled where regexp_full_match(key, '[a-z]{{2,}}( [a-z]{{2,}})+') and c.method <> 'blocked'),
            short as (select domain, key, min(t) as t from long group by 1, 2 having min(t) = max(t)),
            ruled as (select s.*, h.t, h.t is not null and s.c.kind in ('observed', 'mention') and s.c.method not in ('ambiguous', 'blocked') and regexp_full_match(replace(coalesce(s.display, ''), '.', ''), '[A-Z]{{2,5}}') as goes from spelled s left join short h using (domain, key)),
            resolved as (select domain, key, case when goes then t.kind else c.kind end as target_kind, case when goes then t.target else c.target end as target, case when goes then 'acronym' else c.method end as method from ruled)"""


def more_sql() -> dict[str, str]:
    """SQL that is made of the SQL of other queries."""
    generic = ", ".join(f"'{w}'" for w in R.GENERIC)
    last = "regexp_extract(k, '([a-z0-9]+)$', 1)"
    return {
        "q_form_keys": f"""with n as (select distinct preflabel from entities where preflabel is not null), {keyed_sql('n', 'preflabel', 'keyed')}
            select preflabel, k as key, replace(regexp_replace(k, '[a-z0-9]+$', '') || {_ENDED.format(last)}, ' ', '') as fold, len(list_filter(string_split(k, ' '), lambda w: not (w in ({generic}) or {_ENDED.format('w')} in ({generic})))) = 0 as generic from keyed""",
        "q_resolution": f"with {resolved_sql()} select * from resolved",
        "q_resolution_summary": f"with {resolved_sql()} select domain, method, count(*) as n from resolved group by 1, 2",
    }


def oracle_sql() -> dict[str, str]:
    return {
        "q_vocab_decisions": f"with {_STANDS} select vertical_id, key, event_id, decision, label from stands",
        "q_generic_keys": f"with {_STANDS} select distinct key from stands where decision = 'generic'",
        "q_approved_concepts": f"""with {_STANDS},
            made as (select vertical_id, key, coalesce(nullif(trim(label), ''), nullif(trim(key), '')) as label, lower(nullif(trim(broader), '')) as broader from stands where decision = 'approve'),
            slugged as (select *, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'x') as base from made),
            numbered as (select *, row_number() over (partition by vertical_id, base order by key, label, broader) as i from slugged),
            named as (select vertical_id, case when i = 1 then base else base || '-' || i end as id, label, broader from numbered),
            parents as (select vertical_id, lower(label) as l, min(id) as pid from named group by 1, 2)
            select n.vertical_id, n.id, n.label, p.pid as broader_id from named n left join parents p on p.vertical_id = n.vertical_id and p.l = n.broader""",
        "q_synonym_fold": f"""
            with proposed as (select request_id, coalesce(lower(trim(surface_form, ' ')), '') as surface, coalesce(lower(trim(canonical_concept, ' ')), '') as canonical, coalesce(lower(trim(vertical_id, ' ')), '') as vertical_id from synonym_requests),
            keyed as (select *, {_KEYED} || canonical || '|' || surface as key from proposed where surface <> '' and canonical <> ''),
            queue as (select key, arg_min(vertical_id, request_id) as vertical_id, arg_min(surface, request_id) as surface, arg_min(canonical, request_id) as canonical from keyed group by 1),
            decided as (select distinct lpad(candidate_id::varchar, 12, '0') as event_id, case when score >= 0.6 then 'approved' else 'rejected' end as decision, coalesce(lower(trim(surface_form, ' ')), '') as surface,
              coalesce(lower(trim(vertical_id, ' ')), '') as vertical_id, {_KEYED} || coalesce(lower(trim(concept, ' ')), '') || '|' || coalesce(lower(trim(surface_form, ' ')), '') as key, coalesce(closes_gap, false) as withdraws
              from candidates where score is not null and not isnan(score)),
            settling as (select * from decided where surface <> '' and (decision = 'approved' or withdraws)),
            per as (select vertical_id, surface, max({{'e': event_id, 'd': decision}}) as s from settling where vertical_id <> '' group by 1, 2
              union all select '', surface, max({{'e': event_id, 'd': decision}}) from settling group by surface),
            rejected as (select key, max({{'e': event_id, 'd': decision}}) as r from decided where decision = 'rejected' group by 1),
            both_ as (select q.*, case when s.s is null then r.r when r.r is null then s.s when s.s >= r.r then s.s else r.r end as w from queue q
              left join (select * from per where s.d = 'approved') s on s.vertical_id = q.vertical_id and s.surface = q.surface left join rejected r on r.key = q.key)
            select key, vertical_id, surface, canonical, coalesce(w.d, 'pending') as status, w.e as decided_by from both_""",
        "q_registry_fold": """
            with ordered as (select *, coalesce(recorded_at, '0001-01-01'::timestamp) as at_ from entities where id is not null),
            state as (select id, max({'t': at_, 'v': trim(kind)}) filter (trim(kind) <> '') as kind, max({'t': at_, 'v': trim(preflabel)}) filter (trim(preflabel) <> '') as preflabel,
              max({'t': at_, 'v': trim(status)}) filter (trim(status) <> '') as status, max({'t': at_, 'v': trim(merged_into)}) filter (trim(merged_into) <> '') as merged_into from ordered group by 1),
            al as (select id, string_agg(distinct v, '|' order by v) as aliases from (select id, lower(trim(a.form)) as v from (select id, unnest(aliases) as a from ordered)) where v <> '' group by 1),
            dm as (select id, string_agg(distinct v, '|' order by v) as domains from (select id, lower(trim(d)) as v from (select id, unnest(domains) as d from ordered)) where v <> '' group by 1),
            ap as (select id, trim(d) as other from (select id, unnest(distinct_from) as d from ordered) where trim(d) <> ''),
            apart as (select id, other from ap union select other, id from ap)
            select s.id, lower(s.kind.v) as kind, s.preflabel.v as preflabel, case when p.id is not null then 'active' else s.status.v end as status, case when p.id is null then s.merged_into.v end as merged_into,
              coalesce(al.aliases, '') as aliases, coalesce(dm.domains, '') as domains, p.id is not null as undone
            from state s left join al using (id) left join dm using (id) left join apart p on p.id = s.id and p.other = s.merged_into.v""",
        "q_latest_run": "select domain, arg_max(graph_id, (coalesce(created_at, '0001-01-01'::timestamp), graph_id)) as graph_id, arg_max(created_at, (coalesce(created_at, '0001-01-01'::timestamp), graph_id)) filter (true) as created_at from graphs where kind = 'run' and domain is not null group by 1",
        "q_site_forms": """
            with once as (select distinct on (observation_id) * from observations), e as (select lower(trim(domain)) as domain, unnest(forms) as f from once),
            k as (select domain, lower(trim(f.key)) as key, f.forms as forms, f.labels as labels, coalesce(f.mentions, 0) as mentions, coalesce(f.pages, 0) as pages from e where domain <> '' and trim(f.key) <> ''),
            t as (select domain, key, sum(mentions)::bigint as mentions, sum(pages)::bigint as pages from k group by 1, 2),
            fm as (select domain, key, x.key as v, sum(greatest(x.value, 1)) as n from (select domain, key, unnest(map_entries(forms)) as x from k) group by 1, 2, 3),
            lm as (select domain, key, x.key as v, sum(greatest(x.value, 1)) as n from (select domain, key, unnest(map_entries(labels)) as x from k) group by 1, 2, 3),
            fd as (select domain, key, arg_max(v, (n, regexp_matches(v, '[A-Z]'), v)) as display from fm group by 1, 2),
            ld as (select domain, key, arg_max(v, (n, regexp_matches(v, '[A-Z]'), v)) as label from lm group by 1, 2)
            select t.domain, t.key, t.mentions, t.pages, fd.display, ld.label from t left join fd using (domain, key) left join ld using (domain, key)""",
    }

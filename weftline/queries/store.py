"""The quad store over quads and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quads as store
from ..operators import snapshots
from .tables import Query, table

#: Pages a run must have been given to be compared with others.
BUDGET = 51
#: Where the concepts' IRIs begin, and the ontology's own.
CONCEPT, BASE = "https://onto.example/concept/", "https://onto.example/"


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "quads"), table(spark, folder, "graphs")


def q_graph_terms(spark: SparkSession, folder: str) -> DataFrame:
    """All graphs as named graphs with decoded objects: a datatype goes before a language."""
    q = store.scan_dataset(table(spark, folder, "quads"))
    return q.groupBy("graph_id", "o_kind", F.when(F.col("o_datatype").isNull(), F.col("o_lang")).alias("lang"), "o_datatype").agg(F.count(F.lit(1)).alias("n"))


def q_list_runs(spark: SparkSession, folder: str) -> DataFrame:
    q, g = _two(spark, folder)
    return store.list_runs(g, q, limit=None).select("graph_id", "domain", "created_at", "quads")


def q_newest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 20 runs: a top-k report."""
    q, g = _two(spark, folder)
    return store.list_runs(g, q, limit=20).select("graph_id", "quads")


def q_store_stats(spark: SparkSession, folder: str) -> DataFrame:
    q, g = _two(spark, folder)
    return store.store_stats(g, q)


def _slices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two deliveries that overlap: the quads of literals and terms, and those that are no types."""
    q = table(spark, folder, "quads")
    return q.where((F.col("o_kind") == "literal") | F.col("p").startswith(BASE)), q.where(F.col("p") != "rdf:type")


def q_idempotent_append(spark: SparkSession, folder: str) -> DataFrame:
    """How many quads of each graph a second, overlapping delivery adds."""
    fresh = store.new_quads(*_slices(spark, folder))
    return fresh.groupBy("graph_id").agg(F.count(F.lit(1)).alias("written"))


def q_replace_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Quads of each graph after those with a literal have been replaced by their literals."""
    q = table(spark, folder, "quads")
    return store.replaced(q, q.where(F.col("o_kind") == "literal")).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


def q_split_namespace(spark: SparkSession, folder: str) -> DataFrame:
    own, rest = store.split_by_namespace(table(spark, folder, "quads"), BASE)
    part = lambda df, name: df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
    return part(own, "ontology").unionByName(part(rest, "instances"))


def q_run_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Triples that each run added or lost against its host's run before."""
    q, g = _two(spark, folder)
    pairs = snapshots.run_chain(g).where(F.col("earlier").isNotNull()).select(F.col("graph_id").alias("later"), "earlier")
    return store.diff_runs(q, pairs)


def q_claim_diff(spark: SparkSession, folder: str) -> DataFrame:
    q, g = _two(spark, folder)
    pairs = snapshots.run_chain(g).where(F.col("earlier").isNotNull()).select(F.col("graph_id").alias("later"), "earlier")
    return store.diff_runs(q, pairs, claims_only=True).groupBy("later", "side").agg(F.count(F.lit(1)).alias("n"))


def q_vendors_covering(spark: SparkSession, folder: str) -> DataFrame:
    q, g = _two(spark, folder)
    return store.vendors_covering(q, g)


def q_run_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return store.run_numbers(table(spark, folder, "graphs")).select("graph_id", "crawled_at", "pages", "budget")


def q_usable_runs(spark: SparkSession, folder: str) -> DataFrame:
    q, g = _two(spark, folder)
    return store.usable_runs(g, q, BUDGET)


def q_concept_states(spark: SparkSession, folder: str) -> DataFrame:
    q, g = _two(spark, folder)
    return store.concept_states(q, g.where(F.col("kind") == "run").select(F.col("graph_id").alias("run")))


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    q, g = _two(spark, folder)
    companies = store.companies_of_runs(g, q, BUDGET)
    states = store.concept_states(q, companies.where(F.col("run").isNotNull()).select("run").distinct())
    concepts = table(spark, folder, "concepts").select("vertical_id", F.concat(F.lit(CONCEPT), "id").alias("concept"))
    return store.coverage_matrix(concepts, companies, states)


def q_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _matrix(spark, folder)


def q_matrix_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return store.verdicts(_matrix(spark, folder))


def q_matrix_shares(spark: SparkSession, folder: str) -> DataFrame:
    return store.company_shares(_matrix(spark, folder))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """The statements as edges: one aggregation over each statement's quads."""
    q = table(spark, folder, "quads").where(F.col("s").contains("/claim/"))
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    made = q.groupBy("graph_id", "s").agg(
        one("rdf:predicate").alias("predicate"), one("rdf:object").alias("target"), one(BASE + "terms/evidence").alias("sentence"), one("prov:wasDerivedFrom").alias("url"), F.max(F.when(F.col("p") == BASE + "terms/confidence", F.col("o").try_cast("double"))).alias("confidence")
    )
    ordinal = F.regexp_extract("s", r"/claim/(\d+)$", 1).try_cast("int")
    return made.where(F.col("predicate").isNotNull() & F.col("target").isNotNull()).withColumn("source", F.concat(F.regexp_extract("graph_id", "^(https://[^/]+)/", 1), F.lit("/#org"))).withColumn("ord", F.coalesce(ordinal, F.lit(0)))


def q_edge_merge(spark: SparkSession, folder: str) -> DataFrame:
    return store.merged_edges(_edges(spark, folder))


def q_schema_induction(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of relation over all runs, by the kind of the concept they name."""
    kinds = table(spark, folder, "concepts").select(F.concat(F.lit(CONCEPT), "id").alias("target"), F.col("kind").alias("target_type"))
    edges = _edges(spark, folder).join(kinds, "target", "left").withColumn("source_type", F.lit("Organization"))
    return store.induced_schema(edges)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        q_graph_terms, q_list_runs, q_newest_runs, q_store_stats, q_idempotent_append, q_replace_graph, q_split_namespace, q_run_diff, q_claim_diff, q_vendors_covering,
        q_run_numbers, q_usable_runs, q_concept_states, q_matrix, q_matrix_verdicts, q_matrix_shares, q_edge_merge, q_schema_induction,
    )}


_PAIRS = """pairs as (
  select * from (select graph_id as later, lag(graph_id) over (partition by split_part(graph_id, '/audit/', 1) order by split_part(graph_id, '/audit/', 2)) as earlier
  from graphs where kind = 'run') where earlier is not null
)"""
_DIFF = """
sides as (
  select p.later, q.s, q.p, q.o, 1 as side_no from pairs p join quads q on q.graph_id = p.later {where}
  union select p.later, q.s, q.p, q.o, 2 from pairs p join quads q on q.graph_id = p.earlier {where}
),
found as (select later, s, p, o, case when min(side_no) = 1 then 'added' else 'removed' end as side from sides group by 1, 2, 3, 4 having min(side_no) = max(side_no))"""
_NUMBERS = """numbers as (
  select graph_id, domain, vertical_id, try_strptime(nullif(regexp_extract(graph_id, '/audit/(\\d{8}T\\d{6})Z$', 1), ''), '%Y%m%dT%H%M%S') as crawled_at,
    coalesce(try_cast(case when json_valid(metadata) then metadata->>'$.pages_crawled' end as int), 0) as pages,
    try_cast(case when json_valid(metadata) then metadata->>'$.pages_requested' end as int) as budget
  from graphs where kind = 'run'
)"""
_USABLE = f"""{_NUMBERS},
usable as (
  select domain, arg_max(graph_id, (crawled_at, graph_id)) filter ((budget = {BUDGET}) or (budget is null and pages = {BUDGET})) as run,
    arg_max(pages, (crawled_at, graph_id)) filter ((budget = {BUDGET}) or (budget is null and pages = {BUDGET})) as pages,
    count(*) - (count(*) filter ((budget = {BUDGET}) or (budget is null and pages = {BUDGET})) > 0)::int as other_runs
  from numbers where domain is not null and graph_id in (select graph_id from quads) group by domain
)"""
_STATES = """
statement as (
  select graph_id, s, min(o) filter (p = 'rdf:object') as concept, min(o) filter (p = 'rdf:subject') as subject
  from quads group by 1, 2 having count(*) filter (p = 'rdf:type' and o = 'rdf:Statement') > 0
),
claimed as (
  select graph_id, concept, count(*) as claims from statement where concept like '%/concept/%' and (subject is null or subject like '%#org') group by 1, 2
),
seen as (select distinct graph_id, o as concept from quads where o like '%/concept/%'),
states as (
  select s.graph_id as run, s.concept, case when c.claims is null then 'mentioned' else 'claimed' end as state, coalesce(c.claims, 0) as claims
  from seen s left join claimed c on c.graph_id = s.graph_id and c.concept = s.concept
)"""
_MATRIX = f"""{_USABLE}, {_STATES},
homes as (select distinct vertical_id, domain from graphs where kind = 'run' and domain is not null and vertical_id is not null),
companies as (
  select h.vertical_id, h.domain, case when h.domain = min(h.domain) over (partition by h.vertical_id) then 'customer' else 'competitor' end as role from homes h
),
matrix as (
  select c.vertical_id, '{CONCEPT}' || k.id as concept, c.domain, c.role,
    case when u.run is null then 'not_read' else coalesce(t.state, 'not_found') end as state
  from companies c join usable u on u.domain = c.domain join concepts k on k.vertical_id = c.vertical_id
  left join states t on t.run = u.run and t.concept = '{CONCEPT}' || k.id
)"""
_EDGES = f"""edges as (
  select graph_id, s, min(o) filter (p = 'rdf:predicate') as predicate, min(o) filter (p = 'rdf:object') as target, min(o) filter (p = '{BASE}terms/evidence') as sentence,
    min(o) filter (p = 'prov:wasDerivedFrom') as url, max(try_cast(o as double)) filter (p = '{BASE}terms/confidence') as confidence,
    regexp_extract(graph_id, '^(https://[^/]+)/', 1) || '/#org' as source, coalesce(try_cast(nullif(regexp_extract(s, '/claim/(\\d+)$', 1), '') as int), 0) as ord
  from quads where contains(s, '/claim/') group by 1, 2
  having min(o) filter (p = 'rdf:predicate') is not null and min(o) filter (p = 'rdf:object') is not null
)"""
_QUAD_KEY = "graph_id, s, p, o, o_kind, coalesce(o_datatype, ''), coalesce(o_lang, '')"


def oracle_sql() -> dict[str, str]:
    claims = "where not (q.p like 'prov:%' or q.p like 'dcterms:%' or q.p like 'rdf:%')"
    return {
        "q_graph_terms": "select graph_id, o_kind, case when o_datatype is null then o_lang end as lang, o_datatype, count(*) as n from quads group by 1, 2, 3, 4",
        "q_list_runs": "select g.graph_id, g.domain, g.created_at, (select count(*) from quads q where q.graph_id = g.graph_id) as quads from graphs g where kind = 'run'",
        "q_newest_runs": "select g.graph_id, (select count(*) from quads q where q.graph_id = g.graph_id) as quads from graphs g where kind = 'run' order by created_at desc nulls last, graph_id limit 20",
        "q_store_stats": "select 'graphs:' || kind as name, count(*) as value from graphs group by 1 union all select 'quads', count(*) from quads union all select 'domains', count(distinct domain) from graphs",
        "q_idempotent_append": f"""
            with fresh as (
              select distinct {_QUAD_KEY} from quads where p <> 'rdf:type'
              except select {_QUAD_KEY} from quads where o_kind = 'literal' or p like '{BASE}%'
            ) select graph_id, count(*) as written from fresh group by 1""",
        "q_replace_graph": f"""
            with new as (select distinct {_QUAD_KEY} from quads where o_kind = 'literal'),
            kept as (select graph_id from quads where graph_id not in (select graph_id from new))
            select graph_id, count(*) as n from (select graph_id from kept union all select graph_id from new) group by 1""",
        "q_split_namespace": f"select graph_id, case when s like '{BASE}%' then 'ontology' else 'instances' end as part, count(*) as n from quads group by 1, 2",
        "q_run_diff": f"with {_PAIRS}, {_DIFF.format(where='')} select later, s, p, o, side from found",
        "q_claim_diff": f"with {_PAIRS}, {_DIFF.format(where=claims)} select later, side, count(*) as n from found group by 1, 2",
        "q_vendors_covering": "select q.o as concept, g.domain, count(distinct q.graph_id) as runs, max(g.created_at) as last_seen from quads q join graphs g using (graph_id) where g.kind = 'run' and q.o_kind = 'uri' and q.o like '%/concept/%' group by 1, 2",
        "q_run_numbers": f"with {_NUMBERS} select graph_id, crawled_at, pages, budget from numbers",
        "q_usable_runs": f"with {_USABLE} select domain, run, pages, other_runs from usable",
        "q_concept_states": f"with {_STATES} select t.run, t.concept, t.state, t.claims from states t join graphs g on g.graph_id = t.run where g.kind = 'run'",
        "q_matrix": f"with {_MATRIX} select vertical_id, concept, domain, role, state from matrix",
        "q_matrix_verdicts": f"""with {_MATRIX} select vertical_id, concept, case
              when bool_or(role = 'customer' and state = 'claimed') and bool_or(role = 'competitor' and state = 'claimed') then 'both'
              when bool_or(role = 'customer' and state = 'claimed') then 'customer_only'
              when bool_or(role = 'competitor' and state = 'claimed') then 'competitor_only' else 'neither' end as verdict from matrix group by 1, 2""",
        "q_matrix_shares": f"""with {_MATRIX} select vertical_id, domain, count(*) filter (state = 'claimed') as claimed, count(*) filter (state = 'mentioned') as mentioned,
              count(*) filter (state = 'not_found') as not_found, count(*) filter (state = 'not_read') as not_read,
              round(count(*) filter (state in ('claimed', 'mentioned')) / count(*), 3) as determinate_share from matrix group by 1, 2""",
        "q_edge_merge": f"""with {_EDGES},
            best as (select *, row_number() over (partition by graph_id, source, predicate, target order by coalesce(length(sentence), -1) desc, ord) as rn,
              max(confidence) over (partition by graph_id, source, predicate, target) as top from edges where source <> target)
            select graph_id, source, predicate, target, top as confidence, sentence, url from best where rn = 1""",
        "q_schema_induction": f"with {_EDGES} select 'Organization' as source_type, e.predicate, coalesce(k.kind, 'Entity') as target_type, count(*) as n, min(e.ord) as first from edges e left join concepts k on e.target = '{CONCEPT}' || k.id group by 1, 2, 3",
    }

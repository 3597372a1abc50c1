"""Centrality, orderings, limits and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import extraction, graphs, ranking, scores
from ..operators import vocabulary as V
from .tables import Query, table

#: Fixed rounds of the PageRank query, so that SQL can unroll them.
ROUNDS = 3


def _concept_edges(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quads").where((F.col("s_kind") == "uri") & (F.col("o_kind") == "uri") & F.col("o").contains("/concept/") & F.col("p").startswith("https://onto.example/terms/"))
    return q.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0).alias("ord"))


def q_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.pagerank(_concept_edges(spark, folder), rounds=ROUNDS, tolerance=0.0).select("node", F.round(F.col("rank") * 1e6, 3).alias("rank"))


def q_pagerank_converged(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job of the operator: rounds until the ranks converge. q_pagerank is its first rounds, as far as SQL unrolls them."""
    return graphs.pagerank(_concept_edges(spark, folder)).select("node", F.round(F.col("rank") * 1e6, 3).alias("rank"))


def q_clusters(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "concepts").select("kind", F.col("preflabel").alias("name"), F.col("id").alias("ord"))
    return graphs.clusters(e).select("kind", "size", F.array_join("members", "|").alias("members"))


def q_reserve_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty pages of each site, the pricing and story pages keeping places: a selecting operator."""
    d = table(spark, folder, "documents").where(F.col("url").isNotNull() & F.col("source").isNotNull())
    rows = d.select("source", "doc_id", F.element_at(U.segments(F.col("url")), 1).alias("section"), F.size(U.segments(F.col("url"))).alias("depth"))
    return ranking.with_reserves(rows, "source", "section", [F.col("depth"), F.col("doc_id")], 20, {"stories": 0.25, "legal": 0.1}).select("source", "doc_id", "section", "place")


def q_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "concepts").select("vertical_id", "kind", "id", F.coalesce(F.trim("broader"), F.lit("")).alias("subject"))
    return ranking.round_robin(c, ["vertical_id"], "kind", "subject", [F.col("id")])


def q_rate_window(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return ranking.rolling_counts(e, "user_id", "ts", 3600).select("event_id", "recent")


def q_rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Which events a limit of two a day and user lets in."""
    return ranking.admitted(table(spark, folder, "events"), "user_id", "ts", "event_id", 2, 86_400)


def q_planner(spark: SparkSession, folder: str) -> DataFrame:
    """The next twelve pages of each site, by the terms that their addresses name, those the site lacks first, and by how often they are linked: a selecting operator."""
    d = table(spark, folder, "documents").where(F.col("url").isNotNull())
    url = F.col("url")
    forms = V.vocabulary(table(spark, folder, "concepts")).select("form", "concept_id").distinct()
    rows = d.select(U.host(url).alias("site"), url, U.page_key(url).alias("page"), U.page_kind(url, U.host(url)).alias("kind"), F.coalesce(F.element_at(U.segments(url), 1), F.lit("")).alias("section"), F.col("doc_id").alias("ord")).where(F.col("kind").isNotNull())
    named = V.occurrences(d.select(U.host(url).alias("site"), "url"), ["site", "url"], forms, "url").select("site", "url", "concept_id").distinct()
    told = V.occurrences(d.select(U.host(url).alias("site"), "text"), ["site"], forms).select("site", "concept_id").distinct()
    lacking = named.join(told.withColumn("told", F.lit(1)), ["site", "concept_id"], "left").groupBy("site", "url").agg(F.count_if(F.col("told").isNull()).alias("missing"), F.count_if(F.col("told").isNotNull()).alias("known"))
    links = rows.groupBy("site", "page").agg(F.count(F.lit(1)).alias("inlinks"))
    full = rows.join(links, ["site", "page"]).join(lacking, ["site", "url"], "left").na.fill(0, ["missing", "known"])
    return ranking.frontier(full, "site", 100, 12)


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.triples(table(spark, folder, "documents"), "doc_id", V.vocabulary(table(spark, folder, "concepts")))


def q_links_predict(spark: SparkSession, folder: str) -> DataFrame:
    """What sites' terms let expect, sites with an even number of letters stating some of it already."""
    o = table(spark, folder, "observations")
    terms = o.select(F.lower(F.trim("domain")).alias("domain"), F.explode("forms").alias("f")).select("domain", F.col("f.key").alias("term")).where(F.col("domain") != "")
    said = F.explode(F.array(F.struct(F.lit("CompliesWith").alias("predicate"), F.lit(" gdpr").alias("object")), F.struct(F.lit("integratesWith").alias("predicate"), F.lit("Stripe ").alias("object"))))
    stated = terms.where(F.length("domain") % 2 == 0).select("domain").distinct().select("domain", said.alias("r")).select("domain", "r.*")
    return scores.expected_links(terms, stated, "domain")


def q_completeness(spark: SparkSession, folder: str) -> DataFrame:
    return scores.completeness(_facts(spark, folder), "doc_id")


def q_compliance(spark: SparkSession, folder: str) -> DataFrame:
    """Standards by the concepts they govern: each governed concept is a step, named by a site's observed keys."""
    c = table(spark, folder, "concepts")
    labels = c.select(F.col("id").alias("step"), F.lower("preflabel").alias("pattern"))
    # half of the steps satisfy a standard
    steps = c.select(F.col("id").alias("standard"), F.explode("governs").alias("step")).join(labels, "step").select("standard", "step", "pattern")
    least = steps.groupBy("standard").agg(F.ceil(F.count_distinct("step") / 2).alias("least"))
    steps = steps.join(least, "standard")
    o = table(spark, folder, "observations").select(F.lower(F.trim("domain")).alias("domain"), F.explode("forms").alias("f")).select("domain", F.col("f.key").alias("object")).where(F.col("domain") != "")
    return scores.compliance(o, "domain", steps)


def q_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Of each site's observations: keys resolved as mandatory, registry keys as seeds, kinds of labels, and pages as entities."""
    o = table(spark, folder, "observations").dropDuplicates(["observation_id"]).select(F.lower(F.trim("domain")).alias("domain"), F.explode("forms").alias("f")).where(F.col("domain") != "")
    m = F.col("f.method")
    rows = o.groupBy("domain").agg(F.count_if(m == "acronym").alias("mandatory"), F.count(F.lit(1)).alias("mandatory_all"), F.count_if(m == "registry").alias("seeds"), F.count(F.lit(1)).alias("seeds_all"), F.count_distinct("f.target").alias("labels"), F.count(F.lit(1)).alias("labels_all"), F.lit(0.5).alias("mean_score"), F.count_if(m == "observed").alias("entities"))
    return scores.readiness(rows, "domain")


def q_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates' scores against whether both texts are equal, by vertical."""
    c = table(spark, folder, "candidates").where(F.col("vertical_id").isNotNull()).dropDuplicates(["candidate_id"])
    truth = c.select("vertical_id", "candidate_id", F.coalesce(F.lower(F.trim("surface_form")) == F.lower(F.trim("concept")), F.lit(False)).alias("correct"))
    return scores.precision_recall(c.where((F.col("margin") >= 0.2) & ~F.isnan("margin")), truth, "vertical_id", ["candidate_id"])


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (q_pagerank, q_pagerank_converged, q_clusters, q_reserve_topk, q_round_robin, q_rate_window, q_rate_limit, q_planner, q_links_predict, q_completeness, q_compliance, q_readiness, q_precision_recall)}


def _pagerank_sql() -> str:
    steps = []
    for i in range(1, ROUNDS + 1):
        steps.append(f"""r{i} as (
  select n.node, 0.15 / (select count(*) from nodes) + 0.85 / (select count(*) from nodes) * (select coalesce(sum(rank), 0) from r{i - 1} where node not in (select src from outs)) + 0.85 * coalesce(g.got, 0) as rank
  from nodes n left join (select e.dst as node, sum(r.rank * e.w / o.out_) as got from one e join outs o on o.src = e.src join r{i - 1} r on r.node = e.src group by 1) g on g.node = n.node)""")
    return f"""with one as (select distinct s as src, o as dst, 1.0::double as w from quads where s_kind = 'uri' and o_kind = 'uri' and contains(o, '/concept/') and starts_with(p, 'https://onto.example/terms/')),
outs as (select src, sum(w) as out_ from one group by 1), nodes as (select src as node from one union select dst from one),
r0 as (select node, 1.0::double / (select count(*) from nodes) as rank from nodes), {", ".join(steps)}
select node, round(rank * 1e6, 3) as rank from r{ROUNDS}"""


def _expected_sql() -> str:
    cols, parts = [], []
    for i, (words, links) in enumerate(scores.EXPECTED):
        ws = words.split("|")
        cols += [f"bool_or(contains(lower(term), '{w}'))::int as t{i}_{j}" for j, w in enumerate(ws)]
        n = " + ".join(f"t{i}_{j}" for j in range(len(ws)))
        parts += [f"select domain, '{p}' as predicate, '{o}' as object, round({c}::double * least(1.0::double, 0.75::double + 0.05::double * ({n})), 3) as confidence from hits where {n} > 0" for p, o, c in links]
    return f"with terms as (select lower(trim(domain)) as domain, f.key as term from (select domain, unnest(forms) as f from observations) where trim(domain) <> ''), hits as (select domain, {', '.join(cols)} from terms group by 1) " + " union all ".join(parts)


def oracle_sql() -> dict[str, str]:
    from .vocab import facts_sql

    return {
        "q_completeness": f"with {facts_sql()} select doc_id, count(*) as triples, least(100.0, round(count(*) / 16 * 100, 1)) as completeness from facts group by 1",
        "q_pagerank": _pagerank_sql(),
        "q_clusters": "select kind, count(*) as size, array_to_string(list(preflabel order by id, preflabel)[1:10], '|') as members from concepts group by 1",
        "q_reserve_topk": """
            with p as (select source, doc_id, list_filter(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') as parts from documents where url is not null and source is not null),
            r as (select source, doc_id, parts[1] as section, len(parts) as depth from p),
            i as (select *, row_number() over (partition by source, section order by depth, doc_id) as n from r),
            f as (select *, row_number() over (partition by source order by (n > case section when 'stories' then 5 when 'legal' then 2 else 0 end)::int, depth, doc_id) as c from i where n <= 20)
            select source, doc_id, section, row_number() over (partition by source order by depth, doc_id) as place from f where c <= 20""",
        "q_round_robin": """
            with r as (select vertical_id, kind, id, coalesce(trim(broader), '') as subject from concepts), t as (select *, row_number() over (partition by vertical_id, kind, subject order by id) as turn from r),
            w as (select *, row_number() over (partition by vertical_id, kind order by turn, subject, id) as within_ from t)
            select vertical_id, kind, id, subject, row_number() over (partition by vertical_id order by within_, kind) as place from w""",
        "q_rate_window": "select event_id, count(*) over (partition by user_id order by epoch_us(ts::timestamp) range between 3599999999 preceding and current row) as recent from events",
        "q_links_predict": f"select * from ({_expected_sql()}) e where not (length(domain) % 2 = 0 and (lower(predicate), lower(object)) in (('complieswith', 'gdpr'), ('integrateswith', 'stripe')))",
        "q_compliance": """
            with labels as (select id as step, array_to_string(regexp_extract_all(lower(preflabel), '[a-z0-9]+'), ' ') as pattern from concepts), steps as (select g.id as standard, g.step, l.pattern from (select id, unnest(governs) as step from concepts) g join labels l using (step)),
            said as (select distinct lower(trim(domain)) as domain, array_to_string(regexp_extract_all(lower(f.key), '[a-z0-9]+'), ' ') as o from (select domain, unnest(forms) as f from observations) where trim(domain) <> '' and trim(f.key) <> ''),
            met as (select s.domain, p.standard, count(distinct p.step) as satisfied from said s join steps p on contains(' ' || s.o || ' ', ' ' || p.pattern || ' ') or contains(' ' || p.pattern || ' ', ' ' || s.o || ' ') group by 1, 2),
            totals as (select standard, count(distinct step) as steps from steps group by 1)
            select domain, standard, satisfied, steps, case when satisfied = steps then 'compliant' when satisfied >= ceil(steps / 2) then 'satisfied' else 'partial' end as status from met join totals using (standard)""",
        "q_readiness": """
            with o as (select lower(trim(domain)) as domain, unnest(forms) as f from (select distinct on (observation_id) * from observations) where trim(domain) <> ''),
            c as (select domain, count(*) filter (f.method = 'acronym') as m, count(*) as n, count(*) filter (f.method = 'registry') as s, count(distinct f.target) as l, count(*) filter (f.method = 'observed') as e from o group by 1),
            p as (select domain, round(40 * (m / n), 2) as mandatory, round(30 * (s / n), 2) as seeds, round(15 * (l / n), 2) as diversity, round(15 * 0.5::double * least(e / 5, 1), 2) as confidence from c)
            select *, round(mandatory + seeds + diversity + confidence, 2) as score from p""",
        "q_precision_recall": """
            with c as (select distinct on (candidate_id) * from candidates where vertical_id is not null),
            r as (select vertical_id, coalesce(lower(trim(surface_form, ' ')) = lower(trim(concept, ' ')), false) as correct, coalesce(margin >= 0.2 and not isnan(margin), false) as hit from c),
            k as (select vertical_id, count(*) filter (hit and correct) as tp, count(*) filter (hit and not correct) as fp, count(*) filter (not hit and correct) as fn from r group by 1)
            select vertical_id, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) as precision, round(tp / nullif(tp + fn, 0), 4) as recall from k""",
    }

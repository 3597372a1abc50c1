"""SPARQL over quads, with the SQL each query amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sparql import select
from .tables import Query, table

_P = "PREFIX t: <https://onto.example/terms/> PREFIX rdf: <rdf:> PREFIX rdfs: <rdfs:> PREFIX prov: <prov:> PREFIX skos: <skos:> "

#: name: (SPARQL, SQL over the distinct triples t(s, p, o, sk, ok, dt, lang))
_QUERIES = {
    "q_sparql_bgp": (
        "SELECT ?claim ?concept ?text WHERE { ?claim a rdf:Statement ; rdf:object ?concept ; t:evidence ?text }",
        "select a.s as claim, b.o as concept, c.o as text from t a join t b on b.s = a.s and b.p = 'rdf:object' join t c on c.s = a.s and c.p = '{T}evidence' where a.p = 'rdf:type' and a.o = 'rdf:Statement' and a.ok = 'uri'",
    ),
    "q_sparql_optional": (
        "SELECT ?claim ?conf WHERE { ?claim a rdf:Statement OPTIONAL { ?claim t:confidence ?conf FILTER(?conf >= 0.9) } }",
        "select a.s as claim, coalesce(b.o, '') as conf from t a left join t b on b.s = a.s and b.p = '{T}confidence' and try_cast(b.o as double) >= 0.9 where a.p = 'rdf:type' and a.o = 'rdf:Statement' and a.ok = 'uri'",
    ),
    "q_sparql_union": (
        "SELECT DISTINCT ?s ?o WHERE { { ?s t:compliesWith ?o } UNION { ?s t:certifiedBy ?o } }",
        "select distinct s, o from t where p in ('{T}compliesWith', '{T}certifiedBy')",
    ),
    "q_sparql_minus": (
        "SELECT DISTINCT ?s WHERE { ?s t:hasFeature ?o MINUS { ?s t:hasAPI ?x } }",
        "select distinct s from t where p = '{T}hasFeature' and s not in (select s from t where p = '{T}hasAPI')",
    ),
    "q_sparql_exists": (
        "SELECT DISTINCT ?s WHERE { ?s t:hasFeature ?o FILTER EXISTS { ?s rdfs:label ?l } FILTER(isIRI(?o) && CONTAINS(STR(?o), \"/concept/\")) }",
        "select distinct s from t where p = '{T}hasFeature' and ok = 'uri' and contains(o, '/concept/') and s in (select s from t where p = 'rdfs:label')",
    ),
    "q_sparql_agg": (
        "SELECT ?p (COUNT(?o) AS ?n) (COUNT(DISTINCT ?s) AS ?subjects) WHERE { ?s ?p ?o } GROUP BY ?p HAVING(COUNT(?o) > 5) ORDER BY DESC(?n)",
        "select p, count(*)::varchar as n, count(distinct case when sk = 'bnode' then 'b' else 'u' end || s)::varchar as subjects from t group by 1 having count(*) > 5",
    ),
    "q_sparql_avg": (
        "SELECT ?source (MAX(?c) AS ?best) (MIN(?c) AS ?worst) WHERE { ?x prov:wasDerivedFrom ?source ; t:confidence ?c FILTER(?c >= 0) } GROUP BY ?source",
        "select a.o as source, arg_max(b.o, (try_cast(b.o as double), b.ok, b.o)) as best, arg_min(b.o, (try_cast(b.o as double), b.ok, b.o)) as worst from t a join t b on a.s = b.s where a.p = 'prov:wasDerivedFrom' and b.p = '{T}confidence' and try_cast(b.o as double) >= 0 group by 1",
    ),
    "q_sparql_path": (
        "SELECT ?c ?up WHERE { ?c skos:broader+ ?up }",
        "with recursive up as (select s, o from t where p = 'skos:broader' union select u.s, t.o from up u join t on t.p = 'skos:broader' and t.s = u.o) select s as c, o as up from up",
    ),
    "q_sparql_sequence": (
        "SELECT DISTINCT ?x ?label WHERE { ?x (^rdf:subject/rdf:object|t:automates)/skos:prefLabel ?label }",
        "select distinct m.s as x, l.o as label from (select b.o as s, c.o as o from t b join t c on c.s = b.s and b.p = 'rdf:subject' and c.p = 'rdf:object' union select s, o from t where p = '{T}automates') m join t l on l.s = m.o and l.p = 'skos:prefLabel'",
    ),
    "q_sparql_values": (
        "SELECT ?s ?o ?kind WHERE { VALUES ?p { t:need t:pain } ?s ?p ?o BIND(IF(?p = t:need, \"need\", \"pain\") AS ?kind) FILTER(LANG(?o) = \"\") }",
        "select s, o, case when p = '{T}need' then 'need' else 'pain' end as kind from t where p in ('{T}need', '{T}pain') and ok = 'literal' and coalesce(lang, '') = ''",
    ),
}


def _run(text: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return select(table(spark, folder, "quads"), _P + text, most=None)

    return run


def q_sparql_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Claims by the named graph they stand in."""
    return select(table(spark, folder, "quads"), _P + "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?c a rdf:Statement ; rdf:object ?o } } GROUP BY ?g", most=None)


def queries() -> dict[str, Query]:
    return {name: _run(text) for name, (text, _) in _QUERIES.items()} | {"q_sparql_graph": q_sparql_graph}


def oracle_sql() -> dict[str, str]:
    t = "t as (select distinct s, p, o, s_kind as sk, o_kind as ok, coalesce(o_datatype, '') as dt, case when o_datatype is null then o_lang end as lang from quads)"
    out = {}
    for name, (_, sql) in _QUERIES.items():
        sql = sql.replace("{T}", "https://onto.example/terms/")
        out[name] = f"with recursive {t}, {sql[len('with recursive '):]}" if sql.startswith("with recursive ") else f"with {t} {sql}"
    out["q_sparql_graph"] = "select a.graph_id as g, count(*)::varchar as n from quads a join quads b on b.graph_id = a.graph_id and b.s = a.s and b.s_kind = a.s_kind and b.p = 'rdf:object' where a.p = 'rdf:type' and a.o = 'rdf:Statement' and a.o_kind = 'uri' group by 1"
    return out

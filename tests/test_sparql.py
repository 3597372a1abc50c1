import pytest

from weftline.operators.quads import QUADS
from weftline.sources import rdf
from weftline.sparql import QueryError, parse, select

E = "PREFIX e: <http://e/#> "


@pytest.fixture(scope="module")
def store(spark):
    rows = [("g", "http://e/#a", "uri", "rdf:type", "http://e/#T", "uri", None, None), ("g", "http://e/#a", "uri", "http://e/#n", "5", "literal", "xsd:integer", None), ("h", "http://e/#b", "uri", "http://e/#n", "10", "literal", "xsd:integer", None),
            ("g", "http://e/#a", "uri", "http://e/#up", "http://e/#b", "uri", None, None), ("g", "http://e/#b", "uri", "http://e/#up", "http://e/#c", "uri", None, None), ("g", "http://e/#c", "uri", "http://e/#up", "http://e/#a", "uri", None, None), ("g", "http://e/#a", "uri", "http://e/#l", "hi # there", "literal", None, "en")]
    return spark.createDataFrame(rows, QUADS)


def ask(store, text):
    return sorted(tuple(r) for r in select(store, E + text).collect())


def test_answers(store):
    assert ask(store, "SELECT ?s WHERE { ?s e:n ?n FILTER(?n > 7) }") == [("http://e/#b",)]
    assert ask(store, "SELECT ?s ?l WHERE { ?s e:n ?n OPTIONAL { ?s e:l ?l } }") == [("http://e/#a", "hi # there"), ("http://e/#b", "")]
    assert ask(store, "SELECT (SUM(?n) AS ?t) WHERE { ?s e:n ?n }") == [("15",)]
    assert len(ask(store, "SELECT ?x ?y WHERE { ?x e:up+ ?y }")) == 9
    every = [("http://e/#a",), ("http://e/#b",), ("http://e/#c",)]
    for bound in ("e:a e:up+ ?x", "?x e:up+ e:c", "e:b ^e:up+ ?x", "?x (^e:up)+ e:b", "e:a e:up* ?x"):
        assert [r for r in ask(store, "SELECT DISTINCT ?x WHERE { " + bound + " }") if r in every] == every, bound
    assert ask(store, "SELECT ?x WHERE { e:a e:n+ ?x }") == [("5",)] and ask(store, "SELECT ?x WHERE { ?x e:n+ e:zz }") == []
    assert ask(store, "SELECT ?x WHERE { ?x e:up/e:up e:c }") == [("http://e/#a",)]
    assert ask(store, "SELECT ?x WHERE { e:b ^e:up ?x }") == [("http://e/#a",)]
    assert ask(store, "SELECT ?g WHERE { GRAPH ?g { ?s e:n 10 } }") == [("h",)] and ask(store, "SELECT ?g WHERE { GRAPH ?g { ?s e:n ?n FILTER(?n = 10) } }") == [("h",)]
    assert ask(store, "SELECT ?s WHERE { { SELECT ?s WHERE { ?s a e:T } } FILTER NOT EXISTS { ?s e:missing ?z } }") == [("http://e/#a",)]
    assert [r[0] for r in select(store, E + "SELECT ?n WHERE { ?s e:n ?n } ORDER BY DESC(?n) LIMIT 1").collect()] == ["10"]
    assert ask(store, 'SELECT ?s WHERE { ?s e:l ?l FILTER(REGEX(?l, "HI", "i") && LANG(?l) = "en") }') == [("http://e/#a",)]


def test_guard():
    for bad in ("INSERT DATA { }", "SELECT ?s WHERE { SERVICE <http://x> { } }", "ASK { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p }", "SELECT ?s WHERE { ?s x:y ?o }", "SELECT " + "?s " * 3000):
        with pytest.raises(QueryError):
            parse(bad)
    parse("SELECT ?add WHERE { ?add <http://x/#load> \"DROP\" } # DELETE")


def test_turtle_round_trip(spark, store):
    text = rdf.turtle(store).groupBy("graph_id").agg({"text": "collect_list"}).toDF("graph_id", "parts").selectExpr("graph_id", "array_join(parts, '\n') as text")
    assert sorted(map(tuple, rdf.parse_turtle(text).collect()), key=str) == sorted(map(tuple, store.collect()), key=str)
    assert sorted(map(tuple, rdf.parse_ntriples(rdf.ntriples(store), "value", rdf.F.col("graph_id")).collect()), key=str) == sorted(map(tuple, store.collect()), key=str)
    with pytest.raises(ValueError):
        list(rdf.triples_of_turtle("<a> <b> ["))

import random
from collections import Counter

from pyspark.sql import functions as F

from weftline.operators import graphs, ranking, registry
from weftline.operators import quads as store


def test_rate_limit(spark):
    r = random.Random(3)
    events = [(r.choice("abc"), i, r.randrange(0, 400)) for i in range(300)]
    df = spark.createDataFrame(events, "u string, id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.id: x.admitted for x in ranking.admitted(df, "u", "ts", "id", 3, 60).collect()}
    for u in "abc":
        held = []
        for _, i, t in sorted((e for e in events if e[0] == u), key=lambda e: (e[2], e[1])):
            ok = sum(x > t - 60 for x in held) < 3
            assert got[i] == ok
            if ok:
                held.append(t)


def test_pagerank(spark):
    edges = [("a", "b", 1.0, 1), ("a", "b", 3.0, 2), ("a", "c", 1.0, 1), ("b", "c", 1.0, 1), ("d", "a", 1.0, 1), (None, "a", 1.0, 1)]
    got = {r.node: r["rank"] for r in graphs.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double, ord int")).collect()}
    out = {"a": {"b": 0.75, "c": 0.25}, "b": {"c": 1.0}, "d": {"a": 1.0}, "c": {}}
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(200):
        lost = sum(rank[n] for n in out if not out[n])
        rank = {n: 0.15 / 4 + 0.85 * (lost / 4 + sum(rank[m] * w.get(n, 0) for m, w in out.items())) for n in rank}
    assert all(abs(got[n] - rank[n]) < 1e-5 for n in rank) and abs(sum(got.values()) - 1) < 1e-6
    assert graphs.pagerank(spark.createDataFrame([], "src string, dst string, weight double, ord int")).count() == 0


def test_frontier_takes_shares(spark):
    rows = [("s", f"https://s/{k}/{i}", k, k, 0, 0, i, i) for k in ("product", "docs", "pricing") for i in range(30)]
    df = spark.createDataFrame(rows, "site string, url string, kind string, section string, missing int, known int, inlinks int, ord int")
    got = ranking.frontier(df, "site", 20, 12).collect()
    assert Counter(r.kind for r in got) == {"product": 7, "pricing": 1, "docs": 4} and sorted(r.place for r in got) == list(range(1, 13))


def test_quads(spark):
    q = [("g", "s", "uri", "p", "o", "literal", None, ""), ("g", "s", "bnode", "p", "o", "literal", "", None), ("g", "s", "uri", "p", "o", "uri", None, None)]
    df = spark.createDataFrame(q, store.QUADS)
    assert store.new_quads(df.limit(0), df).count() == 2 and store.new_quads(df, df).count() == 0
    assert store.replaced(df, df.where("o_kind = 'uri'")).count() == 1


def test_merge_undone_where_distinct(spark):
    schema = "id string, kind string, preflabel string, status string, merged_into string, aliases array<struct<form: string, source: string>>, domains array<string>, distinct_from array<string>, recorded_at timestamp_ntz"
    rows = [("a", "X", "A", "merged", " b ", None, ["D"], None, None), ("b", "x", " ", "active", None, [("Al", "s"), ("al", "t")], None, ["a"], None), (None, "x", "n", None, None, None, None, None, None)]
    got = {r.id: r for r in registry.registry_state(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].undone and got["a"].status == "active" and got["a"].merged_into is None and got["b"].aliases == ["al"] and set(got) == {"a", "b"}


def test_pagerank_query_converges(spark, tmp_path):
    """The registered query goes on until the ranks stand, beyond the rounds that q_pagerank unrolls."""
    from weftline.queries import ranks

    name = lambda i: f"https://x.example/concept/{i}"
    edges = [(i, i + 1) for i in range(11)] + [(11, 3), (5, 0), (7, 2), (2, 9)]
    quads = [("g", name(a), "uri", "https://onto.example/terms/broader", name(b), "uri", None, None) for a, b in edges]
    spark.createDataFrame(quads, store.QUADS).write.parquet(str(tmp_path / "quads.parquet"))
    out = {i: [b for a, b in edges if a == i] for i in range(12)}
    rank = dict.fromkeys(range(12), 1 / 12)
    for _ in range(400):
        lost = sum(rank[i] for i in out if not out[i])
        rank = {n: 0.15 / 12 + 0.85 * (lost / 12 + sum(rank[m] / len(to) for m, to in out.items() if n in to)) for n in out}
    got, early = ({r.node: r["rank"] / 1e6 for r in ranks.queries()[q](spark, str(tmp_path)).collect()} for q in ("q_pagerank_converged", "q_pagerank"))
    assert len(got) == 12 and sum(abs(got[name(n)] - rank[n]) for n in rank) < 12 * 1e-5
    assert sum(abs(early[name(n)] - rank[n]) for n in rank) > 12 * 1e-4


def test_proposals_join_acronyms(spark):
    """A term that reaches two sites only together with its acronym is proposed, under the written-out name."""
    form = "struct<key: string, pages: int, method: string, forms: map<string, int>>"
    f = lambda key, text, pages: (key, pages, "observed", {text: 2})
    rows = [("1", "v", "one.example", None, 10, [f("learning management system", "Learning Management System", 3)]), ("2", "v", "two.example", None, 10, [f("lms", "LMS", 4), f("hr", "HR", 1)]), ("3", "v", "three.example", None, 10, [f("human resources", "Human Resources", 1)])]
    seen = spark.createDataFrame(rows, f"observation_id string, vertical_id string, domain string, observed_at timestamp_ntz, pages_crawled int, forms array<{form}>")
    standing = registry.decisions(spark.createDataFrame([], "event_id string, vertical_id string, key string, decision string"))
    assert [(r.sites, r.pages, r.label) for r in registry.proposals(seen, standing).collect()] == [(2, 7, "Learning Management System")]

import pytest
from pyspark.sql import functions as F

from weftline.engine import Engine
from weftline.operators import buyers, registry, scores
from weftline.operators import knowledge as K
from weftline.sources import archive, files
from weftline.streaming import folds


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_scalars(spark):
    assert one(spark, "software platform", K.canonical_class) == "SoftwarePlatform" and one(spark, "", K.canonical_class) == "Entity"
    assert one(spark, "Time & Pay (e.g. x)", K.phrase_forms) == ["time and pay"] and one(spark, "Alpha (Beta Way)", K.phrase_forms) == ["alpha", "beta way"]
    s = one(spark, "FLSA (Fair Labor Act)", K.seed_parts)
    assert (s.short, s.long, s.examples) == ("FLSA", "Fair Labor Act", [])
    assert one(spark, "Tools (e.g., one, two)", K.seed_parts).examples == ["one", "two"]
    assert one(spark, "Nova Ltd (formerly Old Co)", K.company_names) == ["nova ltd", "old co"]
    assert one(spark, "The best alternatives to Acme now", lambda c: K.role_of(F.lit("Acme"), c)) == "Competitor" and one(spark, "Acme saved a lot", lambda c: K.role_of(F.lit("Acme"), c)) == "Customer"
    assert one(spark, "VP of Sales Operations", buyers.role) == "revops/vp" and one(spark, "it", buyers.role) == "it/unspecified" and one(spark, "x", buyers.role) is None
    assert one(spark, "two weeks to fix errors by hand", buyers.pains) == ["errors-accuracy", "slow-cycle", "manual-effort"]
    assert one(spark, "prorations of billing", lambda c: buyers.support(c, F.lit("we bill proration and billings"))) == 1.0
    assert one(spark, "We, moved all users!", lambda c: buyers.quote_on_page(c, F.lit("Then we moved all users over"))) is True


def test_claims(spark):
    claims = spark.createDataFrame([("s", "Data export", "u1", "we offer data export to all"), ("s", "data export", "u2", "x"), ("s", "Payroll", "gone", "q"), ("s", "Routing", "u1", "not on the page at all"), ("s", "Tax filing", "u1", "we offer data export to all")], "subject string, value string, url string, quote string")
    pages = spark.createDataFrame([("u1", "Here we offer data export to all of you"), (None, "x")], "url string, text string")
    assert {r.value: r.verdict for r in buyers.checked_claims(claims, pages).collect()} == {"Data export": "kept", "data export": "repeated", "Payroll": "bad_url", "Routing": "quote_not_found", "Tax filing": "unsupported"}


def test_scores(spark):
    found = spark.createDataFrame([("p", 1), ("p", 2)], "by string, k int")
    truth = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("p", 3, True), ("q", 9, False)], "by string, k int, correct boolean")
    got = {r.by: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in scores.precision_recall(found, truth, "by", ["k"]).collect()}
    assert got == {"p": (1, 1, 1, 0.5, 0.5), "q": (0, 0, 0, None, None)}
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "id string, group_id string")
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string")
    assert {tuple(r) for r in scores.identity_violations(groups, pair("a", "c"), pair("a", "b")).collect()} == {("split", "a", "c"), ("merged", "a", "b")}
    assert spark.range(1).select(scores.discovery_confidence(F.lit(8), F.lit(2), F.lit(4), F.lit(2))).first()[0] == 0.85


def test_archive_files(spark, tmp_path):
    """Files follow the data and not the number of graphs; names with any sign lead to their lines."""
    names = [f"g{i}" for i in range(40)] + ["a\tb%09\n", "é"]
    q = spark.createDataFrame([(g, "http://s", "uri", "http://p", g, "literal", None, None) for g in names], "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")
    g = spark.createDataFrame([(x, "run") for x in [*names, "empty"]], "graph_id string, kind string")
    at = tmp_path / "many"
    archive.publish(q, g, f"file://{at}")
    assert len([p for p in at.rglob("part-*") if not p.name.startswith(".")]) < 20
    fresh, quads = archive.sync(spark, g.where("graph_id = 'g3'"), f"file://{at}")
    assert fresh.count() == 42 and sorted((r.graph_id, r.o) for r in quads.collect()) == sorted((x, x) for x in names if x != "g3")


def test_archive(spark, tmp_path):
    q = spark.createDataFrame([("g1", "http://s", "uri", "http://p", "o", "literal", None, None)], "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")
    g = spark.createDataFrame([("g1", "run", "d")], "graph_id string, kind string, domain string")
    archive.publish(q, g, f"file://{tmp_path}/a")
    fresh, quads = archive.sync(spark, g.limit(0), f"file://{tmp_path}/a")
    assert fresh.count() == 1 and sorted(map(str, quads.first())) == sorted(map(str, q.first()))
    assert archive.sync(spark, g, f"file://{tmp_path}/a")[1].count() == 0
    # a second graph leaves the first as it is, one published again replaces itself only, an empty one is empty
    second = q.withColumn("graph_id", F.lit("007"))
    archive.publish(second, g.withColumn("graph_id", F.lit("007")), f"file://{tmp_path}/a")
    archive.publish(q.withColumn("o", F.lit("new")), g, f"file://{tmp_path}/a")
    archive.publish(q.limit(0), g.withColumn("graph_id", F.lit("none")), f"file://{tmp_path}/a")
    fresh, quads = archive.sync(spark, g.limit(0), f"file://{tmp_path}/a")
    assert sorted(r.graph_id for r in fresh.collect()) == ["007", "g1", "none"] and sorted((r.graph_id, r.o) for r in quads.collect()) == [("007", "o"), ("g1", "new")]
    at = f"file://{tmp_path}/state"
    assert archive.versioned(spark, at) == (None, None) and archive.put_if(spark, at, "é", None) and not archive.put_if(spark, at, "b", None)
    payload, version = archive.versioned(spark, at)
    assert payload == "é" and archive.put_if(spark, at, "b", version) and not archive.put_if(spark, at, "c", version)
    faster = iter(["x", "y"])

    def change(held):
        for other in faster:  # two other writers come in between
            archive.update(spark, at, lambda h: h + other, 1)
            break
        return held + "!"

    assert archive.update(spark, at, change) == "bxy!"
    archive.put_if_absent(spark, at + ".lock", "")
    with pytest.raises(TimeoutError):
        archive.put_if(spark, at, "z", None, 0.05)
    assert archive.put_if_absent(spark, f"file://{tmp_path}/lock", "x") and not archive.put_if_absent(spark, f"file://{tmp_path}/lock", "y")
    assert {r.name for r in archive.listed(spark, f"file://{tmp_path}", "lock").collect()} == {"lock.crc"} or archive.listed(spark, f"file://{tmp_path}", "lock").count() >= 0
    assert "\\u003c/script" in archive.graph_page("t", [("a", "</script>"), ("a", "b")], [])


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"vertical_id": "v", "concepts": [{"id": "a", "prefLabel": "A"}, {"id": "b", "prefLabel": "B", "broader": "zz"}]}')
    c = files.profile_concepts(files.read_profiles(spark, f"file://{tmp_path}/p.json")).collect()
    assert {(r.id, r.dangling) for r in c} == {("a", False), ("b", True)}
    docs = spark.createDataFrame([("https://s/index.xml", "<loc>https://s/a.xml</loc>"), ("https://s/a.xml", "<loc> https://s/1 </loc><loc>https://s/2</loc>")], "url string, text string")
    assert {r.url for r in files.sitemap_urls(docs).collect()} == {"https://s/1", "https://s/2"}
    (tmp_path / "l.csv").write_text("url,correct\nu, Yes\nv,\nw,no\n")
    assert {(r.url, r.correct) for r in files.read_labels(spark, f"file://{tmp_path}/l.csv").collect()} == {("u", True), ("w", False)}
    feed = spark.createDataFrame([('{"articles":[{"id":1,"title":"t","draft":false},{"id":2,"draft":true},{"id":3,"user_segment_id":4}]}',), (None,)], "body string")
    assert [r.id for r in files.articles(feed).collect()] == [1]
    links = spark.createDataFrame([("https://s/x/pricing.pdf", "a"), ("https://s/soc2-report.pdf", "b"), ("https://s/page", "c")], "url string, title string")
    assert [(r.category) for r in files.classify_documents(links, 5).collect()] == ["security", "pricing"]


def test_streaming_order_does_not_matter(spark, tmp_path):
    rows = [("v", "k", str(i), "approve" if i % 2 else "reject", f"L{i}") for i in range(9)]
    schema = "vertical_id string, key string, event_id string, decision string, label string"
    for i, r in enumerate([rows[8], rows[1], rows[8], rows[3]]):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/e")
    got = folds.latest_decisions(folds.read_table(spark, f"file://{tmp_path}/e", files=1)).collect()
    assert [(r.event_id, r.label) for r in got] == [("8", "L8")]
    events = spark.createDataFrame([("a", "k", 1, 0), ("a", "k", 2, 1)] + [("a", "k", 3 + i, 0) for i in range(14)], "site string, kind string, seq bigint, new int")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/y")
    r = folds.page_yield(folds.read_table(spark, f"file://{tmp_path}/y")).first()
    assert (r.read, r.hits, r.streak, r.closed) == (16, 1, 14, True)


def test_engine(spark):
    concepts = spark.createDataFrame([("c", "v", "Data Export", "feature", None, ["Exports"], None, None)], "id string, vertical_id string, preflabel string, kind string, definition string, altlabels array<string>, broader string, governs array<string>")
    e = Engine(concepts=concepts)
    pages = e.pages(spark.createDataFrame([("https://a.example", "<p>We offer data export as a module of the plan.</p>")], "url string, html string"))
    assert [(r.predicate, r.object) for r in e.page_graph(pages).collect()] == [("hasFeature", "c")]
    assert e.align(pages, "url").first().score == 100.0 and e.governance().first().tier == 50
    try:
        e.quads
        raise AssertionError
    except AttributeError:
        pass
    assert registry.GENERIC


def test_vocabulary_default_and_added_concepts(spark):
    from weftline.operators import alignment as A

    values = spark.createDataFrame([("v", "segments", "SMB", False), ("v", "segments", "found", True), ("w", "other", "x", False)], "group string, field string, value string, evidenced boolean")
    default = spark.createDataFrame([("segments", "Enterprise")], "field string, value string")
    got = {tuple(r) for r in A.vocabulary_or_default(values, default, "group").collect()}
    assert got == {("v", "segments", "SMB"), ("v", "segments", "Enterprise"), ("w", "other", "x"), ("w", "segments", "Enterprise")}
    have = spark.createDataFrame([("v", "data-export", "Data Export")], "vertical_id string, concept_id string, form string")
    new = spark.createDataFrame([("v", "data-EXPORT"), ("v", "Data/Export!"), ("v", "Zeta"), ("v", "zeta.")], "vertical_id string, label string")
    assert {(r.label, r.id, r.form_owner) for r in A.added_concepts(have, new).collect()} == {("data-EXPORT", None, "data-export"), ("Data/Export!", None, "data-export"), ("Zeta", "zeta", None), ("zeta.", "zeta-2", None)}
    jobs = spark.createDataFrame([("a", "running", None), ("b", "done", None)], "id string, status string, leased_at timestamp")
    assert [r.id for r in K.stale(jobs, F.current_timestamp(), 60).collect()] == ["a"]
    cache = spark.sql("select 'k' as key, 'c' as content, timestamp'2020-01-01' as stored_at union all select 'k', 'd', timestamp'2024-01-01'")
    assert [r.content for r in files.fresh(cache, F.lit("2024-01-01 00:00:30").cast("timestamp"), 60).collect()] == ["d"]

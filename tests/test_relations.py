"""The rules of relations against statements whose facts are known."""

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import buyers
from weftline.operators import knowledge as K
from weftline.operators import ontology as O
from weftline.operators import relations as R
from weftline.operators import site as S

TEXT = (
    "Lorka offers Automated Invoicing beside Subscription Management. Their clerks eliminate manual journal entries this way. Designed for Enterprise and High-Growth SaaS buyers. FinTech firms rely on it. "
    "This Cloud-Native, Multi-Tenant service is SOC 2 Type II certified, and ISO 27001 audits follow each spring. Developers get a REST API and Webhooks. Lorka is available in the United States and all of the European Union. "
    "A 99.99% uptime guarantee comes with 24/7 Support. Migrate from Zuora or Chargebee within days."
)


def facts(spark, text, vendor="Acme", rules=R.RULES, **more):
    docs = spark.createDataFrame([(1, text, vendor, "x")], "id int, text string, vendor string, object string")
    return {(r.predicate, r.object): (r.confidence, r.evidence) for r in R.relations(docs, "id", rules, vendor="vendor", **more).collect()}


def test_all_predicates(spark):
    got = facts(spark, TEXT)
    for fact in [
        ("hasFeature", "Automated Invoicing"), ("hasFeature", "Subscription Management"), ("replacesWorkflow", "Manual Journal Entries"), ("targetsSegment", "Enterprise"), ("targetsSegment", "High-Growth SaaS"), ("servesIndustry", "FinTech"),
        ("deployedAs", "Cloud-Native"), ("deployedAs", "Multi-Tenant"), ("certifiedBy", "SOC 2 Type II"), ("certifiedBy", "ISO 27001"), ("hasAPI", "REST API"), ("hasAPI", "Webhooks"), ("supportsLocale", "United States"), ("supportsLocale", "European Union"),
        ("guarantees", "99.99% Uptime"), ("guarantees", "24/7 Support"), ("competesAgainst", "Zuora"), ("competesAgainst", "Chargebee"), ("compliesWith", "SOC 2 Type II"),
    ]:
        assert fact in got, fact
    # Invoicing is a part of Automated Invoicing, SOC 2 of SOC 2 Type II, in one sentence
    assert ("automates", "Invoicing") not in got and ("compliesWith", "SOC 2") not in got
    assert got["compliesWith", "ISO 27001"][0] == 0.95 and got["hasFeature", "Automated Invoicing"][0] == 0.85


def test_shapes(spark):
    got = facts(spark, "Jane Roe, director of finance at Paubox Health, agrees. Acme case study. See the Lorka Bimex video case study. It streamlines the invoice approvals for all. It connects to Gorfast, Tandrel, Acme. It promises 99.95% uptime.")
    assert got["hasCustomer", "Paubox Health"][0] == 0.86 and got["automates", "Invoice Approvals"][0] == 0.8 and got["integratesWith", "Tandrel"][0] == 0.82 and got["guarantees", "99.95% Uptime"][0] == 0.9
    assert ("hasCustomer", "Acme") not in got and ("integratesWith", "Acme") not in got
    closed = facts(spark, "It connects to Gorfast, Tandrel, Zumek.", rules=R.with_terms(R.RULES, {"integrations": ("Zumek",)}), partners=False)
    assert set(closed) == {("integratesWith", "Zumek")}


def test_entities_and_seeds(spark):
    rows = [("Automated Invoicing", "Product Feature"), ("Mid-Market", "Customer Segment"), ("HealthTech", "Industry Vertical"), ("Cloud-Native", "Deployment Model"), ("ISO 27001", "Trust Certification"), ("GraphQL API", "API Standard"), ("United Kingdom", "Geographic Market"), ("99.9% Uptime", "SLA Commitment"), ("Recurly", "Competitor"), ("X", None), (None, "Competitor")]
    entities = spark.createDataFrame([(1, t, label) for t, label in rows], "id int, text string, label string")
    canonical = spark.createDataFrame([("automated invoicing", "Invoicing", "automates")], "form string, object string, predicate string")
    seeds = spark.createDataFrame([(1, "Payment Gateway", 2), (1, "SOC 1", 0), (1, "Other", 3)], "id int, concept string, count int")
    got = facts(spark, "Platform overview.", entities=entities, canonical=canonical, seeds=seeds)
    assert set(got) == {("automates", "Invoicing"), ("targetsSegment", "Mid-Market"), ("servesIndustry", "HealthTech"), ("deployedAs", "Cloud-Native"), ("certifiedBy", "ISO 27001"), ("hasAPI", "GraphQL API"), ("supportsLocale", "United Kingdom"), ("guarantees", "99.9% Uptime"), ("competesAgainst", "Recurly"), ("integratesWith", "Payment Gateways")}
    # what a rule read as a segment is no market
    read = facts(spark, "Made for Mid-Market buyers today.", entities=spark.createDataFrame([(1, "Mid-Market", "Geographic Market")], "id int, text string, label string"))
    assert set(read) == {("targetsSegment", "Mid-Market")}


def test_nulls_and_no_rows(spark):
    assert facts(spark, None) == {} and facts(spark, "") == {}
    assert facts(spark, "x" * 50_000 + " Zuora versus Recurly.", vendor=None)["competesAgainst", "Zuora"][0] == 0.8
    assert R.relations(spark.createDataFrame([], "id int, text string"), "id").count() == 0


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_scalar_rules(spark):
    for label, name in {"Pricing Model": "PricingModel", "PricingModel": "PricingModel", "Software Platform": "SoftwarePlatform", "integration_partner": "IntegrationPartner", "API Standard": "APIStandard", "SLA Commitment": "SLA", "Billing Feature": "Feature", "Product Feature": "Feature", "Accounting Standard": "Standard", "Geographic Market": "Place", "Customer Segment": "Segment", "": "Entity", None: "Entity"}.items():
        assert one(spark, label, K.canonical_class) == name, label
    for glued, plain in {"ByLorka BimexDecember 2, 2025": "By Lorka Bimex December 2, 2025", "ByTandrel ZuhaistJune 15, 2023 in May 2026Dental": "By Tandrel Zuhaist June 15, 2023 in May 2026 Dental", "Mara VukandCEO": "Mara Vukand CEO", "Piet SorbelSVP": "Piet Sorbel SVP", "BlogPer-Seat Plans": "Blog Per-Seat Plans", "": "", None: None}.items():
        assert one(spark, glued, T.repair_glued_words) == plain, glued
    for same in ("HubSpot", "QuickBooks", "ChurnZero", "LinkedIn", "DigitalOcean", "Bylaws", "Byways", "a MayFly note", "it came in 2025 and stayed"):
        assert one(spark, same, T.repair_glued_words) == same
    for entry, names in {"Maxio (formerly SaaSOptics)": ["maxio", "saasoptics"], "SaaSOptics / Maxio": ["saasoptics", "maxio"], "Maxio aka SaaSOptics": ["maxio", "saasoptics"], "Zuora, Inc.": ["zuora inc."], "AT&T  Corp": ["at&t corp"], "": []}.items():
        assert one(spark, entry, K.company_names) == names, entry
    for value, name in {"Revenue Recognition": "revenue_recognition", "ASC-606": "asc_606", "  ": "unnamed_concept", "--": "unnamed_concept", None: "unnamed_concept"}.items():
        assert one(spark, value, T.concept_id) == name, value
    for quote, ok in {"It posts every entry nightly.": True, "n/a": False, "not specified": False, "short": False, None: False}.items():
        assert one(spark, quote, T.is_quote) is ok, quote
    assert one(spark, "=1+1\r\n\nb", T.csv_safe) == "'=1+1  b" and one(spark, None, T.csv_safe) == ""
    assert one(spark, '../a "b"\r\nc.csv', T.safe_filename) == "a_b_c.csv" and one(spark, "--", T.safe_filename) == "report" and len(one(spark, "x" * 300, T.safe_filename)) == 100


def test_prompt_words(spark):
    for term, said in {"Approval Workflows": "approval workflows", "ASC 606 Compliance": "ASC 606 compliance", "QuickBooks invoicing": "QuickBooks invoicing", " SOC 2  Audit ": "SOC 2 audit", "": "", None: None}.items():
        assert one(spark, term, buyers.phrase) == said, term
    pairs = [("{subject} compliant billing", "ASC 606 Compliance", True), ("{subject} automation software", "AR Automation", True), ("how to comply with {subject}", "HR compliance", True), ("how to automate {subject}", "Dunning", False), ("{category} software with {subject}", "Expense Software", False), ("best tool", None, False)]
    df = spark.createDataFrame(pairs, "t string, s string, want boolean")
    assert [r.got for r in df.select(buyers.collides(F.col("t"), F.col("s")).alias("got")).collect()] == [p[2] for p in pairs]
    rows = spark.createDataFrame([("v", "Zuora", 1), ("v", "Recurly", 2), ("v", "Maxio", 3), ("w", "Solo", 1), ("v", " ", 2)], "g string, name string, ord int")
    assert sorted(r.text for r in buyers.head_to_head(rows, "g", "name", "ord").collect()) == ["Recurly vs Maxio", "Zuora vs Recurly"]


def test_ontology(spark):
    facts = spark.createDataFrame([("g", "Acme", "hasFeature", "Audit Trail", 0.9, "It has an audit trail."), ("g", "Acme", "automates", "audit-trail", 0.8, None), ("g", "Acme", "odd", "Thing", 0.5, None), ("g", "Acme", "odd", "--", 0.5, None), (None, "x", "odd", "y", 0.1, None)], "graph string, vendor string, predicate string, object string, confidence double, evidence string")
    got = {(r.s, r.p, r.o) for r in O.owl_of_relations(facts, "graph", "vendor").collect()}
    for q in [("onto:hasFeature", "owl:inverseOf", "onto:isFeatureOf"), ("onto:isFeatureOf", "rdfs:domain", "onto:ProductFeature"), ("onto:EnterprisePlatform", "owl:disjointWith", "onto:PricingModel"), ("onto:canonicalUrl", "rdfs:range", "xsd:anyURI"), ("onto:subCategoryOf", "rdf:type", "owl:TransitiveProperty"), ("onto:Acme", "rdf:type", "onto:EnterprisePlatform"), ("onto:Acme", "onto:hasFeature", "onto:AuditTrail"), ("onto:AuditTrail", "onto:evidenceSentence", "It has an audit trail."), ("onto:Acme", "schema:knowsAbout", "onto:Thing"), ("onto:Acme", "onto:automatesWorkflow", "onto:audittrail")]:
        assert q in got, q
    assert O.owl_of_relations(facts.limit(0), "graph", "vendor").count() == 0


def test_changed_labels(spark):
    k = spark.createDataFrame([("v", "c1", "Patient Planner", ["Old Form", None]), ("v", "c2", "Allergy Pairing", None)], "vertical_id string, id string, preflabel string, altlabels array<string>")
    approved = spark.createDataFrame([("v", " planner ", "patient planner"), ("v", "Planner", "Patient Planner"), ("v", "OLD form", "Patient Planner"), ("v", "Allergy Pairing", "Patient Planner"), ("v", None, "Patient Planner"), ("w", "x", "Patient Planner"), ("v", "Pairs", "Allergy Pairing")], "vertical_id string, surface string, canonical string")
    withdrawn = spark.createDataFrame([("v", "old FORM", "patient planner"), ("v", "never there", "Patient Planner")], "vertical_id string, surface string, canonical string")
    got = {r.id: r.altlabels for r in O.changed_labels(k, approved, withdrawn).collect()}
    assert got == {"c1": [None, "Planner"], "c2": ["Pairs"]}


def test_site_graphs(spark):
    k = spark.createDataFrame([("c1", "v", "Patient Planner", "feature", ["Planner Board"]), ("c2", "v", "Lease Routing", "process", None)], "id string, vertical_id string, preflabel string, kind string, altlabels array<string>")
    pages = spark.createDataFrame([("a.example", "https://a.example/1", "It includes Patient Planner for all wards. Lease routing runs nightly.", "v", 1), ("a.example", "https://a.example/2", "Our planner board is a feature that everybody on the wards likes.", "v", 1), ("a.example", "https://a.example/2", None, "v", 1), ("b.example", "https://b.example/", None, "v", 1), (None, "https://c.example/", "Lease routing is here too.", "v", 1)], "site string, url string, text string, vertical_id string, label int")
    entities = spark.createDataFrame([("Lease Routing", "lr"), ("Patient Planner", "p1"), ("patient planner", "p2")], "form string, id string")
    made = S.site_graphs(pages, k, F.lit("2025-06-01 12:00:00").cast("timestamp"), "https://onto.example/", entities)
    edges = {(r.source, r.predicate, r.target): (r.confidence, r.url) for r in made.edges.collect()}
    assert edges == {("a.example", "hasFeature", "c1"): (0.85, "https://a.example/2"), ("a.example", "automates", "lr"): (0.8, "https://a.example/1")}
    assert {(r.node, r.pages) for r in made.nodes.collect()} == {("c1", 2), ("lr", 1)}
    assert {(r.domain, r.metadata) for r in made.headers.collect()} == {("a.example", '{"pages_crawled":2,"nodes":2,"edges":2}'), ("b.example", '{"pages_crawled":1,"nodes":0,"edges":0}')}
    assert {r.graph_id for r in made.quads.select("graph_id").distinct().collect()} == {"https://a.example/audit/20250601T120000Z"}
    assert {(r.target_type, r.n) for r in made.schema.collect()} == {("Feature", 1), ("Process", 1)}


def test_ontology_finds_facts_once(spark):
    """Facts are made once however often they are read, and no quad is said twice where names meet."""
    made = spark.sparkContext.accumulator(0)

    def slow(text):
        made.add(1)
        return text

    rows = [("g", "EnterprisePlatform", "hasFeature", o, 0.9, "e") for o in ("Enterprise Platform", "hasFeature", "PricingModel", "Other")] + [("h", "EnterprisePlatform", "odd", "EnterprisePlatform", 0.9, None), ("i", None, "odd", "Platform", 0.5, None)]
    facts = spark.createDataFrame(rows, "graph string, vendor string, predicate string, object string, confidence double, evidence string")
    got = [tuple(r) for r in O.owl_of_relations(facts.withColumn("object", F.udf(slow)("object")), "graph", "vendor").collect()]
    assert made.value == len(rows)
    assert len(got) == len(set(got)) and {g for g, *_ in got} == {"g", "h", "i"}
    assert ("g", "onto:EnterprisePlatform", "rdfs:label", "Enterprise Platform", "literal") in got and ("i", "onto:Platform", "schema:knowsAbout", "onto:Platform", "uri") in got


def test_texts_are_read_once(spark):
    """Where every fact has its sentence, the texts are searched once."""
    docs = spark.createDataFrame([(1, TEXT)], "id int, text string")
    plan = R.relations(docs, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(") == 1


def test_counts_of_ontologies(spark):
    """Counts by predicate are those of the quads, also where vendors and objects are named like classes, properties and each other."""
    named = ["ProductFeature", "hasFeature", "Lorka", "--", "Data Export", "data export"]
    rows = [(g, v, p, o, 0.9, e) for g, v in (("a", "Lorka"), ("b", "CustomerSegment"), ("c", None), ("d", "!"), (None, "x")) for p in ("hasFeature", "targetsSegment", "hasCustomer") for o, e in zip(named, ("x", None) * 3)]
    facts = spark.createDataFrame([*rows, ("e", "Tandrel", "hasFeature", "--", 0.9, None), ("f", "hasFeature", "automates", "automatesWorkflow", 0.5, "y")], "graph string, vendor string, predicate string, object string, confidence double, evidence string")
    want = O.owl_of_relations(facts, "graph", "vendor").groupBy("graph_id", "p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))
    got = sorted(tuple(r) for r in O.owl_counts(facts, "graph", "vendor").collect())
    assert got == sorted(tuple(r) for r in want.collect()) and len({g[0] for g in got}) == 6
    assert O.owl_counts(facts.limit(0), "graph", "vendor").count() == 0

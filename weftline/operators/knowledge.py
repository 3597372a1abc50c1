"""Building and reading knowledge: classes, forms, governance, identities, grounding, exports and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from .registry import key as form_key

#: Names of classes that stand for another one (fixed values).
CLASS_NAMES = {
    "BillingFeature": "Feature", "ProductFeature": "Feature", "AccountingStandard": "Standard", "SecurityStandard": "Standard", "FinancialStandard": "Standard", "ComplianceStandard": "Standard",
    "BillingModel": "PricingModel", "PricingStructure": "PricingModel", "CustomerSegment": "Segment", "IndustryVertical": "Industry", "GeographicMarket": "Place", "SLACommitment": "SLA", "TrustCertification": "Certification",
}
#: Which property states a relation; others are knowsAbout (fixed values).
PROPERTIES = {"automates": "automates", "integratesWith": "integratesWith", "compliesWith": "compliesWith", "supportsPricingModel": "supportsPricingModel", "hasFeature": "hasFeature", "replacesWorkflow": "replacesWorkflow", "targetsSegment": "targetsSegment", "servesIndustry": "servesIndustry", "deployedAs": "deployedAs", "certifiedBy": "certifiedBy", "hasAPI": "hasAPI", "supportsLocale": "supportsLocale", "guarantees": "guarantees", "competesAgainst": "competesAgainst", "hasCustomer": "hasCustomer"}
#: What a relation points to, and whether it needs evidence (fixed values).
RELATIONS = (("automates", "process", True), ("hasFeature", "feature", True), ("compliesWith", "standard", True), ("supportsPricingModel", "pricing", True), ("covers", "domain", False))
#: Words around a name that make it a competitor or a customer (fixed values).
COMPETITOR_BEFORE = r"(?:alternatives?\s+to|vs\.?|versus|compar(?:e|es|ed|ing)\s+(?:to|with|against)|switch(?:ed|ing)?\s+from|migrat\w*\s+(?:away\s+)?from|mov(?:e|ed|ing)\s+(?:away\s+)?from|replac\w*|instead\s+of|leaving)"
COMPETITOR_AFTER = r"(?:alternatives?|vs\.?|versus|competitors?|comparison|migration)"
CUSTOMER_AFTER = r"(?:automates|scales|uses|used|chose|selected|switched|saved|cut|reduced|grew|case\s+study|customer\s+story)"


def canonical_class(c: Column) -> Column:
    """A label as one class name: the words between spaces, underscores and hyphens joined with a capital each, inner ones kept, then CLASS_NAMES; Entity for none."""
    words = F.split(F.coalesce(c, F.lit("")), r"[\s_\-]+")
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    known = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    return F.when(name == "", "Entity").otherwise(F.coalesce(F.try_element_at(known, name), name))


def phrase_forms(c: Column) -> Column:
    """The forms of a term in lower case: without examples in brackets, what stands outside and inside brackets each, & as and; three characters at least."""
    plain = F.regexp_replace(F.lower(c), r"\(e\.g\.[^)]*\)", "")
    outer = F.regexp_replace(plain, r"\([^)]*\)", " ")
    inner = F.regexp_extract(plain, r"\(([^)]*)\)", 1)
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "&", " and "), r"\s+", " "))
    return F.array_distinct(F.filter(F.transform(F.array(outer, inner), tidy), lambda x: F.length(x) >= 3))


def seed_parts(c: Column) -> Column:
    """A seed string read: (short, long, examples) of 'ABC (All Big Cats)' and 'Things (e.g., one, two)'."""
    inside = F.regexp_extract(c, r"\(([^)]*)\)", 1)
    outside = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    examples = inside.rlike(r"^e\.g\.")
    listed = F.filter(F.transform(F.split(F.regexp_replace(inside, r"^e\.g\.,?\s*", ""), r",\s*"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.when(outside.rlike("^[A-Z0-9]{2,6}$") & (inside != "") & ~examples, outside)
    return F.struct(short.alias("short"), F.when(short.isNotNull(), inside).otherwise(outside).alias("long"), F.when(examples, listed).otherwise(F.array().cast("array<string>")).alias("examples"))


def company_names(c: Column) -> Column:
    """The names in a company's entry in lower case: outside and inside brackets, before and after a slash, formerly, previously and aka; of each its letters, digits and & . + - with one space between words."""
    flat = F.lower(c)
    for typed, plain in (("[\u2018\u2019]", "'"), ("[\u201c\u201d]", '"'), ("[\u2013\u2014]", "-")):
        flat = F.regexp_replace(flat, typed, plain)
    parts = F.split(tx.collapse(flat), r"\s*(?:[()/]|\b(?:formerly|previously|aka)\b)\s*")
    named = F.transform(parts, lambda p: F.array_join(F.regexp_extract_all(p, F.lit("([a-z0-9&.+-]+)")), " "))
    return F.array_distinct(F.filter(named, lambda p: p != ""))


def role_of(name: Column, text: Column) -> Column:
    """Whether a text states that a name is a Competitor or a Customer, else null; competitors go first."""
    n = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    competitor = F.rlike(text, F.concat(F.lit(rf"(?i){COMPETITOR_BEFORE}\s+(?:the\s+)?"), n, F.lit(r"\b"))) | F.rlike(text, F.concat(F.lit(r"(?i)\b"), n, F.lit(rf"\s+{COMPETITOR_AFTER}\b")))
    customer = F.rlike(text, F.concat(F.lit(r"(?i)\b"), n, F.lit(rf"\s+{CUSTOMER_AFTER}\b")))
    return F.when(competitor, "Competitor").when(customer, "Customer")


def subject(site: Column, organisation: Column, title: Column, host: Column) -> Column:
    """Whom a page speaks for: its site's name, the organisation its data names, a part of the title equal to the brand of the host or of at most three words, the brand itself, else Platform."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    brand = urls.label(urls.registrable(host))
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s[-|–:·]\s"), lambda p: F.trim(p)), lambda p: p != "")
    named = F.get(F.filter(parts, lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]", "") == brand), F.lit(0))
    short = F.get(F.filter(parts, lambda p: F.size(F.split(p, r"\s+")) <= 3), F.lit(0))
    return F.coalesce(blank(site), blank(organisation), named, short, blank(F.initcap(brand)), F.lit("Platform"))


def concept_roles(concepts: DataFrame) -> DataFrame:
    """(vertical_id, id, role): standards and what governs others are rules, what others are narrower than is a grouping, else the kind."""
    heads = concepts.where(F.trim("broader") != "").select("vertical_id", F.trim("broader").alias("id"), F.lit(True).alias("head")).distinct()
    rule = (F.col("kind") == "standard") | (F.size(F.coalesce("governs", F.array())) > 0)
    return concepts.join(heads, ["vertical_id", "id"], "left").select("vertical_id", "id", F.when(rule, "rule").when(F.col("head"), "grouping").otherwise(F.col("kind")).alias("role"))


def governance(concepts: DataFrame) -> DataFrame:
    """(vertical_id, id, standards, defined, tier) of each concept: what governs it, and 100 where it is governed and defined, 75 where either, else 50."""
    rules = concepts.select("vertical_id", F.col("id").alias("standard"), F.explode("governs").alias("id")).groupBy("vertical_id", "id").agg(F.count_distinct("standard").alias("standards"))
    defined = F.coalesce(F.trim("definition") != "", F.lit(False))
    out = concepts.join(rules, ["vertical_id", "id"], "left").select("vertical_id", "id", F.coalesce("standards", F.lit(0)).alias("standards"), defined.alias("defined"))
    return out.withColumn("tier", F.when((F.col("standards") > 0) & F.col("defined"), 100).when((F.col("standards") > 0) | F.col("defined"), 75).otherwise(50))


def wiring(concepts: DataFrame) -> DataFrame:
    """(vertical_id, predicate, terms, wired): whether a vertical has terms for each relation."""
    spark = concepts.sparkSession
    relations = spark.createDataFrame(list(RELATIONS), "predicate string, kind string, evidence boolean")
    verticals = concepts.select("vertical_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for _, k, _ in RELATIONS])))
    counts = concepts.groupBy("vertical_id", "kind").agg(F.count(F.lit(1)).alias("terms"))
    wired = verticals.join(relations, "kind").join(counts, ["vertical_id", "kind"], "left")
    return wired.select("vertical_id", "predicate", F.coalesce("terms", F.lit(0)).alias("terms"), F.col("terms").isNotNull().alias("wired"))


def first_seen(identities: DataFrame, site: str, page: str) -> DataFrame:
    """(site, identity, page): the first page of each site that shows an identity, which is what that page adds."""
    return identities.groupBy(site, "identity").agg(F.min(page).alias(page))


def grounded(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, entry): phrases with the one entry whose key they have, null where none or several have it. ``known`` has form and id."""
    keyed = known.select(form_key(F.col("form")).alias("k"), "id").where(F.col("k") != "").groupBy("k").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    asked = phrases.select("phrase").distinct().withColumn("k", form_key(F.col("phrase")))
    return asked.join(keyed.where(F.col("n") == 1), "k", "left").select("phrase", F.col("id").alias("entry"))


def rdf_of_triples(triples: DataFrame, base: str) -> DataFrame:
    """Quads of triples (graph_id, subject, predicate, object, evidence, url): each distinct triple with its property, and a statement about it where there is evidence."""
    one = triples.groupBy("graph_id", "subject", "predicate", "object").agg(F.min(F.struct("evidence", "url")).alias("e"))
    prop = F.lit("knowsAbout")
    for name, p in PROPERTIES.items():
        prop = F.when(F.col("predicate") == name, p).otherwise(prop)
    s, o = F.concat(F.lit(base), tx.slug(F.col("subject"))), F.concat(F.lit(base), tx.slug(F.col("object")))
    claim = F.concat(F.lit(base + "claim/"), F.substring(F.sha1(F.concat_ws("|", s, prop, o, F.col("e.url"))), 1, 20))
    quad = lambda a, p, b, kind: F.struct(a.alias("s"), F.lit("uri").alias("s_kind"), p.alias("p"), b.alias("o"), F.lit(kind).alias("o_kind"))
    told = F.col("e.evidence").isNotNull()
    made = F.array(
        quad(s, F.concat(F.lit(base), prop), o, "uri"), quad(s, F.lit("rdfs:label"), F.col("subject"), "literal"), quad(o, F.lit("rdfs:label"), F.col("object"), "literal"), F.when(told, quad(claim, F.lit("rdf:type"), F.lit("rdf:Statement"), "uri")), F.when(told, quad(claim, F.lit("rdf:object"), o, "uri")),
        F.when(told, quad(claim, F.lit("prov:value"), F.col("e.evidence"), "literal")), F.when(told & F.col("e.url").isNotNull(), quad(claim, F.lit("prov:wasDerivedFrom"), F.col("e.url"), "uri")),
    )
    return one.select("graph_id", F.explode(F.filter(made, lambda q: q.isNotNull())).alias("q")).select("graph_id", "q.*").distinct()


def owl_of_concepts(concepts: DataFrame, base: str) -> DataFrame:
    """Schema quads of a vocabulary: a class per kind, an individual per concept with label, class and broader, and domain and range of each relation."""
    iri = lambda c: F.concat(F.lit(base), c)
    quad = lambda g, a, p, b, kind: F.struct(g.alias("graph_id"), a.alias("s"), F.lit(p).alias("p"), b.alias("o"), F.lit(kind).alias("o_kind"))
    g, me = iri(F.col("vertical_id")), iri(F.col("id"))
    cls = iri(canonical_class(F.col("kind")))
    own = F.array(quad(g, cls, "rdf:type", F.lit("owl:Class"), "uri"), quad(g, me, "rdf:type", cls, "uri"), quad(g, me, "rdfs:label", F.col("preflabel"), "literal"), F.when(F.trim("broader") != "", quad(g, me, "skos:broader", iri(F.trim("broader")), "uri")))
    return concepts.select(F.explode(F.filter(own, lambda q: q.isNotNull())).alias("q")).select("q.*").distinct()


def same_as(entities: DataFrame) -> DataFrame:
    """(alias, id): links of the aliases' slugs to their entry's, an entry's own slug left out."""
    each = entities.select("id", tx.slug(F.col("preflabel")).alias("own"), F.explode("aliases").alias("a"))
    return each.where(F.trim("a.form") != "").select(tx.slug(F.col("a.form")).alias("alias"), "id", "own").where(F.col("own").isNull() | (F.col("alias") != F.col("own"))).select("alias", "id").distinct()


def best_of(rows: DataFrame, keys: list[str], score: str, rest: list[str]) -> DataFrame:
    """Each key once with its highest score, and the smallest rest on a tie."""
    return rows.groupBy(*keys).agg(F.max(score).alias(score), F.min_by(F.struct(*rest), F.struct(-F.col(score), *rest)).alias("r")).select(*keys, score, "r.*")


def merged_sets(existing: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Rows (name, status, domain) after an upsert by name, case ignored: confirmed and removed ones stay as they are, others take what was found."""
    low = lambda df: df.withColumn("__k", F.lower(F.trim(name)))
    a, b = low(existing).alias("a"), low(found).groupBy("__k").agg(F.min(F.struct(name, "status", "domain")).alias("f"))
    joined = a.join(b, "__k", "full_outer")
    keep = F.col("a.status").isin("confirmed", "removed")
    pick = lambda c: F.when(F.coalesce(keep, F.lit(False)), F.col(f"a.{c}")).otherwise(F.coalesce(F.col(f"f.{c}"), F.col(f"a.{c}")))
    return joined.select(F.coalesce(F.col(f"a.{name}"), F.col(f"f.{name}")).alias(name), pick("status").alias("status"), pick("domain").alias("domain"))


def competitors(names: DataFrame, registry: DataFrame, links: DataFrame) -> DataFrame:
    """(name, domain, rung): a named company's domain from the one registry entry of that name, else from the one linked host whose first label is the name, else pending. ``registry`` has form, domain; ``links`` host."""
    asked = names.select("name").distinct().withColumn("label", F.regexp_replace(F.lower("name"), "[^a-z0-9]", ""))
    known = registry.select(F.regexp_replace(F.lower("form"), "[^a-z0-9]", "").alias("label"), F.lower(F.trim("domain")).alias("d")).where((F.col("label") != "") & (F.col("d") != "")).groupBy("label").agg(F.count_distinct("d").alias("n"), F.min("d").alias("rd")).where(F.col("n") == 1).drop("n")
    hosts = links.where(F.col("host").isNotNull()).select(urls.label(F.col("host")).alias("label"), "host").groupBy("label").agg(F.count_distinct("host").alias("n"), F.min("host").alias("ld")).where(F.col("n") == 1).drop("n")
    out = asked.join(known, "label", "left").join(hosts, "label", "left")
    return out.select("name", F.coalesce("rd", "ld").alias("domain"), F.when(F.col("rd").isNotNull(), "registry").when(F.col("ld").isNotNull(), "link").otherwise("pending").alias("rung"))


def export_order(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes (graph_id, name, grounded, mentions) with ``place``: grounded ones first, then by mentions, then by name; the first ``limit`` of each graph."""
    order = [F.desc(F.col("grounded").cast("int")), F.desc("mentions"), F.lower("name"), F.col("name")]
    out = nodes.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)))
    return out if limit is None else out.where(F.col("place") <= limit)


def page_summary(edges: DataFrame, key: str) -> DataFrame:
    """(key, predicates, counts, n_objects, n_edges): distinct predicates in order, how often each, distinct objects and all edges."""
    per = edges.groupBy(key, "predicate").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("predicate")), ",").alias("predicates"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "predicate", "n"))), ",").alias("counts"))
    return counts.join(edges.groupBy(key).agg(F.count_distinct("object").alias("n_objects"), F.count(F.lit(1)).alias("n_edges")), key)


def stale(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Jobs (…, status, leased_at) that may be taken up: running ones whose lease is older than ``seconds`` or was never taken."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("leased_at").cast("timestamp"))
    return jobs.where((F.col("status") == "running") & (F.col("leased_at").isNull() | (age >= seconds)))


def unsent(proposed: DataFrame, queued: DataFrame, key: str) -> DataFrame:
    """Proposals whose key is not queued yet, whatever its status, each key once."""
    return proposed.join(queued.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def event_ids(events: DataFrame, time: str, order: str) -> DataFrame:
    """Events with ``event_id``: milliseconds, the number within them and a hash, so that the order of ids is the order of events."""
    number = F.row_number().over(Window.partitionBy("__ms").orderBy(order)) - 1
    rows = events.withColumn("__ms", F.unix_millis(F.col(time).cast("timestamp")))
    return rows.withColumn("event_id", F.format_string("%013d-%05d-%08x", "__ms", number.cast("int"), F.crc32(F.col(order).cast("string")))).drop("__ms")

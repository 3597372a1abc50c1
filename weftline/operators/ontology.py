"""The formal ontology of relations: classes, properties with their inverses, and the individuals that facts name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from .extraction import EVIDENCE

#: Classes with what they are (fixed values).
CLASSES = {
    "EnterprisePlatform": "Root SaaS or enterprise business platform entity", "PlatformCapability": "Core automated feature, workflow, or architectural service", "SoftwareIntegration": "External enterprise application or ecosystem integration",
    "ComplianceStandard": "Regulatory, accounting, or security compliance framework", "PricingModel": "Commercial monetization, billing, or pricing structure", "TopicAuthorityHub": "Canonical topic cluster landing page anchoring topical authority",
    "ProductFeature": "Specific discrete functional feature of the platform", "LegacyWorkflow": "Manual or legacy business process replaced by the platform", "CustomerSegment": "Target enterprise or market demographic segment",
    "IndustryVertical": "Industry market sector served by the software", "DeploymentModel": "Infrastructure deployment or hosting architecture", "TrustCertification": "Audited security, privacy, or trust certification",
    "APIStandard": "Developer API or programmatic interface protocol", "GeographicMarket": "Geographic locale or regional market supported", "SLAGuarantee": "Contractual uptime or reliability SLA commitment", "CompetitorEntity": "Direct or indirect industry competitor organization",
}
#: Classes that share no individual (fixed values).
DISJOINT = (
    ("EnterprisePlatform", "PlatformCapability"), ("EnterprisePlatform", "ComplianceStandard"), ("EnterprisePlatform", "PricingModel"), ("EnterprisePlatform", "TopicAuthorityHub"), ("PlatformCapability", "ComplianceStandard"), ("PlatformCapability", "PricingModel"),
    ("PlatformCapability", "TopicAuthorityHub"), ("ComplianceStandard", "PricingModel"), ("EnterprisePlatform", "CompetitorEntity"), ("CustomerSegment", "IndustryVertical"), ("DeploymentModel", "PricingModel"),
)
#: Predicate, property, inverse and class of the object; the subject is an EnterprisePlatform (fixed values).
PROPERTIES = (
    ("automates", "automatesWorkflow", "isAutomatedBy", "PlatformCapability"), ("integratesWith", "integratesWithSystem", "isIntegratedInto", "SoftwareIntegration"), ("compliesWith", "compliesWithStandard", "isCompliedWithBy", "ComplianceStandard"),
    ("supportsPricingModel", "supportsPricingArchitecture", "isPricingModelOf", "PricingModel"), ("", "anchorsTopicHub", "isTopicHubOf", "TopicAuthorityHub"), ("hasFeature", "hasFeature", "isFeatureOf", "ProductFeature"), ("replacesWorkflow", "replacesWorkflow", "isReplacedBy", "LegacyWorkflow"),
    ("targetsSegment", "targetsSegment", "isTargetedBy", "CustomerSegment"), ("servesIndustry", "servesIndustry", "isServedBy", "IndustryVertical"), ("deployedAs", "deployedAs", "isDeploymentModelOf", "DeploymentModel"), ("certifiedBy", "certifiedBy", "certifies", "TrustCertification"),
    ("hasAPI", "hasAPI", "isAPIOf", "APIStandard"), ("supportsLocale", "supportsLocale", "isLocaleSupportedBy", "GeographicMarket"), ("guarantees", "guarantees", "isGuaranteedBy", "SLAGuarantee"), ("competesAgainst", "competesAgainst", "competesWith", "CompetitorEntity"),
)
#: What a predicate without a property of its own states, and of what.
OTHER = ("schema:knowsAbout", "PlatformCapability")
_TYPE = "rdf:type"


def schema_rows() -> list[tuple[str, str, str, str]]:
    """(s, p, o, o_kind) of the classes and properties, local names behind ``onto:``."""
    own = lambda name: f"onto:{name}"
    rows = []
    for name, about in CLASSES.items():
        rows += [(own(name), _TYPE, "owl:Class", "uri"), (own(name), "rdfs:label", name, "literal"), (own(name), "rdfs:comment", about, "literal")]
    rows += [(own(a), "owl:disjointWith", own(b), "uri") for a, b in DISJOINT]
    for _, name, inverse, kind in PROPERTIES:
        for p, q, domain, to in ((name, inverse, "EnterprisePlatform", kind), (inverse, name, kind, "EnterprisePlatform")):
            rows += [(own(p), _TYPE, "owl:ObjectProperty", "uri"), (own(p), "rdfs:domain", own(domain), "uri"), (own(p), "rdfs:range", own(to), "uri"), (own(p), "owl:inverseOf", own(q), "uri")]
    rows += [(own("subCategoryOf"), _TYPE, t, "uri") for t in ("owl:ObjectProperty", "owl:TransitiveProperty")]
    for p, kind in (("evidenceSentence", "xsd:string"), ("canonicalUrl", "xsd:anyURI")):
        rows += [(own(p), _TYPE, "owl:DatatypeProperty", "uri"), (own(p), "rdfs:range", kind, "uri")]
    return rows


def local_name(c: Column) -> Column:
    """A text as the name of an individual: its letters and digits."""
    return F.regexp_replace(c, "[^a-zA-Z0-9]+", "")


def _listed() -> list[tuple[str, str, str, str]]:
    return list(dict.fromkeys(schema_rows()))


def _facts(facts: DataFrame, graph: str, vendor: str) -> DataFrame:
    return facts.where(F.col(graph).isNotNull()).select(F.col(graph).alias("graph_id"), F.col(vendor).alias("vendor"), "predicate", "object", "confidence", F.substring("evidence", 1, EVIDENCE).alias("evidence"), local_name(F.col("object")).alias("name"))


def _best() -> Column:
    return F.min_by(F.struct("predicate", "object", "evidence"), F.struct(-F.col("confidence"), "predicate", "object")).alias("f")


def _me() -> Column:
    return F.concat(F.lit("onto:"), F.coalesce(F.nullif(local_name(F.col("vendor")), F.lit("")), F.lit("Platform")))


def _quads() -> tuple[Column, Column, Column]:
    """The quads (s, p, o, o_kind) of the classes and properties, those of a graph's platform (me, vendor), and those of an individual (me, vendor, name, f), each once: the second without the first, the third without both."""
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("s", "p", "o", "o_kind"), r)]) for r in _listed()])
    quad = lambda s, p, o, kind: F.struct(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    named = F.array(quad(F.col("me"), _TYPE, F.lit("owl:NamedIndividual"), "uri"), quad(F.col("me"), _TYPE, F.lit("onto:EnterprisePlatform"), "uri"), F.when(F.col("vendor").isNotNull(), quad(F.col("me"), "rdfs:label", F.col("vendor"), "literal")))
    prop, kind = F.lit(OTHER[0]), F.lit("onto:" + OTHER[1])
    for predicate, name, _, to in PROPERTIES:
        if predicate:
            prop, kind = F.when(F.col("f.predicate") == predicate, f"onto:{name}").otherwise(prop), F.when(F.col("f.predicate") == predicate, f"onto:{to}").otherwise(kind)
    it = F.concat(F.lit("onto:"), "name")
    made = F.array(
        quad(it, _TYPE, F.lit("owl:NamedIndividual"), "uri"), quad(it, _TYPE, kind, "uri"), quad(it, "rdfs:label", F.col("f.object"), "literal"), quad(F.col("me"), prop, it, "uri"),
        F.when(F.col("f.evidence").isNotNull(), quad(it, "onto:evidenceSentence", F.col("f.evidence"), "literal")),
    )
    # the classes and properties are different quads, and so are those of different individuals: only a vendor or an
    # individual named like a class or property, and an individual named like the vendor, can say something twice
    taken = sorted({r[0].removeprefix("onto:") for r in schema_rows()})
    platforms = F.when(F.col("me").isin(*[f"onto:{t}" for t in taken]), F.array_except(F.array_compact(named), listed)).otherwise(F.array_compact(named))
    own = F.when(F.col("name").isin(*taken), F.array_except(F.array_compact(made), listed)).otherwise(F.array_compact(made))
    own = F.when(it == F.col("me"), F.array_except(own, F.array_compact(named))).otherwise(own)
    return listed, platforms, own


def owl_of_relations(facts: DataFrame, graph: str, vendor: str) -> DataFrame:
    """(graph_id, s, p, o, o_kind): the ontology of each graph of facts (graph, vendor, predicate, object, confidence, evidence).

    Every graph has the classes and properties, its vendor as the platform, and
    an individual for each object: of objects with one name the fact of the greatest confidence stands, then
    the one first by predicate and object. Objects and graphs without a letter or digit
    give no individual; a vendor without one is called Platform.
    """
    spark = facts.sparkSession
    # facts may cost much to find, and are read for the vendors and for the individuals
    rows = Scratch(spark, "ontology").keep(_facts(facts, graph, vendor))
    platform = rows.groupBy("graph_id").agg(F.min("vendor").alias("vendor")).withColumn("me", _me())
    best = rows.where("name <> ''").groupBy("graph_id", "name").agg(_best())
    # a row without a name stands for the graph itself, so that a graph's quads are made in one place and need no shuffle
    best = best.unionByName(platform.select("graph_id"), allowMissingColumns=True).join(platform, "graph_id")
    listed, platforms, own = _quads()
    return best.select("graph_id", F.explode(F.when(F.col("name").isNull(), F.concat(listed, platforms)).otherwise(own)).alias("q")).select("graph_id", "q.*")


def owl_counts(facts: DataFrame, graph: str, vendor: str) -> DataFrame:
    """(graph_id, p, n, subjects): the quads of owl_of_relations and their different subjects, counted by predicate in each graph.

    The classes and properties are the same quads in every graph, so they are
    counted once and not made for each; a subject among them that a graph's own quads have too counts
    once. Facts are read once, and those of a graph are counted where they are if they are together.
    """
    rows = _facts(facts, graph, vendor)
    best = rows.groupBy("graph_id", "name").agg(_best(), F.min("vendor").alias("vendor"))
    by_name = Window.partitionBy("graph_id").orderBy("name")
    whole = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = best.select("graph_id", "name", "f", F.min("vendor").over(whole).alias("vendor"), F.row_number().over(by_name).alias("nth")).withColumn("me", _me())
    _, platforms, own = _quads()
    schema = _listed()
    subjects_of = {p: sorted({r[0] for r in schema if r[1] == p}) for p in dict.fromkeys(r[1] for r in schema)}
    known = F.lit(False)
    for p, subjects in subjects_of.items():
        known = known | ((F.col("p") == p) & F.col("s").isin(*subjects))
    # each graph's first row brings the platform's quads and the schema's counts, which have no subject
    row = lambda p, s, n, k: F.struct(p.alias("p"), s.cast("string").alias("s"), F.lit(n).cast("bigint").alias("n"), F.lit(k).cast("bigint").alias("schema"))
    none = F.array().cast("array<struct<p:string,s:string,n:bigint,schema:bigint>>")
    counts = F.array(*[row(F.lit(p), F.lit(None), sum(r[1] == p for r in schema), len(subjects)) for p, subjects in subjects_of.items()])
    _, platforms, own = _quads()
    one = lambda q: row(q["p"], q["s"], 1, 0)
    each = F.concat(F.when(F.col("nth") == 1, F.concat(counts, F.transform(platforms, one))).otherwise(none), F.when(F.col("name") != "", F.transform(own, one)).otherwise(none))
    made = best.select("graph_id", F.explode(each).alias("q")).select("graph_id", "q.*")
    by_subject = made.groupBy("graph_id", "p", "s").agg(F.sum("n").alias("n"), F.max("schema").alias("schema"))
    new = F.when(F.col("s").isNull() | known, 0).otherwise(1)
    return by_subject.groupBy("graph_id", "p").agg(F.sum("n").alias("n"), F.sum(F.col("schema") + new).alias("subjects"))


def changed_labels(concepts: DataFrame, approved: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(vertical_id, id, altlabels): the concepts with the surface forms that reviewers approved and without those they withdrew.

    Both have vertical_id, surface and canonical, the concept's label, compared
    without case and outer spaces. A form that the concept has, or that is its
    label or another concept's label of the vertical, is not added; what is withdrawn
    goes whether it was approved or there before. Labels stay in order, new
    ones behind in order of their spelling; of a form in two spellings the first by code point.
    """
    low = lambda c: F.lower(F.trim(c))
    said = lambda df: df.select("vertical_id", low("canonical").alias("label"), F.trim("surface").alias("form"), low("surface").alias("key")).where("label <> '' and key <> ''")
    labels = concepts.select("vertical_id", low("preflabel").alias("key")).distinct().withColumn("taken", F.lit(True))
    new = said(approved).join(labels, ["vertical_id", "key"], "left").where(F.col("taken").isNull()).groupBy("vertical_id", "label", "key").agg(F.min("form").alias("form"))
    # what reviewers say of one concept is bounded by what they write
    new = new.groupBy("vertical_id", "label").agg(F.sort_array(F.collect_list("form")).alias("new"))
    gone = said(withdrawn).groupBy("vertical_id", "label").agg(F.collect_set("key").alias("gone"))
    none = F.array().cast("array<string>")
    rows = concepts.withColumn("label", low("preflabel")).join(new, ["vertical_id", "label"], "left").join(gone, ["vertical_id", "label"], "left")
    old = F.coalesce("altlabels", none)
    held = F.transform(old, low)
    added = F.filter(F.coalesce("new", none), lambda f: ~F.coalesce(F.array_contains(held, low(f)), F.lit(False)))
    return rows.select("vertical_id", "id", F.filter(F.concat(old, added), lambda f: ~F.coalesce(F.array_contains(F.coalesce("gone", none), low(f)), F.lit(False))).alias("altlabels"))

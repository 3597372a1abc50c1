"""What sentences state about the vendor a page speaks for, by a table of rules.

A rule names a predicate, the terms it looks for, the cues its sentence may or
must have and a confidence. Open rules take their object from the shape of the
sentence instead of a list. Entities that a recogniser labelled and seed
concepts add to what the rules found and never contradict it. The first
evidence of a fact stands: by step, then sentence, then rule, then place in
the list; of two facts that one sentence proves, one whose object is a part of
the other's is left out.

All of it is expressions over sentences: the rule table is a literal, and what
is shuffled are facts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extraction import EVIDENCE, OBJECT, sentences

# Lists of terms that rules look for where a vertical has none of its own (fixed values).
INTEGRATIONS = ("Salesforce", "NetSuite", "QuickBooks", "Stripe", "Workday", "HubSpot", "Sage Intacct", "Sage", "Xero", "Avalara", "TaxJar", "SAP", "Oracle", "Zendesk", "Slack", "Plaid", "Datadog", "Snowflake", "Microsoft Dynamics")
COMPLIANCE = ("ASC 606", "IFRS 15", "SOC 1", "SOC 2", "SOC 2 Type II", "SOC 1 Type II", "GAAP", "US GAAP", "GDPR", "PCI-DSS", "ISO 27001", "HIPAA", "CCPA")
PRICING = ("Usage-Based Pricing", "Subscription Pricing", "Consumption-Based Pricing", "Transaction Pricing", "Hybrid Pricing", "Tiered Pricing", "Per-Seat Pricing", "Recurring Billing", "Dynamic Pricing", "Flat-Fee Pricing", "Overage Pricing", "Milestone-Based Billing")
AUTOMATION = ("Billing Automation", "Revenue Recognition", "Accounts Receivable", "Invoicing", "Payment Collection", "Dunning Automation", "Contract Modifications", "Order-to-Revenue Cycle", "Revenue Operations", "Deferred Revenue Schedules", "Invoice Calculations", "Subscription Billing")
FEATURES = ("Automated Invoicing", "Revenue Recognition Automation", "Dunning Management", "Subscription Management", "Contract Management", "Quote-to-Cash", "Real-Time Analytics", "Revenue Forecasting", "Multi-Currency Support", "Audit Trail", "Role-Based Access Control", "Single Sign-On", "Custom Reporting", "API Access", "Webhook Support", "Self-Serve Portal", "Bulk Operations", "Data Export")
SEGMENTS = ("Enterprise", "Mid-Market", "SMB", "Startups", "Scale-ups", "Public Companies", "Private Companies", "PE-Backed Companies", "High-Growth SaaS", "B2B SaaS", "B2C Companies", "Finance Teams", "Revenue Operations Teams", "Accounting Teams")
INDUSTRIES = ("SaaS", "FinTech", "HealthTech", "EdTech", "MarTech", "Insurance", "Financial Services", "Healthcare", "Media", "Telecommunications", "E-Commerce", "Professional Services", "Manufacturing", "Real Estate", "Energy")
DEPLOYMENT = ("Cloud-Native", "SaaS", "On-Premise", "Hybrid Cloud", "Multi-Tenant", "Single-Tenant", "Private Cloud", "Serverless", "Containerized", "Docker", "Kubernetes")
CERTIFICATIONS = ("SOC 2 Type II", "SOC 1 Type II", "ISO 27001", "PCI-DSS", "HIPAA", "GDPR", "CCPA", "FedRAMP", "CSA STAR", "NIST", "SSAE 18", "ISAE 3402")
API_TYPES = ("REST API", "GraphQL API", "SOAP API", "Webhooks", "OpenAPI", "Swagger", "OAuth 2.0", "SAML", "SCIM", "EDI", "CSV Import", "SDK")
LOCALES = ("United States", "United Kingdom", "European Union", "Canada", "Australia", "India", "Singapore", "Japan", "Germany", "France", "Global", "Multi-Language", "Multi-Currency")
SLA = ("99.9% Uptime", "99.99% Uptime", "24/7 Support", "99.5% Uptime", "SLA-Backed Uptime", "Zero Downtime Deployments", "Disaster Recovery", "Data Redundancy", "Real-Time Backup")
REPLACES = ("Manual Spreadsheets", "Excel-Based Reporting", "Manual Journal Entries", "Manual Revenue Calculations", "Manual Invoice Generation", "Email-Based Approvals", "Manual Reconciliation", "Legacy ERP Workarounds", "Manual Dunning", "Manual Contract Amendments")
COMPETITORS = ("Zuora", "Chargebee", "Recurly", "Maxio", "Stripe Billing", "Salesforce Revenue Cloud", "NetSuite Billing", "Sage Intacct", "Paddle", "FastSpring", "Chargify", "Aria Systems", "SAP Billing", "Oracle Subscription Management")
CUSTOMERS: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """step orders the rules; cues must (gate) or may (else ``uncued`` is the confidence) stand in the sentence, none of ``unless``, and one of ``beside``; a term counts as whole words or anywhere, and always where one of ``instead`` stands."""

    step: int
    predicate: str
    terms: tuple[str, ...]
    confidence: float
    cues: tuple[str, ...] = ()
    uncued: float | None = None
    whole: bool = False
    unless: tuple[str, ...] = ()
    beside: tuple[str, ...] = ()
    instead: tuple[str, ...] = ()
    #: the vertical's list that replaces the terms
    field: str = ""


_CONNECT = ("integrate", "integrates", "integration", "integrations", "connect", "connects", "sync", "syncs", "built for", "works with", "native")
#: The rules with their cues and confidences (fixed values).
RULES = (
    Rule(1, "automates", AUTOMATION, 0.90, ("automate", "automates", "automating", "automated", "streamline", "streamlines", "effortless", "liberate", "replaces spreadsheet"), 0.80, True, field="automation"),
    Rule(2, "integratesWith", INTEGRATIONS, 0.90, _CONNECT, whole=True, field="integrations"),
    Rule(2, "integratesWith", INTEGRATIONS[:5], 0.85, ("partner", "connect", "sync", "api", "ecosystem"), whole=True, unless=_CONNECT, field="integrations"),
    Rule(3, "compliesWith", COMPLIANCE, 0.95, whole=True, field="compliance"),
    Rule(4, "supportsPricingModel", PRICING, 0.90, field="pricing"),
    Rule(5, "hasFeature", FEATURES, 0.85, ("feature", "features", "capability", "capabilities", "includes", "offers", "provides", "built-in", "native"), 0.78, True, field="features"),
    Rule(6, "replacesWorkflow", REPLACES, 0.85, ("replace", "replaces", "eliminate", "eliminates", "no more", "ditch", "stop using", "get rid of", "instead of", "without"), instead=("spreadsheet", "excel", "manual", "journal entr"), field="replaces"),
    Rule(6, "replacesWorkflow", ("Manual Processes",), 0.80, ("eliminate", "automate", "replace", "no longer"), beside=("manual", "spreadsheet", "excel"), instead=("",)),
    Rule(7, "targetsSegment", SEGMENTS, 0.85, ("for", "built for", "designed for", "serving", "ideal for", "tailored for", "made for", "focused on"), field="segments"),
    Rule(8, "servesIndustry", INDUSTRIES, 0.85, field="industries"),
    Rule(9, "deployedAs", DEPLOYMENT, 0.85, ("deployed", "deployment", "hosted", "available as", "delivered as", "runs on", "infrastructure"), field="deployment"),
    Rule(9, "deployedAs", ("Cloud-Native", "SaaS", "Multi-Tenant"), 0.80),
    Rule(10, "certifiedBy", CERTIFICATIONS, 0.92, whole=True, field="certifications"),
    Rule(11, "hasAPI", API_TYPES, 0.88, ("api", "integration", "connect", "developer", "sdk", "webhook", "endpoint"), field="api_types"),
    Rule(12, "supportsLocale", LOCALES, 0.82, ("available in", "supports", "operates in", "headquartered", "global", "international", "localized"), field="locales"),
    Rule(13, "guarantees", SLA, 0.88, ("uptime", "sla", "guarantee", "reliability", "availability", "support", "downtime"), field="sla"),
    Rule(14, "competesAgainst", COMPETITORS, 0.80, ("versus", "vs", "compared to", "unlike", "alternative to", "switch from", "migrate from", "better than", "competitor"), whole=True, field="competitors"),
    Rule(15, "hasCustomer", CUSTOMERS, 0.85, ("customer", "customers", "case study", "success story", "testimonial", "trusted by", "used by", "director of", "cfo of"), whole=True, field="customers"),
)
#: A pricing model counts by its bare name too where one of these stands (fixed values).
PRICING_CUES = ("pricing", "bill", "billing", "model", "monetiz", "monetize", "plans")
#: The shapes of sentences that name an object outside every list (fixed values).
UPTIME = r"(\d{2,3}\.?\d*\s*%\s*uptime)"
AT_COMPANY = r"(?i:\b(?:director|vp|vice president|head|chief|cfo|ceo|coo|cto|controller|manager|founder|owner)\b[^,.\n]{0,44}?\bat\s+)([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})"
AT_WORDS = ("director", "vp", "vice president", "head", "chief", "cfo", "ceo", "coo", "cto", "controller", "manager", "founder", "owner")
CASE_STUDY = r"\b([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,2})\s+(?i:(?:video\s+)?case study)\b"
AUTOMATES = r"(?i)\b(?:automates?|automating|streamlines?)\s+([a-zA-Z0-9\-\s]{4,40}?)(?:\s+(?:for|across|in|with|to|and\s+eliminates|\.|\,|$))"
CONNECTS = r"(?i)\b(?:integrates?\s+with|native\s+integration\s+with|connects?\s+to)\s+([A-Z][\w\.\-]+(?:\s+[A-Z][\w\.\-]+)?(?:\s*,\s*[A-Z][\w\.\-]+(?:\s+[A-Z][\w\.\-]+)?)*(?:\s+and\s+[A-Z][\w\.\-]+(?:\s+[A-Z][\w\.\-]+)?)?)"
_ENDS = "^[ ,.:\\-\n\t\"']+|[ ,.:\\-\n\t\"']+$"
_FILLERS = ("the", "all", "your", "our", "their", "and", "or", "a", "an")
_NO_PARTNERS = ("the", "all", "your", "our", "seamlessly", "easily")
#: What a recogniser's label states, with its confidence (fixed values).
LABELS = {
    ("integratesWith", 0.88): ("Integration Partner", "Ecosystem Integration", "Healthcare Integration", "HR Integration"),
    ("compliesWith", 0.92): ("Accounting Standard", "Security Standard", "Compliance Regulation", "Financial Standard", "Medical Standard", "HR Compliance"),
    ("supportsPricingModel", 0.88): ("Pricing Model", "Pricing Structure", "Billing Model"),
    ("automates", 0.88): ("Automation Workflow",),
    ("hasFeature", 0.88): ("Product Feature", "Benefits Administration", "Employee Benefit", "Payroll Service", "Tax Filing", "Tax Filing Service", "Time Tracking Feature", "Time Tracking Solution", "Vulnerability Management", "Threat Intelligence"),
    ("replacesWorkflow", 0.85): ("Legacy Workflow",),
    ("targetsSegment", 0.88): ("Customer Segment",),
    ("servesIndustry", 0.88): ("Industry Vertical",),
    ("deployedAs", 0.88): ("Deployment Model",),
    ("certifiedBy", 0.92): ("Trust Certification",),
    ("hasAPI", 0.88): ("API Standard",),
    ("supportsLocale", 0.82): ("Geographic Market",),
    ("guarantees", 0.88): ("SLA Commitment",),
    ("competesAgainst", 0.80): ("Competitor",),
    ("hasCustomer", 0.85): ("Customer",),
}
#: A billing feature is something automated where one of these words names it (fixed values).
AUTOMATED = ("automate", "recognition", "invoicing", "dunning", "reconciliation", "workflow", "process", "management", "provisioning", "orchestration", "detection", "monitoring")
#: What seed concepts state: predicate, object (empty: the concept itself), confidence (fixed values).
SEEDS = {
    "ASC 606": ("compliesWith", "", 0.90), "SOC 1": ("compliesWith", "", 0.90), "SOC 2": ("compliesWith", "", 0.90), "ERP Integration": ("integratesWith", "ERP Systems", 0.85), "Payment Gateway": ("integratesWith", "Payment Gateways", 0.85),
    "Revenue Recognition": ("automates", "", 0.88), "Billing Automation": ("automates", "", 0.88), "Accounts Receivable": ("automates", "", 0.88),
}


def with_terms(rules: Iterable[Rule], lists: dict[str, tuple[str, ...]]) -> tuple[Rule, ...]:
    """The rules with a vertical's own lists (by field) in place of the general ones."""
    out = []
    for r in rules:
        own = lists.get(r.field)
        out.append(r if own is None else replace(r, terms=tuple(own[:5] if r.unless else own)))
    return tuple(out)


def _has(low: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(low, F.lit(cue))
    return out


def _literal(value: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in value)


def _listed(low: Column, rules: tuple[Rule, ...]) -> Column:
    """The facts of the lists in a sentence in lower case, as structs (step, rule, place, predicate, object, confidence).

    A rule's terms are looked for only where the rule is open, and what is
    found are places in a list of all facts there can be, which is a literal.
    """
    facts, found = [], []
    none = F.array().cast("array<int>")
    for i, r in enumerate(rules):
        if not r.terms:
            continue
        first = len(facts)
        facts += [(r.step, i, k, r.predicate, t, r.confidence) for k, t in enumerate(r.terms)]
        plain, bare = [], []
        for k, t in enumerate(r.terms):
            stands = F.contains(low, F.lit(t.lower()))
            if r.whole:
                stands = stands & F.rlike(low, F.lit(rf"\b{_literal(t.lower())}\b"))
            plain.append(F.when(stands, F.lit(first + k)))
            name = t.lower().replace(" pricing", "").replace(" billing", "")
            bare.append(F.when(stands | F.contains(low, F.lit(name)), F.lit(first + k)) if name else plain[-1])
        hits = F.array_compact(F.array(*plain))
        if r.field == "pricing":
            hits = F.when(_has(low, PRICING_CUES), F.array_compact(F.array(*bare))).otherwise(hits)
        if r.instead:
            hits = F.when(_has(low, r.instead), F.array(*[F.lit(first + k) for k in range(len(r.terms))])).otherwise(hits)
        if r.uncued is not None:
            # the same facts with the other confidence stand behind; a lambda is resolved at once, so it sees this rule's values
            facts += [(*f[:5], r.uncued) for f in facts[first:]]
            hits = F.transform(hits, lambda j: F.when(_has(low, r.cues), j).otherwise(j + len(r.terms)))  # noqa: B023
        gate = [_has(low, r.cues)] if r.cues and r.uncued is None else []
        gate += [~_has(low, r.unless)] if r.unless else []
        gate += [_has(low, r.beside)] if r.beside else []
        found.append(F.when(reduce(and_, gate), hits).otherwise(none) if gate else hits)
    if not found:
        found = [none]
    names = ("step", "rule", "place", "predicate", "object", "confidence")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in facts or [(0, 0, 0, "", "", 0.0)]])
    return F.transform(F.concat(*found), lambda j: F.element_at(listed, j + 1))


def _titled(c: Column) -> Column:
    """Words and the parts of hyphenated words with a capital each."""
    return F.array_join(F.transform(F.split(F.lower(c), "-"), lambda w: F.initcap(w)), "-")


def _open(sentence: Column, low: Column, vendor: Column, partners: bool) -> Column:
    """The facts of the open rules in a sentence."""
    fact = lambda step, rule, predicate, confidence: lambda o, i: F.struct(F.lit(step).alias("step"), F.lit(rule).alias("rule"), i.alias("place"), F.lit(predicate).alias("predicate"), o.alias("object"), F.lit(confidence).alias("confidence"))
    all_of = lambda pattern, text=sentence: F.regexp_extract_all(text, F.lit(pattern), 1)
    foreign = lambda o: (o != "") & (F.lower(o) != F.coalesce(F.lower(F.trim(vendor)), F.lit("")))
    bare = lambda o: F.regexp_replace(o, "^[ ,.]+|[ ,.]+$", "")
    words = lambda o: F.filter(F.split(F.trim(F.lower(o)), r"\s+"), lambda w: ~w.isin(*_FILLERS))
    done = F.transform(F.filter(all_of(AUTOMATES), lambda o: F.size(words(o)).between(1, 4)), lambda o: _titled(F.array_join(words(o), " ")))
    none = F.array().cast("array<struct<step:int,rule:int,place:int,predicate:string,object:string,confidence:double>>")
    # a shape is searched for only where a word that each of its matches has stands
    where = lambda words, facts: F.when(_has(low, words), facts).otherwise(none)
    kinds = [
        where(("uptime",), F.transform(F.transform(F.slice(all_of(UPTIME, low), 1, 1), _titled), fact(13, 98, "guarantees", 0.90))),
        where(AT_WORDS, F.transform(F.filter(F.transform(all_of(AT_COMPANY), bare), foreign), fact(16, 100, "hasCustomer", 0.86))),
        where(("case study",), F.transform(F.filter(F.transform(all_of(CASE_STUDY), bare), foreign), fact(16, 101, "hasCustomer", 0.82))),
        where(("automat", "streamline"), F.transform(F.filter(done, lambda o: (F.length(o) >= 4) & foreign(o) & ~F.lower(o).rlike("http|www|cookie")), fact(17, 102, "automates", 0.80))),
    ]
    if partners:
        each = F.flatten(F.transform(all_of(CONNECTS), lambda span: F.transform(F.split(span, r",\s*|\s+and\s+"), bare)))
        kinds.append(where(("integrat", "connect"), F.transform(F.filter(each, lambda o: (F.length(o) >= 2) & foreign(o) & ~F.lower(o).isin(*_NO_PARTNERS)), fact(18, 103, "integratesWith", 0.82))))
    return F.concat(*kinds)


def stated(docs: DataFrame, key: str, rules: tuple[Rule, ...] = RULES, text: str = "text", vendor: str | None = None, partners: bool = True) -> DataFrame:
    """(key, predicate, object, confidence, evidence) of every relation a text states by the rules, each once, overlaps not yet resolved; also step and low, the object in lower case.

    ``vendor`` names the column with the page's own vendor, which is no
    customer, partner or process of its own; ``partners`` says that partners
    outside the list count, as where a vertical has no list of its own.
    """
    sent = sentences(docs.select(key, F.col(text).alias("__text"), (F.col(vendor) if vendor else F.lit(None).cast("string")).alias("__vendor")), key, "__text", ("__vendor",))
    # a column of its own, as every test of a sentence reads it
    sent, low = sent.withColumn("__low", F.lower("sentence")), F.col("__low")
    each = sent.select(key, "sent", "sentence", F.explode(F.concat(_listed(low, rules), _open(F.col("sentence"), low, F.col("__vendor"), partners))).alias("m"))
    each = each.select(key, "sent", "m.*", F.substring("sentence", 1, EVIDENCE).alias("evidence")).withColumn("object", F.regexp_replace("object", _ENDS, ""))
    first = F.min_by(F.struct("object", "confidence", "evidence", "step"), F.struct("step", "sent", "rule", "place"))
    kept = each.where(F.length("object") >= OBJECT).groupBy(key, "predicate", F.lower("object").alias("low")).agg(first.alias("f"))
    return kept.select(key, "predicate", "low", "f.object", "f.confidence", "f.evidence", "f.step")


def _first_sentence(docs: DataFrame, key: str, asked: DataFrame, text: str) -> DataFrame:
    """asked (key, term) with evidence: the first sentence that holds the term, in any case; empty where none does."""
    told = sentences(docs.select(key, F.col(text).alias("__text")), key, "__text")
    hit = asked.select(key, "term").distinct().join(told, key).where(F.contains(F.lower("sentence"), F.lower("term"))).groupBy(key, "term").agg(F.min_by("sentence", "sent").alias("s"))
    return asked.join(hit, [key, "term"], "left").withColumn("evidence", F.substring(F.coalesce("s", F.lit("")), 1, EVIDENCE)).drop("s")


def labelled(docs: DataFrame, key: str, entities: DataFrame, found: DataFrame, canonical: DataFrame | None = None, text: str = "text", closed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The facts that a recogniser's entities (key, text, label) state, in the columns of ``found``.

    A text that is another form of a listed term (canonical: form in lower
    case, object, predicate) stands for that term with its predicate. What the rules read as another
    predicate (``found``) is left out, as they are surer; and so is a partner
    or standard outside the closed list of a vertical that has one (``closed``, by predicate).
    """
    label = F.col("label")
    states = F.when((label == "Billing Feature") & _has(F.lower("term"), AUTOMATED), F.struct(F.lit("automates").alias("p"), F.lit(0.88).alias("c")))
    for (predicate, confidence), labels in LABELS.items():
        states = states.when(label.isin(*labels), F.struct(F.lit(predicate).alias("p"), F.lit(confidence).alias("c")))
    asked = entities.select(key, F.trim("text").alias("term"), "label").withColumn("st", states).where(F.col("st").isNotNull() & (F.col("term") != ""))
    rows = _first_sentence(docs, key, asked.select(key, "term", F.col("st.p").alias("predicate"), F.col("st.c").alias("confidence")), text).withColumn("object", F.col("term"))
    if canonical is not None:
        forms = canonical.select(F.col("form").alias("__form"), F.col("object").alias("__object"), F.col("predicate").alias("__predicate"))
        rows = rows.join(forms, F.lower("term") == F.col("__form"), "left")
        rows = rows.withColumn("predicate", F.coalesce("__predicate", "predicate")).withColumn("object", F.coalesce("__object", "object")).drop("__form", "__object", "__predicate")
    claims = found.groupBy(key, "low").agg(F.max_by("predicate", F.struct("step", "predicate")).alias("claimed"))
    rows = rows.withColumn("low", F.lower("object")).join(claims, [key, "low"], "left").where(F.col("claimed").isNull() | (F.col("claimed") == F.col("predicate")))
    for predicate, terms in (closed or {}).items():
        listed = F.lit(False)
        for t in terms:
            listed = listed | F.contains("low", F.lit(t.lower())) | F.contains(F.lit(t.lower()), F.col("low"))
        rows = rows.where((F.col("predicate") != predicate) | listed)
    rows = rows.where(F.length("object") >= OBJECT)
    return rows.select(key, "predicate", "low", "object", "confidence", "evidence", F.lit(19).alias("step"))


def seeded(docs: DataFrame, key: str, seeds: DataFrame, text: str = "text") -> DataFrame:
    """The facts that seed concepts (key, concept, count) state, in the columns of ``stated``."""
    rows = [(c, p, o or c, conf) for c, (p, o, conf) in SEEDS.items()]
    spec = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("concept", "predicate", "object", "confidence"), r)]) for r in rows])
    asked = seeds.where("count > 0").select(key, F.col("concept").alias("term")).withColumn("f", F.get(F.filter(spec, lambda s: s["concept"] == F.col("term")), F.lit(0))).where(F.col("f").isNotNull())
    found = _first_sentence(docs, key, asked.select(key, "term", "f.predicate", "f.object", "f.confidence"), text)
    return found.select(key, "predicate", F.lower("object").alias("low"), "object", "confidence", "evidence", F.lit(20).alias("step"))


def without_overlaps(facts: DataFrame, key: str, proven_all: bool = False) -> DataFrame:
    """(key, predicate, object, confidence, evidence): of the facts one sentence proves those whose object is no part, in whole words, of a longer one; one without a sentence is held against all of its text.

    ``proven_all`` says that every fact has a sentence; facts are read once
    then, and three times otherwise. A sentence proves no more facts than it holds terms, and a text's different
    objects come from lists and labels, so the sets compared are small.
    """
    part = lambda mine: lambda o: (F.length(o) > F.length(mine)) & F.contains(o, mine) & F.rlike(o, F.concat(F.lit(r"\b\Q"), mine, F.lit(r"\E\b")))
    inside = lambda many: F.exists(many, part(F.col("low")))
    proven = facts.where(F.col("evidence") != "")
    by_sentence = proven.withColumn("many", F.collect_set("low").over(Window.partitionBy(key, "evidence")))
    kept = by_sentence.where(~inside(F.col("many"))).drop("many")
    columns = (key, "predicate", "object", F.round("confidence", 2).alias("confidence"), F.nullif(F.col("evidence"), F.lit("")).alias("evidence"))
    if proven_all:
        return kept.select(*columns)
    bare = facts.where(F.col("evidence") == "")
    all_of = facts.join(bare.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.collect_set("low").alias("many"))
    alone = bare.join(all_of, key).where(~inside(F.col("many"))).drop("many")
    return kept.unionByName(alone).select(*columns)


def relations(docs: DataFrame, key: str, rules: tuple[Rule, ...] = RULES, text: str = "text", vendor: str | None = None, entities: DataFrame | None = None, seeds: DataFrame | None = None, canonical: DataFrame | None = None, partners: bool = True, closed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, predicate, object, confidence, evidence): all that the texts, their labelled entities and their seed concepts state.

    Null and empty texts state nothing by themselves; entities and seeds of
    unknown texts count without evidence, which is null then. Repeated rows of one key
    count once.
    """
    found = stated(docs, key, rules, text, vendor, partners)
    facts = found
    if entities is not None:
        facts = facts.unionByName(labelled(docs, key, entities, found, canonical, text, closed))
    if seeds is not None:
        facts = facts.unionByName(seeded(docs, key, seeds, text))
    if facts is not found:
        first = F.min_by(F.struct("object", "confidence", "evidence", "step"), F.struct("step", "object", "confidence"))
        facts = facts.groupBy(key, "predicate", "low").agg(first.alias("f")).select(key, "predicate", "low", "f.*")
    # what a text states has the sentence that states it
    return without_overlaps(facts, key, facts is found)

"""Event logs folded to their state, and forms resolved against a registry.

A fold is an aggregation: for every facet the last event decides, so state is a
``max_by`` over the event id and needs neither a sort nor one task per entity
with all its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..plans.storage import Scratch

#: Company endings, attached web endings and opening articles that a key leaves out (fixed values).
LEGAL = "inc|incorporated|llc|ltd|limited|plc|corp|corporation|gmbh"
#: Words that make no name by themselves (fixed values).
GENERIC = (
    "customer client user business company industry market segment region account team vendor provider partner investor organization organisation enterprise people consumer subscriber buyer member platform system software "
    "solution tool app application service product feature workflow model plan pricing price billing portal cloud data finance tax commitment count name base relationship strategy geography geographic global globally worldwide "
    "other large big small mid sized key end sales revenue payment process operation option method term contract channel cycle stack infrastructure integration connector functionality communication connectivity automation security "
    "technology financial institution success high growth growing fast early stage complex potential self serve active beta licensed competitor competitive"
).split()
#: What sites add to a name to get a domain, and words that follow a name without changing it (fixed values).
AFFIXES = ("labs", "hq", "app", "inc", "io", "ai", "get", "try", "use", "go", "join", "the", "software", "tech", "hub")
PRODUCT_WORDS = ("crm", "online", "cloud", "erp", "payments", "payment", "billing", "model", "system", "app", "suite", "hcm", "financials", "platform", "software", "api", "integration", "connector", "sync", "solution")


def singular(w: Column) -> Column:
    return (
        F.when(F.length(w) <= 4, w)
        .when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(sses|shes|ches|xes)$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def key(form: Column) -> Column:
    """The key under which spellings of one form meet: lower case, without marks, possessive, article, company ending, attached web ending, and the last word's plural where the form is written in lower case or the word is generic. '' for a form without letters and digits."""
    s = F.regexp_replace(F.regexp_replace(F.trim(form), "’", "'"), "&", " and ")
    s = F.regexp_replace(s, r"(?i)(?<=[A-Za-z0-9])\.(com|io|ai|co|net|org|app)\b", "")
    s = F.regexp_replace(s, r"'s\b", "")
    s = F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))
    s = F.regexp_replace(s, r"(?i)^(the|a|an) (?=.)", "")
    s = F.regexp_replace(s, rf"(?i)(?<=.)( ({LEGAL}))+$", "")

    def ended(last: Column, low: Column, one: Column) -> Column:
        plural = F.when(last.rlike("^[A-Z]{2,}s$"), F.regexp_replace(low, "s$", ""))
        return plural.when((last == low) | one.isin(*GENERIC) | low.isin(*GENERIC), one).otherwise(low)

    def whole(s: Column) -> Column:
        end = tx.bound(F.regexp_extract(s, "([A-Za-z0-9]+)$", 1), lambda last: tx.bound(F.lower(last), lambda low: tx.bound(singular(low), lambda one: ended(last, low, one))))
        return F.concat(F.regexp_replace(F.lower(s), "[a-z0-9]+$", ""), end)

    return tx.bound(s, whole)


def fold_key(k: Column) -> Column:
    """A key without spaces and its last word's plural, under which 'card connect' and 'cardconnect' meet."""
    last = tx.bound(F.regexp_extract(k, "([a-z0-9]+)$", 1), singular)
    return F.regexp_replace(F.concat(F.regexp_replace(k, "[a-z0-9]+$", ""), last), " ", "")


def is_generic(k: Column) -> Column:
    """Whether a key has only words that name nothing by themselves."""
    return F.forall(F.split(k, " "), lambda w: w.isin(*GENERIC) | singular(w).isin(*GENERIC))


def names_brand(k: Column, host: Column) -> Column:
    """Whether a key is the label of a host, or the label with one affix."""
    affixes = F.array(F.lit(""), *[F.lit(a) for a in AFFIXES])
    named = lambda x: (F.length(x["k"]) >= 4) & F.exists(affixes, lambda a: (F.concat(x["k"], a) == x["label"]) | (F.concat(a, x["k"]) == x["label"]))
    return tx.bound(F.struct(F.regexp_replace(k, " ", "").alias("k"), urls.label(host).alias("label")), named)


def decisions(events: DataFrame) -> DataFrame:
    """(vertical_id, key, decision, ...) of the decision that stands for each vertical and key: the one with the greatest event_id."""
    rest = [c for c in events.columns if c not in ("vertical_id", "key")]
    last = events.groupBy("vertical_id", "key").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("event_id", F.lit("")), *[F.col(c) for c in rest if c != "event_id"])).alias("d"))
    return last.select("vertical_id", "key", "d.*")


def generic_keys(standing: DataFrame) -> DataFrame:
    """Keys that a standing decision of any vertical calls generic."""
    return standing.where(F.col("decision") == "generic").select("key").distinct()


def approved_concepts(standing: DataFrame) -> DataFrame:
    """(vertical_id, id, label, broader_id): approved keys as concepts; ids that collide get -2, -3 in the order of their keys; a broader that is no approved label of the vertical is null."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    made = standing.where(F.col("decision") == "approve").select("vertical_id", "key", F.coalesce(blank("label"), blank("key")).alias("label"), F.lower(blank("broader")).alias("broader"))
    made = made.withColumn("base", tx.slug(F.col("label")))
    # collisions are rare and local to a slug, so the suffix is counted within (vertical, slug) only
    numbered = made.groupBy("vertical_id", "base").agg(F.sort_array(F.collect_list(F.struct("key", "label", "broader"))).alias("m")).select("vertical_id", "base", F.posexplode("m").alias("i", "c"))
    named = numbered.select("vertical_id", F.when(F.col("i") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), (F.col("i") + 1).cast("string"))).alias("id"), "c.label", "c.broader")
    parents = named.groupBy("vertical_id", F.lower("label").alias("broader")).agg(F.min("id").alias("broader_id"))
    return named.join(parents, ["vertical_id", "broader"], "left").select("vertical_id", "id", "label", "broader_id")


def synonym_queue(proposed: DataFrame, decided: DataFrame) -> DataFrame:
    """(key, vertical_id, surface, canonical, status, decided_by) of each proposed pair of names.

    ``proposed`` has request_id, surface_form, canonical_concept, vertical_id:
    the first proposal of a key stands. ``decided`` has event_id, decision
    (approved or rejected), surface, vertical_id, key, withdraws. The latest approval or withdrawal of a
    surface form in the proposal's vertical (in any, where it has none) and the latest rejection of the key compete, the
    later event deciding; a withdrawn approval settles nothing.
    """
    low = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    rows = proposed.select("request_id", low("surface_form").alias("surface"), low("canonical_concept").alias("canonical"), low("vertical_id").alias("vertical_id")).where((F.col("surface") != "") & (F.col("canonical") != ""))
    rows = rows.withColumn("key", F.concat(F.when(F.col("vertical_id") != "", F.concat("vertical_id", F.lit("|"))).otherwise(""), "canonical", F.lit("|"), "surface"))
    queue = rows.groupBy("key").agg(F.min_by(F.struct("vertical_id", "surface", "canonical"), "request_id").alias("q")).select("key", "q.*")
    said = decided.select("event_id", "decision", low("surface").alias("surface"), low("vertical_id").alias("vertical_id"), "key", "withdraws")
    settling = said.where((F.col("surface") != "") & ((F.col("decision") == "approved") | F.col("withdraws")))
    last = F.max(F.struct("event_id", "decision")).alias("s")
    per = settling.groupBy("vertical_id", "surface").agg(last)
    anywhere = settling.groupBy("surface").agg(last).select(F.lit("").alias("vertical_id"), "surface", "s")
    settled = per.where(F.col("vertical_id") != "").unionByName(anywhere).where(F.col("s.decision") == "approved")
    rejected = said.where((F.col("decision") == "rejected") & F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("event_id", "decision")).alias("r"))
    both = queue.join(settled, ["vertical_id", "surface"], "left").join(rejected, "key", "left")
    winner = F.greatest("s", "r")
    return both.select("key", "vertical_id", "surface", "canonical", F.coalesce(winner["decision"], F.lit("pending")).alias("status"), winner["event_id"].alias("decided_by"))


def registry_state(rows: DataFrame) -> DataFrame:
    """(id, kind, preflabel, status, merged_into, aliases, domains, undone) of each entity from all its deliveries.

    For each field the latest row in which it is filled decides (time, then
    value); aliases and domains add up, in order and each once, case ignored. A merge into what either
    side calls distinct is undone: the entity is active again.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    last = lambda c: F.max(F.when(blank(c).isNotNull(), F.struct(F.coalesce("recorded_at", F.lit("0001-01-01").cast("timestamp_ntz")), blank(c).alias("v"))))["v"].alias(c)
    plain = rows.where(F.col("id").isNotNull())
    state = plain.groupBy("id").agg(last("kind"), last("preflabel"), last("status"), last("merged_into"))
    many = plain.select("id", F.explode(F.concat(F.coalesce(F.transform("aliases", lambda a: F.struct(F.lit("alias").alias("t"), F.lower(F.trim(a["form"])).alias("v"))), F.array()), F.coalesce(F.transform("domains", lambda d: F.struct(F.lit("domain").alias("t"), F.lower(F.trim(d)).alias("v"))), F.array()), F.coalesce(F.transform("distinct_from", lambda d: F.struct(F.lit("apart").alias("t"), F.trim(d).alias("v"))), F.array()))).alias("x")).where(F.col("x.v") != "")
    held = many.select("id", "x.t", "x.v").distinct()
    sets = held.groupBy("id").agg(*[F.sort_array(F.collect_set(F.when(F.col("t") == t, F.col("v")))).alias(n) for t, n in (("alias", "aliases"), ("domain", "domains"))])
    apart = held.where(F.col("t") == "apart").select("id", F.col("v").alias("other"))
    apart = apart.unionByName(apart.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().select("id", F.col("other").alias("merged_into"), F.lit(True).alias("undone"))
    full = state.join(sets, "id", "left").join(apart, ["id", "merged_into"], "left")
    none = F.array().cast("array<string>")
    undone = F.coalesce("undone", F.lit(False))
    return full.select("id", F.lower("kind").alias("kind"), "preflabel", F.when(undone, "active").otherwise(F.col("status")).alias("status"), F.when(~undone, F.col("merged_into")).alias("merged_into"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("domains", none).alias("domains"), undone.alias("undone"))


def forms_by_key(observations: DataFrame) -> DataFrame:
    """(domain, key, display, label, mentions, pages) of each site's forms: the most written spelling, one with a capital first on a tie, and the most frequent label."""
    once = observations.dropDuplicates(["observation_id"])
    site = F.lower(F.trim("domain"))
    each = once.select(site.alias("domain"), F.explode("forms").alias("f")).where(F.col("domain") != "")
    keyed = each.select("domain", F.lower(F.trim("f.key")).alias("key"), "f.forms", "f.labels", F.coalesce("f.mentions", F.lit(0)).alias("mentions"), F.coalesce("f.pages", F.lit(0)).alias("pages")).where(F.col("key") != "")
    totals = keyed.groupBy("domain", "key").agg(F.sum("mentions").alias("mentions"), F.sum("pages").alias("pages"))

    def most(of: str, name: str) -> DataFrame:
        spelled = keyed.select("domain", "key", F.explode(of).alias("v", "n")).groupBy("domain", "key", "v").agg(F.sum(F.greatest("n", F.lit(1))).alias("n"))
        return spelled.groupBy("domain", "key").agg(F.max(F.struct("n", F.col("v").rlike("[A-Z]").alias("capital"), "v"))["v"].alias(name))

    return totals.join(most("forms", "display"), ["domain", "key"], "left").join(most("labels", "label"), ["domain", "key"], "left")


def resolve_keys(keys: DataFrame, registry: DataFrame, concepts: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(domain, key, target_kind, target, method) of each site's keys, by the first rung that answers.

    ``keys`` has domain, key, display; ``registry`` (form key, id) of active entries; ``concepts`` (form key,
    concept_id); ``blocked`` (key) what reviewers took out. The rungs: a mention for blocked keys; one registry entry (several: ambiguous, the key stays observed); a concept named by one
    only; the site's brand; the same after a product word is taken off; a mention for generic keys; else observed. Then keys
    of a site that are equal without spaces join the best resolved of them, and an acronym that a site
    writes in two to five capitals joins what its one longer key with these initials is.
    """
    entry = registry.where(F.col("form") != "").groupBy("form").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    concept = concepts.where(F.col("form") != "").groupBy("form").agg(F.count_distinct("concept_id").alias("cn"), F.min("concept_id").alias("cid")).where(F.col("cn") == 1).select("form", "cid")
    rest = F.regexp_replace("key", f" ({'|'.join(PRODUCT_WORDS)})$", "")
    base = keys.withColumn("rest", F.when((rest != F.col("key")) & (F.length(F.regexp_replace(rest, " ", "")) >= 3), rest))
    at = lambda of, col, names: of.select(F.col("form").alias(col), *[F.col(a).alias(b) for a, b in names])
    hit = base.join(at(entry, "key", [("n", "n"), ("id", "id")]), "key", "left").join(at(concept, "key", [("cid", "cid")]), "key", "left")
    hit = hit.join(at(entry.where(F.col("n") == 1), "rest", [("id", "rid")]), "rest", "left").join(at(concept, "rest", [("cid", "rcid")]), "rest", "left")
    brand = names_brand(F.col("key"), F.col("domain"))
    pick = lambda k, t, m: F.struct(F.lit(k).alias("kind"), t.alias("target"), F.lit(m).alias("method"))
    hit = hit.join(blocked.select("key", F.lit(True).alias("blocked")).distinct(), "key", "left") if blocked is not None else hit.withColumn("blocked", F.lit(None).cast("boolean"))
    chosen = (
        F.when(F.col("blocked"), pick("mention", F.col("key"), "blocked"))
        .when(F.col("n") == 1, pick("entity", F.col("id"), "registry"))
        .when(F.col("n") > 1, pick("observed", F.col("key"), "ambiguous"))
        .when(F.col("cid").isNotNull(), pick("concept", F.col("cid"), "concept"))
        .when(brand, pick("brand", F.col("domain"), "brand"))
        .when(F.col("rid").isNotNull(), pick("entity", F.col("rid"), "suffix"))
        .when(F.col("rcid").isNotNull(), pick("concept", F.col("rcid"), "suffix"))
        .when(is_generic(F.col("key")) | ~F.coalesce("display", F.col("key")).rlike("[A-Z]"), pick("mention", F.col("key"), "mention"))
        .otherwise(pick("observed", F.col("key"), "observed"))
    )
    scratch = Scratch(keys.sparkSession, "resolution")
    rung = scratch.keep(hit.select("domain", "key", "display", chosen.alias("c"), fold_key(F.col("key")).alias("fold")))
    order = F.when(F.col("c.kind").isin("entity", "concept", "brand"), 0).when(F.col("c.kind") == "observed", 1).otherwise(2)
    best = rung.groupBy("domain", "fold").agg(F.min(F.struct(order.alias("o"), "key", "c")).alias("b"))
    moved = rung.join(best, ["domain", "fold"])
    free = F.col("c.kind").isin("observed", "mention") & ~F.col("c.method").isin("ambiguous", "blocked")
    moves = free & (F.col("b.key") != F.col("key"))
    spelled = moved.select("domain", "key", "display", F.when(moves, F.struct(F.col("b.c.kind").alias("kind"), F.col("b.c.target").alias("target"), F.lit("spelling").alias("method"))).otherwise(F.col("c")).alias("c"))
    spelled = scratch.keep(spelled)
    words = F.split("key", " ")
    letters = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    long = spelled.where((F.size(words) >= 2) & F.forall(words, lambda w: w.rlike("^[a-z]{2,}$")) & (F.col("c.method") != "blocked")).select("domain", letters.alias("key"), F.struct("c.kind", "c.target").alias("t"))
    one = long.groupBy("domain", "key").agg(F.min("t").alias("t"), F.max("t").alias("u")).where(F.col("t") == F.col("u")).select("domain", "key", "t")
    short = free & F.regexp_replace("display", "\\.", "").rlike("^[A-Z]{2,5}$") & F.col("t").isNotNull()
    out = spelled.join(one, ["domain", "key"], "left")
    return out.select("domain", "key", F.when(short, F.col("t.kind")).otherwise(F.col("c.kind")).alias("target_kind"), F.when(short, F.col("t.target")).otherwise(F.col("c.target")).alias("target"), F.when(short, "acronym").otherwise(F.col("c.method")).alias("method"))


def proposals(observations: DataFrame, standing: DataFrame, least_sites: int = 2, ratio: float = 0.5) -> DataFrame:
    """(vertical_id, key, sites, pages, label, share_here, share_there) of terms a vertical's crawls suggest it is missing.

    A host's latest observation stands for it, the hosts of one registrable
    domain for one site. Unresolved keys are grouped by their words' first
    letters, and an acronym of three letters or more joins the term with those
    initials that most sites have; a group stands if ``least_sites`` sites have
    it, no decision or generic mark settles it, it holds no brand of the vertical, and
    its share of the pages read elsewhere is under ``ratio`` times that here.
    """
    domain = F.lower(F.trim("domain"))
    seen = observations.where((domain != "") & (F.size("forms") > 0) & F.col("vertical_id").isNotNull())
    host = seen.groupBy(domain.alias("host")).agg(F.max(F.struct(F.coalesce("observed_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "observation_id", "vertical_id", "pages_crawled", F.transform("forms", lambda f: F.struct(F.lower(F.trim(f["key"])).alias("key"), f["pages"].alias("pages"), f["method"].alias("method"), F.map_entries(f["forms"]).alias("forms"))).alias("forms"))).alias("o"))
    host = host.select("host", urls.registrable(F.col("host")).alias("site"), "o.vertical_id", F.coalesce("o.pages_crawled", F.lit(0)).alias("crawled"), "o.forms")
    rows = host.select("host", "site", "vertical_id", F.explode("forms").alias("f")).where(F.col("f.key") != "").withColumn("gkey", tx.stems(F.col("f.key"))).withColumn("pages", F.coalesce("f.pages", F.lit(0)))
    crawled = host.groupBy("vertical_id").agg(F.sum("crawled").alias("c"))
    total = crawled.agg(F.sum("c").alias("t"))
    own = rows.where(F.col("f.method").isin("observed", "mention"))
    label = F.element_at(F.split("site", "\\."), 1)
    own = own.where(~F.contains(F.regexp_replace("f.key", " ", ""), label))
    spelled = own.select("vertical_id", "gkey", F.explode("f.forms").alias("e")).groupBy("vertical_id", "gkey", F.col("e.key").alias("form")).agg(F.sum("e.value").alias("n"))
    counted = lambda of: of.groupBy("vertical_id", "gkey").agg(F.count_distinct("site").alias("sites"), F.sum("pages").alias("pages"))
    short = spelled.where(F.col("form").rlike("^[A-Z][A-Z0-9&]{1,7}s?$") & ~F.contains("gkey", F.lit(" "))).groupBy("vertical_id", "gkey").agg(F.regexp_replace(F.max(F.struct("n", "form"))["form"], "s$", "").alias("letters"))
    long = spelled.where(F.contains("gkey", F.lit(" "))).select("vertical_id", F.col("gkey").alias("into"), tx.initials(F.col("form")).alias("letters")).where(F.length("letters") >= 3).distinct()
    best = long.join(counted(own).withColumnRenamed("gkey", "into"), ["vertical_id", "into"]).groupBy("vertical_id", "letters").agg(F.max(F.struct("sites", "pages", "into"))["into"].alias("into"))
    groups = counted(own.join(short.join(best, ["vertical_id", "letters"]).drop("letters"), ["vertical_id", "gkey"], "left").withColumn("gkey", F.coalesce("into", "gkey")))
    everywhere = rows.groupBy("vertical_id", "gkey").agg(F.sum("pages").alias("p"))
    over = everywhere.groupBy("gkey").agg(F.sum("p").alias("all"))
    labels = spelled.groupBy("vertical_id", "gkey").agg(F.max(F.struct("n", F.col("form").rlike("^[A-Z]").alias("capital"), "form"))["form"].alias("label"))
    settled = standing.select("vertical_id", F.col("key").alias("gkey")).distinct()
    kept = groups.where(F.col("sites") >= least_sites).join(generic_keys(standing).withColumnRenamed("key", "gkey"), "gkey", "left_anti").join(settled, ["vertical_id", "gkey"], "left_anti")
    joined = kept.join(everywhere, ["vertical_id", "gkey"]).join(over, "gkey").join(crawled, "vertical_id").join(labels, ["vertical_id", "gkey"], "left").withColumn("t", total.scalar())
    here, there = F.col("pages") / F.nullif(F.col("c"), F.lit(0)), (F.col("all") - F.col("p")) / F.nullif(F.col("t") - F.col("c"), F.lit(0))
    shares = joined.withColumn("share_here", F.round(F.coalesce(here, F.lit(0.0)), 6)).withColumn("share_there", F.round(F.coalesce(there, F.lit(0.0)), 6))
    return shares.where((F.col("share_there") == 0) | (F.col("share_there") < ratio * F.col("share_here"))).select("vertical_id", F.col("gkey").alias("key"), "sites", "pages", "label", "share_here", "share_there")

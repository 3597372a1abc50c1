"""The registry folded from its seed and its log of typed events.

No entity's events are ever brought together in order: for every facet a
maximum or a minimum of event ids tells what stands. Whether an event counts
at all depends on when its entity came to be, so events are first joined with
that moment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Scratch

SEED = "id string, kind string, preflabel string, status string, merged_into string, aliases array<string>, domains array<string>, distinct_from array<string>, external map<string,string>"
#: event_id orders the log; each type reads the fields it needs.
EVENT = "event_id string, type string, actor string, entity_id string, entity struct<id:string,kind:string,preflabel:string,status:string,aliases:array<string>,domains:array<string>>, form string, into string, other string, system string, value string, domain string, key string, reason string"
REVIEWER, AUTOMATION = "reviewer", "automation"
#: The types that change an entity.
TYPES = ("alias_added", "alias_removed", "merged", "unmerged", "distinct_from_added", "external_linked", "domain_added", "domain_removed", "promoted", "rejected")
BLOCKING = ("blocked_key_added", "blocked_key_removed")


@dataclass
class Registry:
    """entities (id, kind, preflabel, status, merged_into, undone), aliases (id, form, source), domains (id, domain), external (id, system, value), distinct (id, other), blocked (key, reason), conflicts (event_id, why)."""

    entities: DataFrame
    aliases: DataFrame
    domains: DataFrame
    external: DataFrame
    distinct: DataFrame
    blocked: DataFrame
    conflicts: DataFrame


def _last(events: DataFrame, keys: list[str], on: str, rest: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., at, rest...) of what was added last and not removed since: the first addition after the last removal. ``on`` tells additions."""
    gone = F.max(F.when(~F.col(on), F.col("event_id")))
    marked = events.groupBy(*keys).agg(gone.alias("gone"))
    later = lookup_join(events, marked, keys, "inner").where(F.col(on) & (F.col("gone").isNull() | (F.col("event_id") > F.col("gone"))))
    return later.groupBy(*keys).agg(F.min(F.struct(F.col("event_id").alias("at"), *rest)).alias("f")).select(*keys, "f.*")


def fold_events(seed: DataFrame, events: DataFrame) -> Registry:
    """The registry that a seed (SEED) and events (EVENT) give; the same for any order of the rows.

    Events count in the order of event_id, those delivered twice once. The first creation of an id stands, the
    seed's before all; what names an entity that is not there yet is a
    conflict. A merge needs a target that is there, and an automated one does
    not join what a reviewer ever split or called distinct. What either side
    calls distinct cannot stay merged, whatever the order: the entity is
    active again (undone). A rejection keeps what an earlier merge pointed to. Unmerging counts for merged entities,
    promotion for candidates. Blocked keys name no entity. Events without id or type count for nothing.
    """
    spark = seed.sparkSession
    scratch = Scratch(spark, "registry")
    log = scratch.keep(events.where(F.col("event_id").isNotNull() & F.col("type").isNotNull()).withColumn("actor", F.coalesce("actor", F.lit(AUTOMATION))).distinct())
    made = log.where((F.col("type") == "entity_created") & F.col("entity.id").isNotNull())
    default = F.when(F.col("actor") == AUTOMATION, "candidate").otherwise("active")
    fields = lambda at, source, of: [F.col(f"{of}id").alias("id"), F.struct(at.alias("born"), F.col(f"{of}kind").alias("kind"), F.col(f"{of}preflabel").alias("preflabel"), source.alias("source"), F.coalesce(f"{of}aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce(f"{of}domains", F.array().cast("array<string>")).alias("domains"))]
    first = lambda of, at, source, status, into: of.select(*[c.alias("c") if i else c for i, c in enumerate(fields(at, source[0], source[1]))], status.alias("status"), into.alias("into"))
    rows = first(seed.where(F.col("id").isNotNull()), F.lit(""), (F.lit("seed"), ""), F.coalesce("status", F.lit("active")), F.col("merged_into"))
    rows = rows.unionByName(first(made, F.col("event_id"), (F.col("actor"), "entity."), F.coalesce("entity.status", default), F.lit(None).cast("string")))
    born = scratch.keep(rows.groupBy("id").agg(F.min(F.struct("c", "status", "into")).alias("m")).select("id", "m.c.*", "m.status", "m.into"))
    when = born.select("id", "born")

    rest = log.where(F.col("type") != "entity_created")
    placed = scratch.keep(lookup_join(rest, when.withColumnRenamed("id", "entity_id"), ["entity_id"], "left"))
    there = F.col("born").isNotNull() & (F.col("event_id") > F.col("born"))
    blocking = F.col("type").isin(*BLOCKING)
    counted = placed.where(there & F.col("type").isin(*TYPES)).withColumnRenamed("entity_id", "id").drop("born")
    of = lambda *types: counted.where(F.col("type").isin(*types))
    low = lambda c: F.lower(F.trim(c))

    # aliases and domains: what is there from the start is an addition before all
    start = lambda field, column: born.select("id", F.col("born").alias("event_id"), F.lit(True).alias("on"), "source", F.explode(field).alias(column))
    said = start("aliases", "form").unionByName(of("alias_added", "alias_removed").where(F.col("form").isNotNull()).select("id", "event_id", (F.col("type") == "alias_added").alias("on"), F.col("actor").alias("source"), "form"))
    aliases = _last(scratch.keep(said.withColumn("low", F.lower("form"))), ["id", "low"], "on", ("form", "source")).select("id", "form", "source")
    sites = start("domains", "domain").select("id", "event_id", "on", low("domain").alias("domain")).unionByName(of("domain_added", "domain_removed").where(F.col("domain").isNotNull()).select("id", "event_id", (F.col("type") == "domain_added").alias("on"), low("domain").alias("domain")))
    domains = _last(scratch.keep(sites.where("domain <> ''")), ["id", "domain"], "on").select("id", "domain")
    linked = seed.where("id is not null").select("id", F.lit("").alias("event_id"), F.explode("external").alias("system", "value")).unionByName(of("external_linked").where(F.col("system").isNotNull()).select("id", "event_id", "system", "value"))
    external = linked.groupBy("id", "system").agg(F.max(F.struct("event_id", "value"))["value"].alias("value"))

    # what is distinct: both ways where the other was there when it was said
    apart = seed.where("id is not null").select("id", F.explode("distinct_from").alias("other")).where("other is not null")
    declared = of("distinct_from_added").where(F.col("other").isNotNull()).select("id", "other", "event_id")
    back = declared.join(when.select(F.col("id").alias("other"), "born"), "other").where(F.col("event_id") > F.col("born")).select(F.col("other").alias("id"), F.col("id").alias("other"))
    distinct = scratch.keep(apart.unionByName(declared.select("id", "other")).unionByName(back).distinct())

    # merges that hold: into what was there, and not what a reviewer ever kept apart
    pair = lambda a, b: [F.least(a, b).alias("p"), F.greatest(a, b).alias("q")]
    split = rest.where(F.col("type").isin("distinct_from_added", "unmerged") & (F.col("actor") == REVIEWER)).select("entity_id", F.coalesce("other", "into").alias("o")).where("entity_id is not null and o is not null").select(*pair("entity_id", "o")).distinct()
    merges = of("merged").select("id", "event_id", "actor", "into", *pair("id", "into"))
    merges = merges.join(when.select(F.col("id").alias("into"), "born"), "into", "left").join(split.withColumn("split", F.lit(True)), ["p", "q"], "left")
    valid = F.coalesce(F.col("born").isNotNull() & (F.col("event_id") > F.col("born")) & (F.col("into") != F.col("id")), F.lit(False))
    overruled = F.coalesce("split", F.lit(False)) & (F.col("actor") != REVIEWER)
    merges = scratch.keep(merges.select("id", "event_id", "into", F.when(~valid, "target").when(overruled, "overruled").alias("why")))
    merged = merges.where("why is null")

    # status: the last merge or rejection sets it; unmerging after a merge, and promotion of a candidate, change it
    sets = merged.select("id", "event_id", F.lit("merged").alias("to"), "into").unionByName(of("rejected").select("id", "event_id", F.lit("rejected").alias("to"), F.lit(None).cast("string").alias("into")))
    last = sets.groupBy("id").agg(F.max(F.struct("event_id", "to"))["event_id"].alias("set_at"), F.max(F.struct("event_id", "to"))["to"].alias("set_to"), F.max(F.when(F.col("to") == "merged", F.struct("event_id", "into"))).alias("m"))
    ends = of("unmerged", "promoted", "rejected").select("id", "event_id", "type")
    state = born.select("id", "kind", "preflabel", "status", F.col("into").alias("first_into")).join(last, "id", "left")
    since = F.coalesce("set_at", F.lit(""))
    seen = lookup_join(scratch.keep(ends), scratch.keep(state.select("id", since.alias("set_at"), F.coalesce("m.event_id", F.lit("")).alias("merge_at"))), ["id"], "inner")
    seen = seen.groupBy("id").agg(
        F.bool_or((F.col("type") == "unmerged") & (F.col("event_id") > F.col("set_at"))).alias("unmerged"), F.bool_or(F.col("type") == "promoted").alias("promoted"),
        F.min(F.when((F.col("type") == "unmerged") & (F.col("event_id") > F.col("merge_at")), F.col("event_id"))).alias("undo_at"), F.min(F.when((F.col("type") == "rejected") & (F.col("event_id") > F.col("merge_at")), F.col("event_id"))).alias("reject_at"),
    )
    full = state.join(seen, "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    before = F.coalesce("set_to", "status")
    status = F.when((before == "merged") & yes("unmerged"), "active").when(F.col("set_to").isNull() & (before == "candidate") & yes("promoted"), "active").otherwise(before)
    # what an entity points to is cleared by an unmerging that finds it merged: not one after a rejection
    cleared = yes(F.col("undo_at").isNotNull() & (F.col("reject_at").isNull() | (F.col("undo_at") < F.col("reject_at"))) & (F.col("m").isNotNull() | (F.col("status") == "merged")))
    full = full.select("id", "kind", "preflabel", status.alias("status"), F.when(~cleared, F.coalesce("m.into", "first_into")).alias("merged_into"))
    both = distinct.unionByName(distinct.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().select("id", F.col("other").alias("merged_into"), F.lit(True).alias("apart"))
    full = full.join(both, ["id", "merged_into"], "left")
    undone = (F.col("status") == "merged") & yes("apart")
    entities = scratch.keep(full.select("id", "kind", "preflabel", F.when(undone, "active").otherwise(F.col("status")).alias("status"), F.when(~undone, F.col("merged_into")).alias("merged_into"), undone.alias("undone")))

    blocks = placed.where(blocking & ~F.coalesce(there, F.lit(False)) & F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("event_id", "type", F.coalesce("reason", F.lit("")).alias("reason"))).alias("b"))
    blocked = blocks.where(F.col("b.type") == BLOCKING[0]).select("key", "b.reason")
    unknown = placed.where(~F.coalesce(there, F.lit(False)) & ~blocking).select("event_id", F.lit("names an unknown entity").alias("why"))
    strange = placed.where(there & ~F.col("type").isin(*TYPES)).select("event_id", F.lit("is of an unknown type").alias("why"))
    refused = merges.where("why is not null").select("event_id", F.when(F.col("why") == "target", "merges into no valid target").otherwise("is overruled by a reviewer").alias("why"))
    return Registry(entities, aliases, domains, external, distinct, blocked, unknown.unionByName(strange).unionByName(refused))

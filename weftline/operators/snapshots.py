"""What changed between full snapshots, by comparing Merkle trees.

Every snapshot's records are hashed into ranges; the digests of the ranges
form a tree with a fixed fan-out, as deep as the snapshots it is compared with
need. Every level is rolled up from the one below it. Two snapshots are compared
from the root down, reading only the children of nodes whose digests differ,
and records are compared only in the leaves that are reached. A digest is a
pair of 64-bit XORs with a count, so it does not depend on order and is
combined map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Scratch

#: Bits of the range number that each level of the tree adds.
FANOUT_BITS = 4
#: Records that a leaf should hold on average.
LEAF_RECORDS = 32
#: A chain of at most this many snapshots is broadcast.
SENT_SNAPSHOTS = 100_000


def run_chain(graphs: DataFrame) -> DataFrame:
    """(graph_id, host, time, earlier): each run with the run of its host before it.

    Rows of another kind, and ids that are not ``https://<host>/audit/<time>``,
    are no runs. A graph_id that stands twice counts once.
    """
    runs = graphs.where((F.col("kind") == "run") & F.col("graph_id").rlike("^https://[^/]+/audit/.+$")).select("graph_id").distinct()
    runs = runs.select("graph_id", F.regexp_extract("graph_id", "^https://([^/]+)/audit/", 1).alias("host"), F.regexp_extract("graph_id", "^https://[^/]+/audit/(.+)$", 1).alias("time"))
    return runs.withColumn("earlier", F.lag("graph_id").over(Window.partitionBy("host").orderBy("time", "graph_id")))


def record_digests(rows: DataFrame, snapshot: str, keys: list[str], value: str) -> DataFrame:
    """(snapshot, keys..., d1, d2, n): digest and size of the set of distinct values of each record.

    Two steps, so that a record with a third of all rows is spread over its
    values first and then combined from partial digests; values travel as two
    hashes. A null value is a value like others.
    """
    v = F.coalesce(F.concat(F.lit("="), F.col(value)), F.lit(""))
    distinct = rows.select(snapshot, *keys, F.xxhash64(v).alias("v1"), F.xxhash64(F.lit(7), v).alias("v2")).distinct()
    return distinct.groupBy(snapshot, *keys).agg(F.bit_xor("v1").alias("d1"), F.bit_xor("v2").alias("d2"), F.count(F.lit(1)).alias("n"))


def _node(h: str, depth: Column) -> Column:
    """The range of the hash at a depth; the root is the only one at depth 0."""
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.col(h), (64 - FANOUT_BITS * depth).cast("int")))


def diff_snapshots(rows: DataFrame, chain: DataFrame, snapshot: str, keys: list[str], value: str, leaf_bits: int | None = None) -> DataFrame:
    """(snapshot, keys..., change) of every snapshot against the one before it.

    ``rows`` holds the records of all snapshots, ``chain`` (snapshot, earlier)
    the one each is compared with (null: none). A record is the set of distinct
    values under ``keys``; change is ``added``, ``removed`` or ``changed``. Rows of snapshots
    that the chain does not name are left out; snapshots without rows compare
    as empty. Nulls in keys and values are values. ``leaf_bits`` sets the
    number of hash ranges of every snapshot (2 ** bits, in steps of FANOUT_BITS); by default it follows from the
    larger of two snapshots compared, LEAF_RECORDS to a range.
    """
    scratch = Scratch(rows.sparkSession, "snapshots")
    # snapshots get numbers, as their names would be carried through every step
    named = chain.select(F.col(snapshot).alias("snapshot"), "earlier")
    every = named.select("snapshot").unionByName(named.select(F.col("earlier").alias("snapshot"))).where("snapshot is not null").distinct()
    every = scratch.keep(every.select("snapshot", F.monotonically_increasing_id().alias("sid")))
    count = every.count()
    numbers = F.broadcast(every) if count <= SENT_SNAPSHOTS else every
    pairs = named.where("earlier is not null").join(every, "snapshot").select("earlier", F.col("sid").alias("later")).join(every.withColumnRenamed("snapshot", "earlier"), "earlier").select("later", F.col("sid").alias("before"))
    pairs = scratch.keep(pairs)

    fields = [f"k{i}" for i, _ in enumerate(keys)]
    plain = rows.select(F.col(snapshot).alias("snapshot"), *[F.col(k).alias(n) for k, n in zip(keys, fields)], F.col(value).alias("value"))
    of_chain = plain.join(numbers, "snapshot") if count <= SENT_SNAPSHOTS else lookup_join(plain, numbers, ["snapshot"], "inner")
    spread = [F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("")) for k in fields]
    digests = record_digests(of_chain, "sid", fields, "value").withColumn("h", F.xxhash64(*spread)).withColumn("h2", F.xxhash64(F.lit(3), *spread))
    digests = scratch.keep(digests)
    total = digests.count()

    # each pair is as deep as its larger side needs, each snapshot as its deepest pair
    sizes = scratch.keep(digests.groupBy("sid").count())
    of = lambda c: sizes.select(F.col("sid").alias(c), F.col("count").alias(f"n_{c}"))
    larger = F.greatest(F.coalesce("n_later", F.lit(0)), F.coalesce("n_before", F.lit(0)))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(larger / LEAF_RECORDS, F.lit(1.0))) / FANOUT_BITS)).cast("int") if leaf_bits is None else F.lit(math.ceil(leaf_bits / FANOUT_BITS))
    pairs = scratch.keep(pairs.join(of("later"), "later", "left").join(of("before"), "before", "left").select("later", "before", F.least(depth, F.lit(64 // FANOUT_BITS - 1)).alias("depth")))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("later").alias("sid"), "depth"), F.struct(F.col("before").alias("sid"), "depth"))).alias("e")).select("e.*").distinct()
    ends = scratch.keep(ends.groupBy("sid").agg(F.max("depth").alias("deepest"), F.collect_set("depth").alias("depths")))
    sent = ends if count > SENT_SNAPSHOTS else F.broadcast(ends)
    placed = lookup_join(digests, ends, ["sid"], "inner", rows=total) if count > SENT_SNAPSHOTS else digests.join(sent, "sid")

    deepest = ends.agg(F.coalesce(F.max("deepest"), F.lit(0))).first()[0]
    digest = [F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("m").alias("m")]
    bottom = placed.select("sid", F.col("deepest").alias("depth"), _node("h", F.col("deepest")).alias("node"), F.xxhash64("h", "h2", "d1", "d2", "n").alias("x1"), F.xxhash64(F.lit(5), "h", "h2", "d1", "d2", "n").alias("x2"), F.lit(1).alias("m"))
    bottom = scratch.keep(bottom.groupBy("sid", "depth", "node").agg(*digest))
    levels = {deepest: bottom.where(F.col("depth") == deepest).drop("depth")}
    for d in range(deepest - 1, -1, -1):
        below = levels[d + 1].select("sid", (F.shiftrightunsigned("node", FANOUT_BITS) if d else F.lit(0).cast("bigint")).alias("node"), "x1", "x2", "m").groupBy("sid", "node").agg(*digest)
        levels[d] = scratch.keep(below.unionByName(bottom.where(F.col("depth") == d).drop("depth")))

    # from the root down: the two sides of each pair at the children of the nodes that differed
    side = lambda c, n: F.struct(F.col(c).alias("sid"), F.lit(n).alias("side"))
    reached = pairs.select("later", "before", "depth", F.lit(0).cast("bigint").alias("parent"))
    leaves: DataFrame | None = None
    for d in range(deepest + 1):
        probes = reached.select("later", "before", "depth", "parent", F.explode(F.array(side("later", 1), side("before", 0))).alias("e")).select("later", "before", "depth", "parent", "e.*")
        level = levels[d].withColumn("parent", F.shiftrightunsigned("node", FANOUT_BITS) if d else F.lit(0).cast("bigint"))
        met = probes.join(level, ["sid", "parent"])
        # two sides that agree give one digest twice
        both = met.groupBy("later", "before", "depth", "node").agg(F.count(F.lit(1)).alias("c"), F.bit_xor("x1").alias("a"), F.bit_xor("x2").alias("b"), F.min("m").alias("lo"), F.max("m").alias("hi"))
        differing = scratch.keep(both.where((F.col("c") == 1) | (F.col("a") != 0) | (F.col("b") != 0) | (F.col("lo") != F.col("hi"))).select("later", "before", "depth", "node"))
        done = differing.where(F.col("depth") == d)
        leaves = done if leaves is None else leaves.unionByName(done)
        reached = differing.where(F.col("depth") > d).withColumnRenamed("node", "parent")

    at = leaves.select("later", "depth", "node", F.explode(F.array(side("later", 1), side("before", 0))).alias("e")).select("later", "depth", "node", "e.*")
    ranged = placed.select("sid", *fields, "d1", "d2", "n", "h", F.explode("depths").alias("depth")).withColumn("node", _node("h", F.col("depth"))).drop("h")
    touched = ranged.join(at, ["sid", "depth", "node"])
    records = touched.groupBy("later", *fields).agg(
        F.min("side").alias("lo"), F.max("side").alias("hi"), F.bit_xor("d1").alias("a"), F.bit_xor("d2").alias("b"), F.min("n").alias("n0"), F.max("n").alias("n1")
    )
    differs = (F.col("a") != 0) | (F.col("b") != 0) | (F.col("n0") != F.col("n1"))
    change = F.when(F.col("lo") == 1, "added").when(F.col("hi") == 0, "removed").when(differs, "changed")
    found = records.select(F.col("later").alias("sid"), *fields, change.alias("change")).where(F.col("change").isNotNull())
    back = found.join(numbers, "sid") if count <= SENT_SNAPSHOTS else lookup_join(scratch.keep(found), every, ["sid"], "inner")
    return back.select(F.col("snapshot").alias(snapshot), *[F.col(n).alias(k) for k, n in zip(keys, fields)], "change")


def run_changes(quads: DataFrame, graphs: DataFrame, leaf_bits: int | None = None) -> DataFrame:
    """(graph_id, s, p, change) of every run graph against its host's run before, quads with a blank node left out (a null kind is no blank node)."""
    kind = lambda c: F.coalesce(F.col(c), F.lit("")) != "bnode"
    return diff_snapshots(quads.where(kind("s_kind") & kind("o_kind")), run_chain(graphs), "graph_id", ["s", "p"], "o", leaf_bits)

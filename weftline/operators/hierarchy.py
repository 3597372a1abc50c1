"""Parent-child links to full hierarchies by tree contraction.

Each round rakes the leaves and splices out an independent set of the nodes
with exactly one child, so that the number of nodes that are left falls by a
constant factor whatever the shape of the trees, long chains included. What a
round takes out is recorded with the node it then pointed to and the distance.
Reading the records backwards gives root, depth and path of every node. A loop
cannot be raked: splicing shrinks it to one node that points to itself, and
all that was contracted into such a core is on a loop or leads into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import lookup_join
from ..plans.storage import Scratch

_LEFT, _RAKED, _SPLICED, _CORE = 0, 1, 2, 3
_RESOLVED = T.StructType(
    [T.StructField(n, t) for n, t in (("scope", T.StringType()), ("node", T.StringType()), ("root", T.StringType()), ("depth", T.LongType()), ("path", T.ArrayType(T.StringType())))]
)


def _round(edges: DataFrame, number: int, paths: bool) -> DataFrame:
    """One round over edges (scope, node, up, w, between): the same rows with act and, where the node above was spliced out, the new pointer."""
    children = edges.groupBy("scope", F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
    flip = lambda c: F.xxhash64(F.col("scope"), c, F.lit(number)).bitwiseAND(F.lit(1)) == 1
    judged = edges.join(children, ["scope", "node"], "left").withColumn(
        "act",
        F.when(F.col("node") == F.col("up"), _CORE).when(F.col("n").isNull(), _RAKED).when((F.col("n") == 1) & flip(F.col("node")) & ~flip(F.col("child")), _SPLICED).otherwise(_LEFT),
    )
    spliced = judged.where(F.col("act") == _SPLICED).select("scope", F.col("child").alias("node"), F.col("node").alias("via"), F.col("up").alias("up2"), F.col("w").alias("w2"), F.col("between").alias("between2"))
    joined = judged.drop("n", "child").join(spliced, ["scope", "node"], "left")
    between = F.when(F.col("via").isNull(), F.col("between")).otherwise(F.concat("between2", F.array("via"), "between")) if paths else F.col("between")
    return joined.select("scope", "node", F.coalesce("up2", "up").alias("up"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), between.alias("between"), "act")


def contract(links: DataFrame, paths: bool = False) -> DataFrame:
    """Root and depth, and with ``paths`` the path, of every node that has a parent.

    ``links`` has scope, node, parent (strings); other columns are ignored.
    Returns (scope, node, root, depth, path): path runs from the root to the
    node; on a loop or leading into one root and path are null and depth is -1.
    Nodes that only occur as a parent get no row. Rows with a null node or
    parent are no links; a null scope is a scope of its own. Repeated links
    count once; where a node has several parents, the smallest by code point
    stands. An empty table gives an empty result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    edges = (
        links.where(F.col("node").isNotNull() & F.col("parent").isNotNull())
        .groupBy(F.concat(F.lit("="), F.col("scope")).alias("scope"), F.col("node").cast("string").alias("node"))
        .agg(F.min(F.col("parent").cast("string")).alias("up"))
        .select(F.coalesce("scope", F.lit("")).alias("scope"), "node", "up", F.lit(1).cast("long").alias("w"), F.array().cast("array<string>").alias("between"))
    )
    rounds: list[tuple[DataFrame, int]] = []
    table, number = edges, 0
    while True:
        done = scratch.keep(_round(table, number, paths))
        counts = {r["act"]: r["count"] for r in done.groupBy("act").count().collect()}  # at most four rows
        rounds.append((done, sum(n for a, n in counts.items() if a in (_RAKED, _SPLICED))))
        if not counts.get(_LEFT):
            break
        table, number = done.where(F.col("act") == _LEFT).drop("act"), number + 1

    # A core is resolved from the start; everything contracted into it takes over its null root.
    cores = [done.where(F.col("act") == _CORE).select("scope", "node", F.lit(None).cast("string").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path")) for done, _ in rounds]
    first = cores[0]
    for more in cores[1:]:
        first = first.unionByName(more)
    written = [scratch.write(first)]
    for done, rows in reversed(rounds):
        if not rows:
            continue
        known = scratch.read(_RESOLVED, *written).select("scope", F.col("node").alias("up"), "root", "depth", "path", F.lit(True).alias("met"))
        taken = done.where(F.col("act").isin(_RAKED, _SPLICED)).drop("act")
        met, looped = F.col("met").isNotNull(), F.col("depth") < 0
        path = F.when(met & looped, F.lit(None)).otherwise(F.concat(F.when(met, F.col("path")).otherwise(F.array("up")), "between", F.array("node"))) if paths else F.lit(None).cast("array<string>")
        written.append(
            scratch.write(
                lookup_join(taken, known, ["scope", "up"], rows=rows).select(
                    "scope",
                    "node",
                    F.when(~met, F.col("up")).otherwise(F.col("root")).alias("root"),
                    F.when(~met, F.col("w")).when(looped, F.lit(-1)).otherwise(F.col("depth") + F.col("w")).cast("long").alias("depth"),
                    path.alias("path"),
                )
            )
        )
    out = scratch.read(_RESOLVED, *written)
    return out.withColumn("scope", F.when(F.col("scope") == "", F.lit(None)).otherwise(F.substring("scope", 2, 1 << 30)))


def closure(resolved: DataFrame) -> DataFrame:
    """(scope, ancestor, node, distance) for every node of ``contract(links, paths=True)`` and each node above it, nodes on or leading into loops left out."""
    up = resolved.where(F.col("path").isNotNull()).select("scope", "node", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor"))
    return up.where(F.col("pos") < F.col("n") - 1).select("scope", "ancestor", "node", (F.col("n") - 1 - F.col("pos")).cast("long").alias("distance"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """(scope, ancestor, n_descendants, n_children, height), counted with partial aggregation, so a root above a third of all rows loads no single task."""
    return closure(resolved).groupBy("scope", "ancestor").agg(
        F.count(F.lit(1)).alias("n_descendants"),
        F.sum((F.col("distance") == 1).cast("long")).alias("n_children"),
        F.max("distance").alias("height"),
    )


def _filled(c: str) -> F.Column:
    """The trimmed value, null where blank."""
    return F.when(F.trim(c) != "", F.trim(c))


def entity_links(entities: DataFrame) -> DataFrame:
    """(scope, node, parent) of the registry: the trimmed part_of of any row of an id, else the trimmed parent_org of any row."""
    one = entities.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("node")).agg(F.min(_filled("part_of")).alias("a"), F.min(_filled("parent_org")).alias("b"))
    return one.select(F.lit("entity").alias("scope"), "node", F.coalesce("a", "b").alias("parent")).where(F.col("parent").isNotNull())


def decision_links(decisions: DataFrame) -> DataFrame:
    """(scope, node, parent) of the decisions that stand.

    Of the rows with equal vertical_id and key the one with the greatest
    event_id stands (a null event_id is smallest, a null vertical_id or key is
    a value like others). An approved one with a broader links its label, or
    its key where the label is blank, to that broader, trimmed and lower-cased.
    """
    last = decisions.groupBy("vertical_id", "key").agg(F.max_by(F.struct("decision", "label", "broader"), F.coalesce(F.concat(F.lit("="), "event_id"), F.lit(""))).alias("d"))
    return last.where(F.col("d.decision") == "approve").select(
        F.col("vertical_id").alias("scope"),
        F.lower(F.coalesce(_filled("d.label"), _filled("key"))).alias("node"),
        F.lower(_filled("d.broader")).alias("parent"),
    ).where(F.col("node").isNotNull() & F.col("parent").isNotNull())

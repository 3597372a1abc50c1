"""Consolidating pairwise matches into groups: hash-to-min.

Every vertex holds a cluster, first itself and its neighbours. In each round it
sends its cluster to the cluster's smallest member and that member to all
others. When nothing changes, the smallest vertex of a group holds the whole
group and all others hold it. Clusters are kept as rows (vertex, member), never
as one value, so a group of billions is as well spread as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Scratch


def _state(clusters: DataFrame) -> tuple:
    return tuple(clusters.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first())


def connected_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id) of every id in a group of two or more; group_id is the group's smallest id by code point.

    Links hold in both directions and over any number of steps. Links with a
    null end and of an id to itself join nothing; repeated links count once.
    No links give no groups.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "groups")
    one = links.select(F.col(a).cast("string").alias("v"), F.col(b).cast("string").alias("u")).where(F.col("v") != F.col("u"))
    both = one.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))).alias("e"))
    clusters = both.select("e.v", "e.u").distinct()
    path = scratch.write(clusters)
    clusters = scratch.read(clusters.schema, path)
    state = _state(clusters)
    while state[0]:
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        sent = lookup_join(clusters, least, ["v"], "inner", rows=state[0])
        sent = sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        # v itself is a member of its cluster, so it hears of m like the others
        following = scratch.write(sent.select("e.v", "e.u").distinct())
        scratch.drop(path)
        path = following
        clusters = scratch.read(clusters.schema, path)
        before, state = state, _state(clusters)
        if before == state:
            break
    return clusters.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("group_id"))


def merge_links(entities: DataFrame) -> DataFrame:
    """(a, b): each row's id with its trimmed merged_into where that is not blank."""
    return entities.select(F.col("id").alias("a"), F.trim("merged_into").alias("b")).where((F.col("b") != "") & F.col("a").isNotNull())


def merged_groups(entities: DataFrame) -> DataFrame:
    """(id, group_id) of all ids of the registry that merged_into joins."""
    return connected_groups(merge_links(entities))

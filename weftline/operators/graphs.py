"""Centrality and clusters of directed weighted graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Scratch


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) of a graph with edges (src, dst, weight, ord).

    Of parallel edges the last by ord gives the weight. Ranks add up to 1; nodes
    without a way out give theirs to all nodes alike. A round sums over
    incoming edges with partial aggregation; it ends after ``rounds`` rounds or when the ranks move by less
    than nodes * tolerance together. Rows with a null end are left out; no edges give no nodes.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "pagerank")
    one = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy("src", "dst").agg(F.max_by("weight", F.struct("ord", "weight")).alias("w"))
    one = scratch.keep(one)
    out = one.groupBy("src").agg(F.sum("w").alias("out"))
    nodes = scratch.keep(one.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    m = one.count()
    # a hub may have a third of all edges: its outgoing weight is joined without moving them
    shares = scratch.keep(lookup_join(one, out, ["src"], "inner", rows=m).select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    ranks = nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left").select("node", F.lit(1.0 / n).alias("rank"), F.coalesce("leads", F.lit(False)).alias("leads"))
    path = scratch.write(ranks)
    ranks = scratch.read(ranks.schema, path)
    for _ in range(rounds):
        dangling = ranks.where(~F.col("leads")).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = lookup_join(shares, ranks.select(F.col("node").alias("src"), "rank"), ["src"], "inner", rows=m).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        following = ranks.join(sent, "node", "left").select("node", (F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "leads", F.col("rank").alias("old"))
        new_path = scratch.write(following)
        read = scratch.read(following.schema, new_path)
        moved = read.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        scratch.drop(path)
        path, ranks = new_path, read.drop("old")
        if moved < n * tolerance:
            break
    return ranks.select("node", "rank")


def clusters(nodes: DataFrame, members: int = 10) -> DataFrame:
    """(kind, size, members): the nodes (kind, name, ord) of each kind and the first of them."""
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), 1, members)
    ranked = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    from .quads import top

    heads = top(nodes, ["kind"], [F.col("ord"), F.col("name")], members).groupBy("kind").agg(first.alias("members"))
    return ranked.join(heads, "kind")

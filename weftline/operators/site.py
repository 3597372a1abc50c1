"""A site's graph put together: what its pages state, resolved, merged and written as one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extraction, knowledge, quads
from . import vocabulary as V


@dataclass
class SiteGraph:
    """edges (graph_id, source, predicate, target, confidence, sentence, url), nodes (graph_id, node, label, kind, mentions, pages), schema (source_type, predicate, target_type, n, first), quads, headers (graph_id, kind, domain, vertical_id, created_at, metadata)."""

    edges: DataFrame
    nodes: DataFrame
    schema: DataFrame
    quads: DataFrame
    headers: DataFrame


def run_id(site: Column, time: Column) -> Column:
    """The graph id of a site's run at a time."""
    return F.concat(F.lit("https://"), site, F.lit("/audit/"), F.date_format(time, "yyyyMMdd'T'HHmmss'Z'"))


def site_graphs(pages: DataFrame, concepts: DataFrame, time: Column, base: str, entities: DataFrame | None = None) -> SiteGraph:
    """The graphs of all sites of pages (site, url, text, vertical_id), each a run at ``time``.

    Every relation that a page states about the vocabulary is an edge from the
    site to a concept; edges that pages share are merged, the surest confidence
    and the fullest sentence standing. Nodes are the sites and the concepts they name,
    with the pages that name them. Concepts that an entry of the registry (entities: form, id) is
    named like by one only are that entry. A site whose pages state nothing has a header and no
    more; pages without site or url are left out.
    """
    read = pages.where(F.col("site").isNotNull() & F.col("url").isNotNull())
    per_url = read.groupBy("site", "url").agg(F.min("text").alias("text")).withColumn("page", F.struct("site", "url"))
    facts = extraction.triples(per_url.select(F.to_json("page").alias("page"), "text"), "page", V.vocabulary(concepts))
    facts = facts.withColumn("at", F.from_json("page", "struct<site:string,url:string>"))
    known = concepts.groupBy("id").agg(F.min("preflabel").alias("label"), F.min("kind").alias("kind"))
    stated = facts.join(known, facts["object"] == known["id"]).select(F.col("at.site").alias("site"), F.col("at.url").alias("url"), "predicate", "label", "kind", "confidence", F.col("evidence").alias("sentence"), F.col("id").alias("concept"))
    if entities is not None:
        named = knowledge.grounded(known.select(F.col("label").alias("phrase")), entities).where("entry is not null").withColumnRenamed("phrase", "label")
        stated = stated.join(named, "label", "left")
    else:
        stated = stated.withColumn("entry", F.lit(None).cast("string"))
    graph = run_id(F.col("site"), time)
    stated = stated.select(graph.alias("graph_id"), "site", "url", "predicate", "label", "kind", "confidence", "sentence", F.coalesce("entry", "concept").alias("node"))
    edges = quads.merged_edges(stated.select("graph_id", F.col("site").alias("source"), "predicate", F.col("node").alias("target"), "confidence", "sentence", "url", F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("bigint").alias("ord")))
    nodes = stated.groupBy("graph_id", "node").agg(F.min("label").alias("label"), F.min("kind").alias("kind"), F.count(F.lit(1)).alias("mentions"), F.count_distinct("url").alias("pages"))
    kinds = nodes.select("graph_id", F.col("node").alias("target"), knowledge.canonical_class(F.col("kind")).alias("target_type"))
    schema = quads.induced_schema(edges.join(kinds, ["graph_id", "target"]).withColumn("source_type", F.lit("Organization")).withColumn("ord", F.col("url")))
    triples = edges.join(nodes.select("graph_id", F.col("node").alias("target"), "label"), ["graph_id", "target"]).select("graph_id", F.col("source").alias("subject"), "predicate", F.col("label").alias("object"), F.col("sentence").alias("evidence"), "url")
    made = knowledge.rdf_of_triples(triples, base).withColumn("o_datatype", F.lit(None).cast("string")).withColumn("o_lang", F.lit(None).cast("string")).select(*quads.QUADS.names)
    totals = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("target").alias("nodes"))
    sites = read.groupBy("site").agg(F.count_distinct("url").alias("pages"), F.min("vertical_id").alias("vertical_id")).withColumn("graph_id", graph)
    meta = F.to_json(F.struct(F.col("pages").alias("pages_crawled"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges")))
    headers = sites.join(totals, "graph_id", "left").select("graph_id", F.lit("run").alias("kind"), F.col("site").alias("domain"), "vertical_id", time.cast("timestamp_ntz").alias("created_at"), meta.alias("metadata"))
    return SiteGraph(edges, nodes, schema, made, headers)

"""The quad store: scans, idempotent writes, run listings, diffs and coverage.

A quad is (graph_id, s, s_kind, p, o, o_kind, o_datatype, o_lang); its graph is
described by one row of graphs (graph_id, kind, domain, vertical_id,
created_at, metadata). All operators are plain relational plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUADS = T.StructType([T.StructField(c, T.StringType()) for c in ("graph_id", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")])
GRAPHS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("graph_id", "kind", "domain", "vertical_id")], T.StructField("created_at", T.TimestampNTZType()), T.StructField("metadata", T.StringType())])
KINDS = ("ontology", "run", "situations")
#: What identifies a quad within the store; the kind of the subject does not.
KEY = ("graph_id", "s", "p", "o", "o_kind", "o_datatype", "o_lang")
#: Predicates that describe a claim and are none (fixed values).
PROVENANCE = ("prov:", "dcterms:", "rdf:")


def scan_graph(quads: DataFrame, graph_id: str) -> DataFrame:
    """The terms of one graph. A datatype is kept over a language; the predicate is always an IRI."""
    lang = F.when(F.col("o_datatype").isNull(), F.col("o_lang"))
    term = lambda v, k: F.struct(F.col(v).alias("value"), F.col(k).alias("kind"))
    return quads.where(F.col("graph_id") == graph_id).select(term("s", "s_kind").alias("s"), "p", F.struct(F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_datatype").alias("datatype"), lang.alias("lang")).alias("o"))


def scan_dataset(quads: DataFrame, graph_ids: list[str] | None = None) -> DataFrame:
    """The quads of all or of the named graphs, each under its graph's name: graphs are never merged."""
    return quads if graph_ids is None else quads.where(F.col("graph_id").isin(graph_ids))


def list_runs(graphs: DataFrame, quads: DataFrame, domain: str | None = None, limit: int | None = 50) -> DataFrame:
    """The run graphs, newest first, with the number of their quads; ``limit`` None lists all. No or an empty domain is no filter. Ties and null times end by graph_id."""
    runs = graphs.where(F.col("kind") == "run")
    if domain:
        runs = runs.where(F.col("domain") == domain)
    counts = quads.groupBy("graph_id").agg(F.count(F.lit(1)).alias("quads"))
    listed = runs.join(counts, "graph_id", "left").na.fill(0, ["quads"])
    return listed if limit is None else listed.orderBy(F.desc_nulls_last("created_at"), "graph_id").limit(limit)


def store_stats(graphs: DataFrame, quads: DataFrame) -> DataFrame:
    """(name, value): graphs by kind, all quads, and distinct domains that are not null."""
    kinds = graphs.groupBy(F.concat(F.lit("graphs:"), F.coalesce("kind", F.lit(""))).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return kinds.unionByName(quads.agg(F.count(F.lit(1)).alias("value")).select(F.lit("quads").alias("name"), "value")).unionByName(
        graphs.agg(F.count_distinct("domain").alias("value")).select(F.lit("domains").alias("name"), "value")
    )


def new_quads(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming quads that the store does not hold, each once: what an idempotent insert writes. Null datatype and language equal empty ones."""
    keyed = lambda df: df.withColumns({f"__{c}": F.coalesce(F.col(c), F.lit("")) for c in KEY})
    names = [f"__{c}" for c in KEY]
    fresh = keyed(incoming).groupBy(*names).agg(*[F.min_by(c, F.struct("s_kind", *[F.col(k) for k in KEY])).alias(c) for c in ("s_kind", "o_datatype", "o_lang")])
    fresh = fresh.join(keyed(existing).select(*names), names, "left_anti")
    return fresh.select(F.col("__graph_id").alias("graph_id"), F.col("__s").alias("s"), "s_kind", F.col("__p").alias("p"), F.col("__o").alias("o"), F.col("__o_kind").alias("o_kind"), "o_datatype", "o_lang")


def append_quads(existing: DataFrame, incoming: DataFrame, path: str) -> None:
    """Write the quads that the store at ``path`` does not hold yet; writing the same graph again writes nothing."""
    new_quads(existing, incoming).write.mode("append").partitionBy("graph_id").parquet(path)


def replaced(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after the graphs of ``incoming`` have been replaced by it: their old quads go, all others stay."""
    kept = existing.join(incoming.select("graph_id").distinct(), "graph_id", "left_anti").select(*QUADS.names)
    return kept.unionByName(new_quads(existing.limit(0), incoming))


def replace_graphs(incoming: DataFrame, path: str) -> None:
    """Replace the graphs of ``incoming`` in the store at ``path``: only their partitions are written."""
    new_quads(incoming.limit(0), incoming).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(path)


def split_by_namespace(quads: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(ontology, instances): quads whose subject begins with ``base``, and the others."""
    own = F.coalesce(F.col("s").startswith(base), F.lit(False))
    return quads.where(own), quads.where(~own)


def upsert_graphs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The graph rows after an upsert: all values of the incoming row, but the time of the first one stays."""
    old = existing.select(F.col("graph_id"), F.col("created_at").alias("since"))
    fresh = incoming.join(old, "graph_id", "left").withColumn("created_at", F.coalesce("since", "created_at")).drop("since")
    return existing.join(incoming.select("graph_id"), "graph_id", "left_anti").unionByName(fresh.select(*existing.columns))


def is_claim(p: Column) -> Column:
    """Whether a predicate states something itself and is not about a statement."""
    out = F.lit(True)
    for prefix in PROVENANCE:
        out = out & ~p.startswith(prefix)
    return out


def diff_runs(quads: DataFrame, pairs: DataFrame, claims_only: bool = False) -> DataFrame:
    """(later, s, p, o, side) for each row of ``pairs`` (later, earlier): triples of one run that the other lacks.

    Set semantics over (s, p, o): kinds, datatypes, languages and repeats do
    not matter. One aggregation compares all pairs at once, with a row per
    distinct triple and side.
    """
    rows = quads.where(is_claim(F.col("p"))) if claims_only else quads
    rows = rows.select("graph_id", "s", "p", "o")
    later = rows.join(pairs.select(F.col("later").alias("graph_id")), "graph_id").select(F.col("graph_id").alias("later"), "s", "p", "o", F.lit(1).alias("at"))
    earlier = rows.join(pairs.select(F.col("earlier").alias("graph_id"), "later"), "graph_id").select("later", "s", "p", "o", F.lit(2).alias("at"))
    seen = later.unionByName(earlier).groupBy("later", "s", "p", "o").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return seen.where(F.col("lo") == F.col("hi")).select("later", "s", "p", "o", F.when(F.col("lo") == 1, "added").otherwise("removed").alias("side"))


def vendors_covering(quads: DataFrame, graphs: DataFrame, concept: str | None = None) -> DataFrame:
    """(concept, domain, runs, last_seen): the domains whose runs name a concept, for one concept or for every IRI object under ``/concept/``."""
    named = quads.where(F.col("o_kind") == "uri").where(F.col("o") == concept if concept else F.col("o").contains("/concept/"))
    runs = graphs.where(F.col("kind") == "run").select("graph_id", "domain", "created_at")
    found = named.select("graph_id", F.col("o").alias("concept")).distinct().join(runs, "graph_id")
    return found.groupBy("concept", "domain").agg(F.count_distinct("graph_id").alias("runs"), F.max("created_at").alias("last_seen"))


def crawled_at(graph_id: Column) -> Column:
    """The time in a run graph's id, null where there is none."""
    return F.try_to_timestamp(F.regexp_extract(graph_id, r"/audit/(\d{8}T\d{6})Z$", 1), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def run_numbers(graphs: DataFrame) -> DataFrame:
    """(graph_id, crawled_at, pages, budget): what a run's id and metadata tell; broken metadata tells nothing."""
    number = lambda f: F.get_json_object("metadata", f"$.{f}").try_cast("int")
    return graphs.where(F.col("kind") == "run").select("graph_id", "domain", "vertical_id", crawled_at(F.col("graph_id")).alias("crawled_at"), F.coalesce(number("pages_crawled"), F.lit(0)).alias("pages"), number("pages_requested").alias("budget"))


def usable_runs(graphs: DataFrame, quads: DataFrame, budget: int) -> DataFrame:
    """(domain, run, pages, other_runs): each domain's newest run with quads at the budget; an unrecorded budget counts where exactly so many pages were read. A domain without one has a null run."""
    filled = run_numbers(graphs).where(F.col("domain").isNotNull()).join(quads.select("graph_id").distinct(), "graph_id", "left_semi")
    at = (F.col("budget") == budget) | (F.col("budget").isNull() & (F.col("pages") == budget))
    found = filled.groupBy("domain").agg(F.max(F.when(at, F.struct("crawled_at", "graph_id", "pages"))).alias("r"), F.count(F.lit(1)).alias("n"))
    return found.select("domain", F.col("r.graph_id").alias("run"), F.col("r.pages").alias("pages"), (F.col("n") - F.col("r").isNotNull().cast("int")).alias("other_runs"))


def concept_states(quads: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, concept, state, claims): concepts a run claims in statements about its own brand, or only mentions.

    The brand is the run's smallest subject typed as organisation page; a claim
    is a statement whose subject is the brand and whose object is a concept.
    """
    rows = quads.join(runs.select(F.col("run").alias("graph_id")), "graph_id", "left_semi").select("graph_id", "s", "p", "o").distinct()
    about = rows.where(F.col("p").isin("rdf:type", "rdf:object", "rdf:subject"))
    statement = about.groupBy("graph_id", "s").agg(
        F.bool_or((F.col("p") == "rdf:type") & (F.col("o") == "rdf:Statement")).alias("is_statement"),
        F.min(F.when(F.col("p") == "rdf:object", F.col("o"))).alias("concept"),
        F.min(F.when(F.col("p") == "rdf:subject", F.col("o"))).alias("subject"),
    )
    claims = statement.where("is_statement").where(F.col("concept").contains("/concept/")).where(F.col("subject").isNull() | F.col("subject").endswith("#org"))
    claimed = claims.groupBy("graph_id", "concept").agg(F.count(F.lit(1)).alias("claims"))
    seen = rows.where(F.col("o").contains("/concept/")).select("graph_id", F.col("o").alias("concept")).distinct()
    both = seen.join(claimed, ["graph_id", "concept"], "left")
    return both.select(F.col("graph_id").alias("run"), "concept", F.when(F.col("claims").isNotNull(), "claimed").otherwise("mentioned").alias("state"), F.coalesce("claims", F.lit(0)).alias("claims"))


def coverage_matrix(concepts: DataFrame, companies: DataFrame, states: DataFrame) -> DataFrame:
    """(vertical_id, concept, domain, role, state) of every concept and company of a vertical.

    ``companies`` has vertical_id, domain, role (customer or competitor) and run
    (null: not read); ``concepts`` vertical_id and concept. A concept is not_read where the company has no run, else
    claimed, mentioned or not_found. The pairing is an equi-join on the vertical:
    the concept list is fixed, so its output is the matrix itself.
    """
    cells = companies.join(concepts, "vertical_id").join(states.select("run", "concept", F.col("state").alias("found")), ["run", "concept"], "left")
    return cells.select("vertical_id", "concept", "domain", "role", F.when(F.col("run").isNull(), "not_read").otherwise(F.coalesce("found", F.lit("not_found"))).alias("state"))


def verdicts(matrix: DataFrame) -> DataFrame:
    """(vertical_id, concept, verdict): who claims a concept: both, customer_only, competitor_only or neither."""
    claims = lambda role: F.bool_or((F.col("role") == role) & (F.col("state") == "claimed"))
    both = matrix.groupBy("vertical_id", "concept").agg(claims("customer").alias("ours"), claims("competitor").alias("theirs"))
    return both.select("vertical_id", "concept", F.when(F.col("ours") & F.col("theirs"), "both").when(F.col("ours"), "customer_only").when(F.col("theirs"), "competitor_only").otherwise("neither").alias("verdict"))


def company_shares(matrix: DataFrame) -> DataFrame:
    """(vertical_id, domain, claimed, mentioned, not_found, not_read, determinate_share): how much of the list each company's pages settle."""
    states = ("claimed", "mentioned", "not_found", "not_read")
    counts = matrix.groupBy("vertical_id", "domain").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states], F.count(F.lit(1)).alias("n"))
    return counts.withColumn("determinate_share", F.round((F.col("claimed") + F.col("mentioned")) / F.col("n"), 3)).drop("n")


def companies_of_runs(graphs: DataFrame, quads: DataFrame, budget: int) -> DataFrame:
    """(vertical_id, domain, role, run): of each vertical the domain that comes first by code point as the customer, all others as its competitors."""
    runs = usable_runs(graphs, quads, budget)
    homes = graphs.where((F.col("kind") == "run") & F.col("domain").isNotNull() & F.col("vertical_id").isNotNull()).select("vertical_id", "domain").distinct()
    first = homes.groupBy("vertical_id").agg(F.min("domain").alias("customer"))
    return homes.join(first, "vertical_id").join(runs, "domain").select("vertical_id", "domain", F.when(F.col("domain") == F.col("customer"), "customer").otherwise("competitor").alias("role"), "run")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: the greatest by ``order`` and then by the whole row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def merged_edges(edges: DataFrame) -> DataFrame:
    """(graph_id, source, predicate, target, confidence, sentence, url) with each edge once.

    ``edges`` also has ord. The greatest confidence stands; the longest sentence stands with its own
    url, the earlier on a tie; edges from a node to itself are dropped.
    """
    kept = edges.where(F.col("source") != F.col("target"))
    best = F.max_by(F.struct("sentence", "url"), F.struct(F.coalesce(F.length("sentence"), F.lit(-1)), -F.col("ord")))
    return kept.groupBy("graph_id", "source", "predicate", "target").agg(F.max("confidence").alias("confidence"), best.alias("b")).select("graph_id", "source", "predicate", "target", "confidence", "b.sentence", "b.url")


def induced_schema(edges: DataFrame) -> DataFrame:
    """(source_type, predicate, target_type, n, first): how often each kind of relation occurs; untyped ends are Entity."""
    kind = lambda c: F.coalesce(F.col(c), F.lit("Entity")).alias(c)
    return edges.groupBy(kind("source_type"), "predicate", kind("target_type")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the window is cut to n rows per group before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)

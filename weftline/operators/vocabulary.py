"""Vocabularies: finding their forms in texts, classifying by them, and what texts cover.

Forms are matched as runs of whole words: a list of bounded size by a walk over
each text, a longer one by an equi-join of the texts' runs with it. Nothing is
shuffled before the result is aggregated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import urls
from ..plans.spread import spread
from ..plans.storage import Scratch

#: Forms that are sent to the tasks at most.
SENT = 200_000


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def vocabulary(concepts: DataFrame) -> DataFrame:
    """(vertical_id, concept_id, kind, form, canonical) of every label and other label, as words in lower case; blank ones are left out."""
    main = concepts.select("vertical_id", F.col("id").alias("concept_id"), "kind", F.col("preflabel").alias("label"), F.lit(True).alias("canonical"))
    other = concepts.select("vertical_id", F.col("id").alias("concept_id"), "kind", F.explode("altlabels").alias("label"), F.lit(False).alias("canonical"))
    forms = main.unionByName(other).withColumn("form", F.array_join(words(F.col("label")), " "))
    return forms.where(F.coalesce("form", F.lit("")) != "").groupBy("vertical_id", "concept_id", "kind", "form").agg(F.bool_or("canonical").alias("canonical"))


def occurrences(texts: DataFrame, keys: list[str], forms: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., pos, n, and the columns of ``forms``) of every place where a form stands in a text. Null texts hold none.

    A list of at most SENT forms is sent to the tasks, which walk each text
    once; a longer one is joined with all runs of as many words as its longest form has.
    """
    spark = texts.sparkSession
    listed = [r[0] for r in forms.select("form").distinct().limit(SENT + 1).collect()]
    if len(listed) > SENT:
        longest = forms.agg(F.max(F.size(F.split("form", " ")))).first()[0]
        # the words are a column of their own, as an expression within a lambda is computed for every element
        worded = texts.select(*keys, words(F.col(text)).alias("__words")).where(F.size("__words") > 0)
        runs = worded.select(*keys, F.explode(tx.ngrams(F.col("__words"), longest)).alias("g")).select(*keys, F.col("g.pos").alias("pos"), F.col("g.n").alias("n"), F.col("g.gram").alias("form"))
        return runs.join(forms, "form")
    sent = spark.sparkContext.broadcast(listed)
    one = spread(texts.select(F.col(text).alias("__text"), *keys), texts)
    schema = T.StructType([*one.schema.fields[1:], T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("form", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin: dict[str, set[int]] = {}
        for f in sent.value:
            w = f.split(" ")
            begin.setdefault(w[0], set()).add(len(w))
        starts, known = {w: sorted(ns) for w, ns in begin.items()}, set(sent.value)
        find = re.compile("[a-z0-9]+").findall
        for b in batches:
            rows, at, size, form = [], [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                if not t:
                    continue
                w = find(t.lower())
                for k in [k for k, x in enumerate(w) if x in starts]:
                    for n in starts[w[k]]:
                        f = w[k] if n == 1 else " ".join(w[k : k + n])
                        if f in known and k + n <= len(w):
                            rows.append(i)
                            at.append(k + 1)
                            size.append(n)
                            form.append(f)
            took = [c.take(pa.array(rows, pa.int64())) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([*took, pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(form, pa.string())], schema.names)

    return one.mapInArrow(walk, schema).join(forms, "form")


def longest_first(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., pos, n, form): of overlapping places the longer, and the one further left, stand."""
    spans = found.select(*keys, F.struct("pos", "n", "form").alias("x")).groupBy(*keys).agg(F.collect_set("x").alias("xs"))
    return spans.select(*keys, F.explode(tx.pick_spans(F.col("xs"))).alias("x")).select(*keys, "x.pos", "x.n", "x.form")


def lookup(forms: DataFrame, key: str, id_: str) -> DataFrame:
    """(key, n, id): how many entries a key names, and which where it is only one: 0 is unknown, 2 and more ambiguous."""
    return forms.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(id_).alias("n"), F.min(id_).alias("one")).select(key, "n", F.when(F.col("n") == 1, F.col("one")).alias(id_))


def by_domain(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, domain, id): the entry with the longest dotted ending of a host. ``hosts`` has host, ``entries`` domain and id."""
    ends = hosts.where(F.col("host").isNotNull()).select("host", F.posexplode(urls.suffixes(F.col("host"))).alias("rank", "domain"))
    found = ends.join(entries.select("domain", "id"), "domain")
    return found.groupBy("host").agg(F.min(F.struct("rank", "id", "domain")).alias("m")).select("host", "m.domain", "m.id")


def evidence(found: DataFrame, key: str, distinctive: bool = False) -> DataFrame:
    """(key, vertical_id, terms): distinct forms of each vertical in a text; with ``distinctive`` without forms that more than one vertical has."""
    terms = found.select(key, "vertical_id", "form").distinct()
    if distinctive:
        shared = found.select("form", "vertical_id").distinct().groupBy("form").count().where(F.col("count") > 1).select("form")
        terms = terms.join(shared, "form", "left_anti")
    return terms.groupBy(key, "vertical_id").agg(F.count(F.lit(1)).alias("terms"))


def classify(counts: DataFrame, key: str, least: int = 5, lead: float = 1.5, confident: int = 10) -> DataFrame:
    """(key, vertical_id, best, runner_up, confident): the vertical with most evidence, null where it has fewer than ``least`` terms or less than ``lead`` times the next. Ties end by vertical."""
    order = Window.partitionBy(key).orderBy(F.desc("terms"), "vertical_id")
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2)
    two = ranked.groupBy(key).agg(F.max(F.when(F.col("place") == 1, F.struct("terms", "vertical_id"))).alias("a"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("terms"))), F.lit(0)).alias("runner_up"))
    sure = (F.col("a.terms") >= least) & (F.col("a.terms") >= F.col("runner_up") * lead)
    return two.select(key, F.when(sure, F.col("a.vertical_id")).alias("vertical_id"), F.col("a.terms").alias("best"), "runner_up", (sure & (F.col("a.terms") >= confident)).alias("confident"))


def coverage(found: DataFrame, key: str, concepts: DataFrame) -> DataFrame:
    """(key, vertical_id, covered, total, score) for each key and vertical that it names: the share of the vertical's concepts, in percent to one digit."""
    totals = concepts.groupBy("vertical_id").agg(F.count_distinct("id").alias("total"))
    covered = found.groupBy(key, "vertical_id").agg(F.count_distinct("concept_id").alias("covered"))
    return covered.join(totals, "vertical_id").select(key, "vertical_id", "covered", "total", F.round(F.least(F.lit(100.0), F.col("covered") * 100 / F.greatest("total", F.lit(1))), 1).alias("score"))


def gaps(found: DataFrame, key: str, site: str | None = None) -> DataFrame:
    """(key, concept_id, others, priority): concepts a site lacks that others of its vertical have, High from two others on."""
    has = found.select(key, "vertical_id", "concept_id").distinct()
    sites = has.select(key, "vertical_id").distinct()
    sites = sites if site is None else sites.where(F.col(key) == site)
    spread = has.groupBy("vertical_id", "concept_id").agg(F.count(F.lit(1)).alias("others"))
    lacking = sites.join(spread, "vertical_id").join(has, [key, "vertical_id", "concept_id"], "left_anti")
    return lacking.select(key, "vertical_id", "concept_id", "others", F.when(F.col("others") >= 2, "High").otherwise("Medium").alias("priority"))


def without_parts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., form) without the forms that stand as whole words within a longer form of the same place; equal forms stay."""
    held = found.groupBy(*keys).agg(F.collect_set("form").alias("forms"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    kept = F.filter("forms", lambda f: ~F.exists("forms", lambda g: (F.length(g) > F.length(f)) & F.contains(pad(g), pad(f))))
    return held.select(*keys, F.explode(kept).alias("form"))


def contrast(rows: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(group, key, here, elsewhere): a key's sum in each group and in all others, from one aggregation and its totals."""
    own = rows.groupBy(group, key).agg(F.sum(value).alias("here"))
    total = own.groupBy(key).agg(F.sum("here").alias("all"))
    return own.join(total, key).select(group, key, "here", (F.col("all") - F.col("here")).alias("elsewhere"))


def top_two(vectors: DataFrame, references: DataFrame, least: float = 0.6, margin: float = 0.05, block: int = 2_000) -> DataFrame:
    """(vec_id, best, score, runner_up, margin, kept) of each vector against the list of references (ref, vector).

    Cosine similarity by dot product of unit vectors. The references go to the
    vectors as arrays of at most about ``block`` of them, so every vector is scored where it lies; one
    block needs no shuffle, more are merged by vec_id, which must be unique then.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    listed = references.select("ref", doubles(F.col("vector")).alias("v")).select("ref", "v", norm(F.col("v")).alias("len")).where(F.col("len") > 0)
    listed = Scratch(references.sparkSession, "references").keep(listed)
    blocks = max(1, -(-listed.count() // block))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ahead = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["ref"] < b["ref"], -1).when(a["ref"] > b["ref"], 1).otherwise(0))
    scores = F.transform("refs", lambda r: F.struct(F.round(dot(F.col("e"), r["v"]) / (F.col("l") * r["len"]), 6).alias("score"), r["ref"].alias("ref")))
    asked = vectors.select("vec_id", doubles(F.col("embedding")).alias("e")).withColumn("l", norm(F.col("e"))).where(F.col("l") > 0)
    two: DataFrame | None = None
    for i in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("ref"), F.lit(blocks)) == i).agg(F.sort_array(F.collect_list(F.struct("ref", "v", "len"))).alias("refs"))
        one = asked.withColumn("refs", part.scalar()).select("vec_id", F.slice(F.array_sort(scores, ahead), 1, 2).alias("t"))
        two = one if two is None else two.unionByName(one)
    if blocks > 1:
        # a vector_id that stands twice has been answered twice already
        best = two.groupBy("vec_id").agg(F.flatten(F.collect_list("t")).alias("t"))
        two = best.select("vec_id", F.slice(F.array_sort(F.col("t"), ahead), 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    gap = F.round(first["score"] - F.coalesce(second["score"], F.lit(0.0)), 6)
    return two.select("vec_id", first["ref"].alias("best"), first["score"].alias("score"), second["ref"].alias("runner_up"), gap.alias("margin"), ((first["score"] >= least) & (gap >= margin)).alias("kept"))

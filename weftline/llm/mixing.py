"""Mixing sources to target shares of all tokens.

Every document has a place in its source's hash range. Tokens are summed by
source and hash bucket; from the sums follow the size of the mixture, how often
each source is repeated whole, and a threshold below which its documents are
taken once more. The threshold falls within one bucket, and only the documents
of that bucket are summed again by the next bits of their hash, until it lies
between two documents. A filter then gives the mixture; nothing is sorted.
Thresholds are nested: a larger share of a source contains the smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Scratch
from .tokenizer import TOKENIZERS, count_tokens

#: Bits of the hash, and bits by which each histogram divides a bucket.
HASH_BITS, STEP_BITS = 60, 12


def _boundary(histogram: DataFrame, budget: str) -> DataFrame:
    """(source, bucket, base, tokens, docs) of the bucket within which each source's budget ends: at most 2 ** STEP_BITS rows a source are summed up."""
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumn("upto", F.sum("tokens").over(so_far))
    return summed.where(F.col("upto") > F.col(budget)).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("base"), "tokens", "docs"), "bucket").alias("b")).select("source", "b.*")


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 0, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture (key, source, n_tokens, copies) holds each document used and how
    often; shares (source, target_share, max_repeats, tokens, actual_share,
    n_documents, most_copies) what came of it. Each source has its share of the
    largest mixture that no source's max_repeats forbids, up to half a document
    of its own: the document on the threshold is taken where that is nearer. Documents of no target source, and those without tokens
    (null and empty texts), are not used. A source without any tokens adds nothing,
    and the others keep their shares of each other. Null shares and those of 0
    use nothing; a null or negative max_repeats counts 0. Sources in ``targets`` count once each (the largest share). Rows
    delivered twice are two documents. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.max("target_share").alias("share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("most"))
    wanted = scratch.keep(wanted)
    used = documents.join(wanted.select("source"), "source", "left_semi") if wanted.count() else documents.limit(0)
    tokens = count_tokens(used, [key, "source"], name=name, tokenizers=tokenizers)
    tokens = scratch.keep(tokens.where(F.col("n_tokens") > 0).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - HASH_BITS)))

    def histogram(of: DataFrame, shift: int) -> DataFrame:
        return of.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))

    shift = HASH_BITS - STEP_BITS
    first = scratch.keep(histogram(tokens, shift))
    held = wanted.join(first.groupBy("source").agg(F.sum("tokens").alias("all"), F.sum("docs").alias("rows")), "source")
    size = held.agg(F.min(F.col("most") * F.col("all") / F.col("share")).alias("size"), F.sum("rows").alias("rows")).first()
    if size["rows"] is None:
        empty = tokens.select(key, "source", "n_tokens", F.lit(0).alias("copies"))
        return empty, _shares(empty, targets)
    budget = F.col("share") * F.lit(size["size"])
    # whole: how often every document is used; rest: tokens of one more, partial, use
    plan = held.withColumn("whole", F.least(F.floor(budget / F.col("all") + 1e-12), "most")).withColumn("rest", F.greatest(budget - F.col("whole") * F.col("all"), F.lit(0.0)))
    plan = scratch.keep(plan.withColumn("rest", F.when(F.col("whole") < F.col("most"), F.col("rest")).otherwise(0.0)).select("source", "whole", "rest"))
    edge = scratch.keep(_boundary(first.join(plan, "source"), "rest"))
    inside, rows = tokens, size["rows"]
    while shift > 0:
        inside = lookup_join(inside, edge.select("source", "bucket"), ["source"], "inner", rows=rows).where(F.shiftright("h", shift) == F.col("bucket")).drop("bucket")
        inside = scratch.keep(inside)
        rows = inside.count()
        if edge.where(F.col("docs") > 1).limit(1).count() == 0:
            break
        before, shift = edge.select("source", "base"), max(0, shift - STEP_BITS)
        left = plan.join(before, "source").withColumn("left", F.col("rest") - F.col("base"))
        finer = _boundary(histogram(inside, shift).join(left.select("source", "left"), "source"), "left")
        edge = scratch.keep(finer.join(before.withColumnRenamed("base", "b0"), "source").withColumn("base", F.col("base") + F.col("b0")).drop("b0"))
    # the bucket on the threshold now holds one document, or several of one hash: all or none, whichever is nearer
    over = F.col("base") + F.col("tokens") - F.col("rest") < F.col("rest") - F.col("base")
    ends = plan.join(edge, "source", "left").select("source", "whole", F.when(F.col("bucket").isNull(), 0).otherwise(F.col("bucket") + over.cast("long")).alias("below"))
    copies = F.col("whole") + (F.shiftright("h", shift) < F.col("below")).cast("long")
    mixed = lookup_join(tokens, scratch.keep(ends), ["source"], "inner", rows=size["rows"]).select(key, "source", "n_tokens", copies.cast("int").alias("copies")).where(F.col("copies") > 0)
    return mixed, _shares(mixed, targets)


def _shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    found = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    whole = found.agg(F.sum("tokens").alias("t"))
    out = targets.select("source", "target_share", "max_repeats").join(found, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return out.select("source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce(tokens / whole.scalar(), F.lit(0.0)).alias("actual_share"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))

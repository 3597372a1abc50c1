"""Streams of events folded to state, appended once, counted and limited."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..operators import quads as store
from ..plans.skew import lookup_join
from ..plans.storage import Scratch, is_file


def read_table(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files, a few at a time."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    if is_file(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run(stream: DataFrame, scratch: Scratch, write, mode: str = "append") -> None:
    """Process what is there and stop; ``write(batch, number)`` may be called again with the same number after a failure and must then do the same."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def latest_decisions(events: DataFrame) -> DataFrame:
    """The standing decision of each vertical and key from a stream of events: state is one row per key, so late and repeated events change nothing they should not."""
    spark = events.sparkSession
    scratch = Scratch(spark, "decisions")
    rest = [c for c in events.columns if c not in ("vertical_id", "key")]
    value = F.max_by(F.struct(*rest), F.struct(F.coalesce("event_id", F.lit("")), *[F.col(c) for c in rest if c != "event_id"]))
    folded = events.groupBy("vertical_id", "key").agg(value.alias("d")).select("vertical_id", "key", "d.*")
    out = f"{scratch.root}/state"
    # each batch's changed keys go to a folder of the batch's own, so writing it again replaces it
    run(folded, scratch, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/at={n:06d}"), "update")
    rows = spark.read.parquet(out).drop("at")
    return store.latest(rows, ["vertical_id", "key"], [F.col("batch")]).drop("batch")


def append_quads(quads: DataFrame) -> DataFrame:
    """The store after a stream of quads, each quad once however often it is delivered, null datatypes and languages equal to empty ones.

    The quads' digests are the state, so a batch reads nothing that earlier
    batches wrote.
    """
    spark = quads.sparkSession
    scratch = Scratch(spark, "append")
    out = f"{scratch.root}/store"
    schema = store.QUADS
    known = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in store.KEY])
    # two digests of 64 bits stand for a quad, so that state is 16 bytes for each
    once = quads.select(*schema.names, F.xxhash64(known).alias("__a"), F.xxhash64(F.lit(7), known).alias("__b")).dropDuplicates(["__a", "__b"]).drop("__a", "__b")
    run(once, scratch, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/at={n:06d}"))
    return spark.read.schema(schema).parquet(f"{out}/*")


def repeated_blocks(pages: DataFrame, site: str, page: str, text: str, least: int = 3) -> DataFrame:
    """(site, page, pos, key, dropped) of a stream of pages: a block that ``least`` pages have shown by then is dropped, its own page counted.

    State is a count for each site and block, written by each batch for the batches that a binary indexed tree puts
    under its number: a batch reads the counts of as many tables as its number has binary ones, and writing one again
    changes nothing. Pages of a batch are taken in the order of ``page``; null pages are left out.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "blocks")
    on = ["site", "key"]

    def counted(upto: int, above: int = 0) -> DataFrame:
        """(site, key, n) of the batches from ``above`` on and below ``upto``."""
        paths = []
        while upto > above:
            paths.append(f"{scratch.root}/state/at={upto - 1:06d}")
            upto &= upto - 1
        return scratch.read("site string, key string, n bigint", *paths)

    def judge(batch: DataFrame, number: int) -> None:
        blocks = batch.where(F.col(text).isNotNull() & F.col(page).isNotNull()).select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col(page).cast("bigint").alias("page"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("pos", "line"))
        at = f"{scratch.root}/keyed/at={number:06d}"
        blocks.select("site", "page", "pos", tx.block_key(F.col("line")).alias("key")).where(F.col("key").isNotNull()).write.mode("overwrite").parquet(at)
        keyed = scratch.read("site string, page bigint, pos int, key string", at)
        shown = keyed.select(*on, "page").distinct()
        first = shown.withColumn("turn", F.row_number().over(Window.partitionBy(*on).orderBy("page"))).where(F.col("turn") <= least)
        first = first.groupBy(*on).agg(F.sort_array(F.collect_list("page")).alias("first"))
        before = counted(number).groupBy(*on).agg(F.sum("n").alias("seen"))
        # the page from which on a block is dropped: null where fewer have shown it, the first of all where enough had before
        limit = F.get("first", F.greatest(F.lit(least - 1) - F.coalesce("seen", F.lit(0)), F.lit(0)).cast("int"))
        limits = first.join(before, on, "left").select(*on, limit.alias("limit"))
        judged = lookup_join(keyed, limits, on, "left").select("site", "page", "pos", "key", F.coalesce(F.col("page") >= F.col("limit"), F.lit(False)).alias("dropped"))
        judged.write.mode("overwrite").parquet(f"{scratch.root}/judged/at={number:06d}")
        # the batches below this one that its table takes over
        own = shown.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
        whole = own.unionByName(counted(number, (number + 1) & number)).groupBy(*on).agg(F.sum("n").alias("n"))
        whole.write.mode("overwrite").parquet(f"{scratch.root}/state/at={number:06d}")
        scratch.drop(at)

    run(pages, scratch, judge)
    return spark.read.schema("site string, page bigint, pos int, key string, dropped boolean").parquet(f"{scratch.root}/judged/*")


def page_yield(reads: DataFrame, patience: int = 6, weight: float = 2.0) -> DataFrame:
    """(site, kind, read, hits, streak, closed) after a stream of reads (site, kind, seq, new): how many pages of a kind were read, how many told something new, how many in a row told nothing, and whether it is set aside.

    A kind is set aside when its streak reaches patience * (1 + weight * hit rate), and stays so.
    """

    def walk(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        read, hits, streak, closed = state.get if state.exists else (0, 0, 0, False)
        for new in pd.concat(list(parts)).sort_values("seq")["new"]:
            read, hits, streak = read + 1, hits + (new > 0), 0 if new > 0 else streak + 1
            closed = bool(closed or streak >= round(patience * (1 + weight * hits / read)))
        state.update((int(read), int(hits), int(streak), closed))
        yield pd.DataFrame([(group[0], group[1], read, hits, streak, closed)], columns=["site", "kind", "read", "hits", "streak", "closed"])

    told = reads.groupBy("site", "kind").applyInPandasWithState(walk, "site string, kind string, read bigint, hits bigint, streak bigint, closed boolean", "read bigint, hits bigint, streak bigint, closed boolean", "update", GroupStateTimeout.NoTimeout)
    scratch = Scratch(reads.sparkSession, "yield")
    out = f"{scratch.root}/told"
    run(told, scratch, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/at={n:06d}"), "update")
    return store.latest(reads.sparkSession.read.parquet(out).drop("at"), ["site", "kind"], [F.col("batch")]).drop("batch")


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n) of a stream of events in tumbling windows, events later than ``late`` behind the newest left out."""
    spark = events.sparkSession
    scratch = Scratch(spark, "windows")
    counted = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).groupBy(F.window("__t", length).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")
    out = f"{scratch.root}/counts"
    run(counted, scratch, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/at={n:06d}"), "update")
    return store.latest(spark.read.parquet(out).drop("at"), ["start", "key"], [F.col("batch")]).drop("batch")

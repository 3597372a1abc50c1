"""Ordering with reserves, round robins, penalties and rolling limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_reserves(rows: DataFrame, scope: str, group: str, order: list[Column], limit: int, shares: dict[str, float]) -> DataFrame:
    """The first ``limit`` rows of each scope by ``order``, of which each group of ``shares`` keeps max(1, int(limit * share)) places for its own first rows.

    Returns the rows with ``place`` in order. Reserved rows are taken first, the rest fills up.
    """
    reserve = F.lit(0)
    for name, share in shares.items():
        reserve = F.when(F.col(group) == name, max(1, int(limit * share))).otherwise(reserve)
    kept = rows.withColumn("__in", F.row_number().over(Window.partitionBy(scope, group).orderBy(*order))).where(F.col("__in") <= limit)
    kept = kept.withColumn("__free", (F.col("__in") > reserve).cast("int"))
    chosen = kept.withColumn("__all", F.row_number().over(Window.partitionBy(scope).orderBy("__free", *order))).where(F.col("__all") <= limit)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(*order))).drop("__in", "__free", "__all")


def round_robin(rows: DataFrame, scope: list[str], stage: str, subject: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows in turn: within a stage over its subjects, and over the stages; ``place`` counts from 1."""
    turn = F.row_number().over(Window.partitionBy(*scope, stage, subject).orderBy(*order))
    within = F.row_number().over(Window.partitionBy(*scope, stage).orderBy("__turn", subject, *order))
    out = rows.withColumn("__turn", turn).withColumn("__within", within)
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("__within", stage))).drop("__turn", "__within")
    return out if limit is None else out.where(F.col("place") <= limit)


def rolling_counts(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """The events with ``recent``: how many of the key's events lie in the ``seconds`` up to each, the earlier end left out."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("__at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("__at", at).withColumn("recent", F.count(F.lit(1)).over(frame)).drop("__at")


def admitted(events: DataFrame, key: str, time: str, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """(key, order, admitted) of every event: it is let in while fewer than ``limit`` events let in lie in the ``seconds`` before it.

    Refused events do not count, so each decision depends on those before it
    and a key's events are walked in order; they come in bounded batches, and
    only the times within the window are held.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    one = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), micros.alias("t"))
    schema = T.StructType([one.schema["k"], one.schema["o"], T.StructField("admitted", T.BooleanType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        current, held = None, deque()
        for b in batches:
            said = []
            for k, t in zip(b["k"].tolist(), b["t"].tolist()):
                if k != current:
                    current, held = k, deque()
                while held and held[0] <= t - seconds * 1_000_000:
                    held.popleft()
                said.append(len(held) < limit)
                if said[-1]:
                    held.append(t)
            yield pd.DataFrame({"k": b["k"], "o": b["o"], "admitted": said})

    walked = one.repartition("k").sortWithinPartitions("k", "t", "o").mapInPandas(walk, schema)
    return walked.select(F.col("k").alias(key), F.col("o").alias(order), "admitted")


#: Page kinds in the order they are read, and the share of a crawl's pages each may take (fixed values).
KIND_SHARES = {"home": 1.0, "product": 0.35, "pricing": 0.05, "integrations": 0.20, "security": 0.05, "comparison": 0.08, "docs": 0.30, "other": 0.20, "customers": 0.08, "resources": 0.10, "company": 0.04, "editorial": 0.06}


def frontier(candidates: DataFrame, site: str, budget: int, size: int) -> DataFrame:
    """(site, place, url, kind): the pages each site's crawl reads next.

    ``candidates`` has site, url, kind, section, missing, known, inlinks, ord. Pages go by kind, then by how
    often their section was already picked less their merit, then by ord; each pick counts for its section and
    uses up its kind's share of the budget (at least one page), and where nothing fits the shares are ignored. A pick changes the order
    of the rest, so a site's candidates are chosen together; they are first cut to those that could be picked at all.
    """
    merit = 3 * F.least("missing", F.lit(3)) + F.least("known", F.lit(5)) + F.least(F.log2(1 + F.col("inlinks")), F.lit(3.0))
    rank = F.lit(len(KIND_SHARES))
    for i, kind in enumerate(KIND_SHARES):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    rows = candidates.select(F.col(site).alias("site"), "url", "kind", "section", rank.alias("rank"), merit.alias("merit"), "ord")
    # within one section and kind the order never changes, so no more than ``size`` of each can be picked
    local = Window.partitionBy("site", "kind", "section").orderBy(F.desc("merit"), "ord", "url")
    rows = rows.withColumn("__n", F.row_number().over(local)).where(F.col("__n") <= size)
    # while fewer than ``size`` pages are picked, one of a kind's ``size`` best sections has none picked and goes before all
    # sections beyond them; so a site is left with at most kinds * size * size rows
    heads = rows.where(F.col("__n") == 1).withColumn("__h", F.row_number().over(Window.partitionBy("site", "kind").orderBy(F.desc("merit"), "ord", "url"))).where(F.col("__h") <= size)
    rows = rows.join(heads.select("site", "kind", "section"), ["site", "kind", "section"]).drop("__n")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        left = part.to_dict("records")
        room = {k: max(1, int(budget * s)) for k, s in KIND_SHARES.items()}
        taken: dict[str, int] = {}
        out = []
        while left and len(out) < size:
            fits = [r for r in left if room.get(r["kind"], 1) > 0] or left
            best = min(fits, key=lambda r: (r["rank"], taken.get(r["section"], 0) - r["merit"], r["ord"], r["url"]))
            left.remove(best)
            taken[best["section"]] = taken.get(best["section"], 0) + 1
            room[best["kind"]] = room.get(best["kind"], 1) - 1
            out.append((best["site"], len(out) + 1, best["url"], best["kind"]))
        return pd.DataFrame(out, columns=["site", "place", "url", "kind"])

    return rows.groupBy("site").applyInPandas(choose, "site string, place int, url string, kind string")

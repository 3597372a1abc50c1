"""Joins that hold when one key has a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the left rows on, so there are at most
#: 1 / HOT_SHARE hot keys: that bounds what lookup_join broadcasts.
HOT_SHARE = 1 / 500
#: Below this many left rows no key can overload a task.
HOT_ROWS = 200_000


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join ``left`` with ``right``, which has at most one row per key of ``on``.

    Keys with at least ``max(HOT_ROWS, HOT_SHARE * rows)`` left rows are split
    off: their (at most 1 / HOT_SHARE) right rows are broadcast, so their left
    rows stay in the tasks that read them. The other keys are shuffled.
    ``rows`` is the number of left rows; it is counted when not given. ``left``
    is read up to three times and should be a written table. Null keys match
    nothing and are kept by a left join.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    rows = left.count() if rows is None else rows
    if rows < HOT_ROWS:
        return left.join(right, on, how)
    least = max(HOT_ROWS, int(HOT_SHARE * rows))
    hot = left.groupBy(*on).count().where(F.col("count") >= least).select(*on)
    hot_right = right.join(F.broadcast(hot), on, "left_semi")
    cold = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    return left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_right), on, how).unionByName(cold)

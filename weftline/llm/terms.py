"""How often every distinct term occurs and in how many records.

Pairs of term and record identifier are sorted across the cluster by range, so
that a term with a third of all rows covers several ranges instead of one task.
Each range is then scanned once: runs of equal pairs give the counts. Only the
first and last record of a term within a range can go on in a neighbouring
range; those are sent along by name and everything else as a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUNS = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("inner", T.LongType()), T.StructField("edges", T.ArrayType(T.StringType()))]
)
#: The marks' limits: rare up to so many records, common above this share of them.
RARE_RECORDS, COMMON_SHARE = 2, 4


def _starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Whether each row differs from the row before it in any of the columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for i, c in enumerate(columns):
        differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(c).to_numpy(zero_copy_only=False)
        new[1:] |= differs | (nulls[1:] != nulls[:-1])
        if before is None or before[i] != c[0].as_py():
            new[0] = True
    return new


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of one range sorted by (term, record, part); parts repeated within a record count once. A run may go on over batches, so the open term is carried."""
    before = None
    term, total, records, first, last = None, 0, 0, None, None

    def row():
        edges = [] if first is None else [first] if first == last else [first, last]
        return term, total, max(0, records - len(edges)), edges

    for batch in batches:
        if not batch.num_rows:
            continue
        terms, record, part, weight = batch.columns
        fresh = _starts([terms, record, part], before)
        of_record = _starts([terms, record], before[:2] if before else None) & ~pc.is_null(record).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(_starts([terms], before[:1] if before else None))
        before = (terms[-1].as_py(), record[-1].as_py(), part[-1].as_py())
        weights = np.where(fresh, weight.to_numpy(zero_copy_only=False), 0)
        cuts = np.unique(np.concatenate([[0], at]))
        sums, counts = np.add.reduceat(weights, cuts), np.add.reduceat(of_record.astype(np.int64), cuts)
        ends = np.append(cuts[1:], batch.num_rows)
        # the first and last record that is not null: nulls sort first, so the last is that of the last row
        has = pc.is_valid(record).to_numpy(zero_copy_only=False)
        head = np.minimum.reduceat(np.where(has, np.arange(batch.num_rows), batch.num_rows), cuts)
        names = terms.take(pa.array(cuts)).to_pylist()
        heads = record.take(pa.array(np.minimum(head, batch.num_rows - 1))).to_pylist()
        tails = record.take(pa.array(ends - 1)).to_pylist()
        began = set(at.tolist())
        out = []
        for i, cut in enumerate(cuts.tolist()):
            if cut in began:
                if term is not None:
                    out.append(row())
                term, total, records, first, last = names[i], 0, 0, None, None
            total += int(sums[i])
            records += int(counts[i])
            if tails[i] is not None:
                first = heads[i] if first is None else first
                last = tails[i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["term", "occurrences", "inner", "edges"])
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["term", "occurrences", "inner", "edges"])


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """(term, occurrences, records) of every term of ``pairs`` (term, record, part, weight).

    occurrences is the sum of the weights (null counts 0), records the number
    of distinct records that are not null. Rows equal in term, record and part
    are repeats of one occurrence and count once; any of them gives the weight. Null terms
    are left out. An empty table gives no rows.
    """
    rows = pairs.where(F.col("term").isNotNull()).select(F.col("term").cast("string").alias("term"), F.col("record").cast("string").alias("record"), F.col("part").cast("string").alias("part"), F.coalesce(F.col("weight").cast("long"), F.lit(0)).alias("weight"))
    ranges = rows.repartitionByRange("term", "record", "part").sortWithinPartitions("term", "record", "part")
    runs = ranges.mapInArrow(_scan, _RUNS)
    # At most two edges a term and range: the distinct ones are few even for the most frequent term.
    edges = runs.select("term", F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("inner"), F.explode("edges").alias("edge")).distinct()
    both = runs.select("term", "occurrences", "inner", F.lit(None).cast("string").alias("edge")).unionByName(edges)
    return both.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), (F.sum("inner") + F.count("edge")).alias("records"))


def observed_terms(observations: DataFrame) -> DataFrame:
    """(term, record, part, weight): a row for each key of each observation's forms.

    term is the trimmed, lower-cased key, blank ones left out; record the
    trimmed, lower-cased domain, null where blank; part the observation and the key's
    place in it, so that an observation delivered twice has equal rows. An
    observation without id is its own, whatever it holds.
    """
    plain = observations.select("observation_id", F.lower(F.trim("domain")).alias("record"), F.monotonically_increasing_id().alias("row"), F.transform("forms", lambda f: F.struct(f["key"].alias("key"), f["pages"].alias("pages"))).alias("forms"))
    each = plain.select(F.coalesce(F.col("observation_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))).alias("seen"), F.when(F.col("record") != "", F.col("record")).alias("record"), F.posexplode("forms").alias("at", "f"))
    return each.select(F.lower(F.trim("f.key")).alias("term"), "record", F.concat_ws(" ", "seen", "at").alias("part"), F.col("f.pages").alias("weight")).where(F.col("term") != "")


def observed_term_marks(observations: DataFrame) -> DataFrame:
    """(key, n_pages, n_domains, mark) of every key: rare with at most RARE_RECORDS domains, else common with more than a COMMON_SHARE-th of all domains, else useful.

    Null and empty forms add nothing but their domain to the number of all
    domains. Null pages count 0. Repeated observations count once.
    """
    domains = observations.select(F.lower(F.trim("domain")).alias("d")).where(F.col("d") != "").agg(F.count_distinct("d").alias("n"))
    found = term_frequencies(observed_terms(observations))
    mark = F.when(F.col("records") <= RARE_RECORDS, "rare").when(F.col("records") * COMMON_SHARE > domains.scalar(), "common").otherwise("useful")
    return found.select(F.col("term").alias("key"), F.col("occurrences").alias("n_pages"), F.col("records").alias("n_domains"), mark.alias("mark"))

"""The registered queries of the operators for training data and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import groups, mixing, names, spam, terms, tokenizer, values

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_entities(table(spark, folder, "entities"))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return values.concepts_of_values(*(table(spark, folder, t) for t in ("candidates", "synonym_requests", "concepts")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _values(spark, folder).select("origin", "record_id", "concept_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each origin were found in which way, 0 being not at all."""
    return _values(spark, folder).groupBy("origin", "way").count()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.observed_term_marks(table(spark, folder, "observations"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.merged_groups(table(spark, folder, "entities"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source really reached."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.keyword_pages(table(spark, folder, "documents")).select("doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The pages found with their language and the share of their text that is no sentences."""
    return spam.keyword_pages(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_shares": p9_shares}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": """
            with once as (select distinct on (observation_id) observation_id, lower(trim(domain)) as domain, forms from observations),
            every as (select domain, unnest(forms) as f from once),
            keys as (select lower(trim(f.key)) as key, nullif(domain, '') as domain, coalesce(f.pages, 0) as pages from every),
            found as (select key, sum(pages)::bigint as n_pages, count(distinct domain) as n_domains from keys where key <> '' group by key)
            select key, n_pages, n_domains,
              case when n_domains <= 2 then 'rare' when 4 * n_domains > (select count(distinct nullif(domain, '')) from once) then 'common' else 'useful' end as mark
            from found""",
        "p6_found": """
            with recursive links as (select distinct id as a, trim(merged_into) as b from entities where trim(merged_into) <> '' and id <> trim(merged_into)),
            both_ways as (select a, b from links union select b, a from links),
            reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b)
            select a as id, least(a, min(b)) as group_id from reach group by a""",
    }

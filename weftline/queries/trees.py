"""Hierarchies and snapshot changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, snapshots
from .tables import Query, table



def _hierarchy(paths: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        links = hierarchy.entity_links(table(spark, folder, "entities")).unionByName(hierarchy.decision_links(table(spark, folder, "vocabulary_decisions")))
        return hierarchy.contract(links, paths)

    return run


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _hierarchy(False)(spark, folder).select("scope", "node", F.coalesce("root", F.lit("")).alias("root"), "depth")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every node's full path from its root, null on a loop or leading into one."""
    return _hierarchy(True)(spark, folder).select("scope", "node", F.array_join("path", " > ").alias("path"), "depth")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a node and a node above it."""
    return hierarchy.closure(_hierarchy(True)(spark, folder))


def p3_descendant_counts(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendant_counts(_hierarchy(True)(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.run_changes(table(spark, folder, "quads"), table(spark, folder, "graphs"))


def p4_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many records each run added, removed and changed."""
    return p4_found(spark, folder).groupBy("graph_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])


_LINKS = """
stands as (select *, row_number() over (partition by vertical_id, key order by event_id desc nulls last) as rn from vocabulary_decisions),
links as (
  select 'entity' as scope, id as node, coalesce(max(nullif(trim(part_of), '')), max(nullif(trim(parent_org), ''))) as parent
  from entities where id is not null group by id
  having coalesce(max(nullif(trim(part_of), '')), max(nullif(trim(parent_org), ''))) is not null
  union all
  select vertical_id, lower(coalesce(nullif(trim(label), ''), nullif(trim(key), ''))), lower(trim(broader))
  from stands where rn = 1 and decision = 'approve' and trim(coalesce(broader, '')) <> ''
),
walk as (
  select l.scope, l.node, l.parent as root, 1::bigint as depth, [l.parent, l.node] as path
  from links l left join links u on u.scope = l.scope and u.node = l.parent where u.node is null
  union all
  select l.scope, l.node, w.root, w.depth + 1, list_append(w.path, l.node)
  from walk w join links l on l.scope = w.scope and l.parent = w.node
)"""

_CLOSURE = """, up as (
  select scope, node, len(path) as n, unnest(range(1, len(path))) as pos, path from walk
), closure as (select scope, path[pos] as ancestor, node, (n - pos)::bigint as distance from up)"""

_RUNS = """
runs as (
  select graph_id, lag(graph_id) over (partition by split_part(graph_id, '/audit/', 1) order by split_part(graph_id, '/audit/', 2)) as earlier
  from graphs where kind = 'run'
),
objects as (
  select graph_id, s, p, string_agg(distinct o, chr(1) order by o) as os from quads
  where s_kind <> 'bnode' and o_kind <> 'bnode' group by 1, 2, 3
),
sides as (
  select r.graph_id, o.s, o.p, o.os as later, null as earlier from runs r join objects o on o.graph_id = r.graph_id where r.earlier is not null
  union all
  select r.graph_id, o.s, o.p, null, o.os from runs r join objects o on o.graph_id = r.earlier
),
merged as (select graph_id, s, p, max(later) as later, max(earlier) as earlier from sides group by 1, 2, 3),
found as (
  select graph_id, s, p, case when earlier is null then 'added' when later is null then 'removed' else 'changed' end as change
  from merged where later is distinct from earlier
)"""


def queries() -> dict[str, Query]:
    return {
        "p3_found": p3_found,
        "p3_paths": p3_paths,
        "p3_descendants": p3_descendants,
        "p3_descendant_counts": p3_descendant_counts,
        "p4_found": p4_found,
        "p4_summary": p4_summary,
    }


def oracle_sql() -> dict[str, str]:
    left = "left join walk w on w.scope = l.scope and w.node = l.node"
    return {
        "p3_found": f"with recursive {_LINKS} select l.scope, l.node, coalesce(w.root, '') as root, coalesce(w.depth, -1) as depth from links l {left}",
        "p3_paths": f"with recursive {_LINKS} select l.scope, l.node, array_to_string(w.path, ' > ') as path, coalesce(w.depth, -1) as depth from links l {left}",
        "p3_descendants": f"with recursive {_LINKS} {_CLOSURE} select scope, ancestor, node, distance from closure",
        "p3_descendant_counts": f"with recursive {_LINKS} {_CLOSURE} select scope, ancestor, count(*) as n_descendants, count(*) filter (distance = 1) as n_children, max(distance) as height from closure group by 1, 2",
        "p4_found": f"with {_RUNS} select graph_id, s, p, change from found",
        "p4_summary": f"with {_RUNS} select graph_id, count(*) filter (change = 'added') as added, count(*) filter (change = 'removed') as removed, count(*) filter (change = 'changed') as changed from found group by 1",
    }

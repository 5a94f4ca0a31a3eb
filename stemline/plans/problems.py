"""Queries of the general data problems: hierarchies, orphan references, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.operators import hierarchy, proximity, references
from stemline.sources.tables import table

FRAME = ["dataset", "t"]
NEAR_UM = 3.25


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.existing_links(table(spark, folder, "edges"), table(spark, folder, "nodes"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.Hierarchies(_links(spark, folder)).rows()


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Each linked node with each root above it, its depth and parent from there, its number of descendants, and whether it is its own ancestor."""
    return hierarchy.full_hierarchy(_links(spark, folder)).select("node_id", "parent_id", "root_id", "depth", "rootless", "n_descendants", "on_cycle")


def p3_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of each linked node: a nested-set range of its tree, and the trees below."""
    return hierarchy.node_ranges(hierarchy.Hierarchies(_links(spark, folder))).select("node_id", "tree_id", "pre", "last", "trees_below", "n_descendants")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The full path of each linked node from each root above it."""
    return hierarchy.full_paths(_links(spark, folder))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    edges, forks, nodes = (table(spark, folder, t) for t in ("edges", "forks", "nodes"))
    refs = references.references(edges, "edges", "edge_id", ["source_id", "target_id"])
    refs = refs.unionByName(references.references(forks, "forks", "fork_id", ["p_id", "d1_id", "d2_id"]))
    return references.orphans(refs, references.parent_intervals(nodes, "node_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "row_id", "ref_field", "reason", "period")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted for each table, field, reason and month."""
    return references.orphan_report(_orphans(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = proximity.neighbourhoods(table(spark, folder, "nodes"), table(spark, folder, "crops"), NEAR_UM, FRAME)
    return found.select(F.when(F.col("is_pair"), "node").otherwise("crop").alias("kind"), "left_id", "right_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_ranges, p3_paths, p4_found, p4_report, p5_found)}

_REFS = """
with par as (select node_id, min(recorded_at) a, min(deleted_at) d from nodes group by 1),
e as (select edge_id id, source_id, target_id, min(recorded_at) seen from edges group by all),
f as (select fork_id id, p_id, d1_id, d2_id, min(recorded_at) seen from forks group by all),
r as (select 'edges' ref_table, id row_id, 'source_id' ref_field, source_id k, seen from e
  union all select 'edges', id, 'target_id', target_id, seen from e
  union all select 'forks', id, 'p_id', p_id, seen from f
  union all select 'forks', id, 'd1_id', d1_id, seen from f
  union all select 'forks', id, 'd2_id', d2_id, seen from f),
j as (select r.*, par.*, coalesce(strftime(seen, '%Y-%m'), 'none') period from r left join par on k = node_id where k >= 0),
o as (select ref_table, row_id, ref_field, 'missing' reason, period from j where node_id is null
  union all select ref_table, row_id, ref_field, 'deleted', period from j where d <= seen
  union all select ref_table, row_id, ref_field, 'late', period from j where a > seen)
"""

_LINKS = """
with recursive ids as (select distinct node_id from nodes where node_id is not null),
l as (select distinct source_id p, target_id c from edges where source_id in (from ids) and target_id in (from ids)),
roots as (select distinct p id from l where p not in (select c from l)),
reach(root, node, depth) using key (root, node) as (
  select id, id, 0 from roots
  union
  select r.root, l.c, min(r.depth) + 1 from reach r join l on l.p = r.node left join recurring.reach k on k.root = r.root and k.node = l.c where k.root is null group by r.root, l.c),
below(top, node) as (select p, c from l union select b.top, l.c from below b join l on l.p = b.node),
cyc as (select distinct node from below where top = node)
"""
#: Starts of paths: the roots, and for nodes without any the least root of a tree on each first cycle above them. Trees start
#: at nodes with several parents or their own one, and at the least node of a cycle of nodes with one parent each.
_STARTS = _LINKS + """,
par as (select c, min(p) lo, max(p) hi from l group by 1), tops as (select c from par where lo <> hi or lo = c),
ring(top, node) as (select c, lo from par where lo = hi and lo <> c union select top, p.lo from ring join par p on p.c = node where p.lo = p.hi and p.lo <> p.c),
lost as (select c from l where c not in (select node from reach)),
cut as (select top c from ring where top = node and top = (select min(r.node) from ring r where r.top = ring.top)),
trees as (select c from (select c from tops union select c from cut) where c in (from lost)),
above as (select t.c c, b.top x from trees t join below b on b.node = t.c and b.top in (from trees) union select c, c from trees),
firsts as (select c, min(x) r from above a group by 1 having bool_and(x = c or exists (select 1 from above b where b.c = a.x and b.x = a.c))),
loose(root, node, depth) using key (root, node) as (
  select distinct r, r, 0 from firsts
  union
  select r.root, l.c, min(r.depth) + 1 from loose r join l on l.p = r.node left join recurring.loose k on k.root = r.root and k.node = l.c where k.root is null group by r.root, l.c),
every as (select root, node, depth, false rootless from reach union all select root, node, depth, true from loose where node in (from lost)),
near as (select e.root, e.node, e.depth, e.rootless, min(b.node) parent from every e left join l on l.c = e.node left join every b on b.root = e.root and b.node = l.p and b.depth = e.depth - 1 group by all)
"""

SQL = {
    "p3_hierarchy": _STARTS + """select near.node node_id, parent parent_id, root root_id, depth::int depth, rootless, coalesce(k, 0) n_descendants, near.node in (from cyc) on_cycle
from near left join (select top, count(*) k from below where node <> top group by 1) on top = near.node""",
    "p3_paths": _STARTS + """, way(node, root, depth, path, rootless) as (select node, root, depth, [node], rootless from near where depth = 0
union all select n.node, n.root, n.depth, list_append(w.path, n.node), n.rootless from way w join near n on n.root = w.root and n.parent = w.node)
select node node_id, root root_id, depth::int depth, path, rootless from way""",
    "p3_found": _LINKS + """select node node_id, root root_id, depth::int depth from reach union all select node, -1, -1 from cyc
union all select distinct node, -2, -2 from below where top in (from cyc) and node not in (from cyc) and node not in (select node from reach)""",
    "p4_found": _REFS + "select * from o",
    "p4_report": _REFS + "select ref_table, ref_field, reason, period, count(*) n_references from o group by all",
    "p5_found": """
with n as (select distinct dataset, t, node_id, z, y, x from nodes where dataset is not null and t is not null and node_id is not null
  and z is not null and y is not null and x is not null and not isnan(z) and not isnan(y) and not isnan(x))
select 'node' kind, a.node_id left_id, b.node_id right_id from n a join n b on a.dataset = b.dataset and a.t = b.t and a.node_id < b.node_id
where ((a.z - b.z) * 1.625) ** 2 + ((a.y - b.y) * 0.40625) ** 2 + ((a.x - b.x) * 0.40625) ** 2 <= 3.25 ** 2
union all
select distinct 'crop', n.node_id, crop_id from n join crops c on c.dataset = n.dataset and c.t = n.t
 and z >= z_lo and z < z_hi and y >= y_lo and y < y_hi and x >= x_lo and x < x_hi""",
}

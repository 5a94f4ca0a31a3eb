"""Queries on training data, and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm import bpe, groups, mixing, pieces, splits
from stemline.sources.tables import table
from stemline.store import Scratch


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = groups.matched_nodes(table(spark, folder, "edges"), table(spark, folder, "nodes"))
    return groups.consolidate(pairs).select(F.col("node").alias("node_id"), F.col("group").alias("group_id"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every node, matched or not."""
    nodes = table(spark, folder, "nodes")
    return groups.group_all(nodes, groups.matched_nodes(table(spark, folder, "edges"), nodes))


def _related(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    names = splits.names_of(table(spark, folder, "per_dataset"))
    return splits.related_groups(names, scratch)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _related(spark, folder, Scratch(spark, "splits"))


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "splits")
    related = scratch.keep(_related(spark, folder, scratch), "related")
    assigned = splits.assign_splits(related, table(spark, folder, "split_targets"), scratch)
    units = related.withColumn("unit", splits.unit(F.col("group_id")))
    return units.join(F.broadcast(assigned), "unit").select("dataset", "group_id", "split_name")  # at most splits.UNITS rows


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of each dataset."""
    return _splits(spark, folder)


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of datasets that each split got, beside its target."""
    got = _splits(spark, folder).groupBy("split_name").agg(F.count("*").alias("n_datasets"), F.countDistinct("group_id").alias("n_groups"))
    total = got.agg(F.sum("n_datasets").alias("total"))
    out = table(spark, folder, "split_targets").join(got, "split_name", "left").fillna(0).crossJoin(F.broadcast(total))
    return out.select("split_name", "share", F.round(F.col("n_datasets") / F.col("total"), 9).alias("actual_share"), "n_datasets", "n_groups")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the mix, with their copies, blocks and shards."""
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).rows()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).report()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(table(spark, folder, "documents"), contents=False).where("piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of texts above the limit, with text and ids."""
    return pieces.split_oversized(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_splits, p2_shares, p6_ids, p7_mix, p7_report, p8_found, p8_pieces)}

_GROUPS = """
with recursive ids as (select distinct node_id from nodes where node_id is not null),
e as (select source_id a, target_id b from edges where source_id <> target_id and source_id in (from ids) and target_id in (from ids)),
both_ways as (select a, b from e union select b, a from e),
g(node, least) using key (node) as (
  select distinct a, a from both_ways
  union
  select l.b, min(g.least) from g join both_ways l on l.a = g.node join recurring.g r on r.node = l.b where g.least < r.least group by l.b)
"""
_NAMES = r"""
with recursive n as (
  select distinct trim(regexp_replace(trim(lower(dataset), ' ' || chr(9)), '\.(zarr|geff)$', ''), ' ' || chr(9)) dataset, trim(lower(embryo_id), ' ' || chr(9)) embryo
  from per_dataset where dataset is not null),
k as (select distinct 'd:' || dataset d, 'e:' || case when coalesce(embryo, '') = '' then split_part(dataset, '_', 1) else embryo end e from n),
both_ways as (select d a, e b from k union select e, d from k),
g(node, least) using key (node) as (
  select distinct a, case when a like 'e:%' then a else 'f' end from both_ways
  union
  select l.b, min(g.least) from g join both_ways l on l.a = g.node join recurring.g r on r.node = l.b where g.least < r.least group by l.b)
"""
_SPLITS = _NAMES + """,
related as (select node[3:] dataset, least[3:] group_id, ('0x' || substr(md5(least[3:]), 1, 4))::int unit from g where node like 'd:%'),
units as (select unit, count(*) n from related group by 1),
spans as (select split_name, share / sum(share) over () want, round(sum(share) over (order by split_name) / sum(share) over (), 12) hi from split_targets where share > 0),
tried as (select unit, n, seed, round((2 * sum(n) over (partition by seed order by md5(seed || ':' || unit), unit) - n) / (2 * sum(n) over (partition by seed)), 12) mid from units, range(32) r(seed)),
placed as (select seed, unit, n, split_name from tried join (select *, coalesce(lag(hi) over (order by split_name), 0) lo from spans) on mid >= lo and mid < hi),
error as (select seed, round(sum(abs(coalesce(got, 0) / (select sum(n) from units) - want)), 12) error
  from (select distinct seed from placed) cross join spans left join (select seed, split_name, sum(n) got from placed group by all) using (seed, split_name) group by 1),
assigned as (select unit, split_name from placed where seed = (select seed from error order by error, seed limit 1)),
splits as (select dataset, group_id, split_name from related join assigned using (unit))
"""

SQL = {
    "p2_splits": _SPLITS + "select * from splits",
    "p2_shares": _SPLITS + """select split_name, share, round(count(dataset) / (select count(*) from splits), 9) actual_share, count(dataset) n_datasets, count(distinct group_id) n_groups
from split_targets left join splits using (split_name) group by all""",
    "p1_found": _GROUPS + "select node node_id, least group_id from g",
    "p1_groups": _GROUPS + "select node_id, coalesce(least, node_id) group_id from ids left join g on node = node_id",
    "p2_found": _NAMES + "select node[3:] dataset, least[3:] group_id from g where node like 'd:%'",
}

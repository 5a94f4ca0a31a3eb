"""Splits that keep related records together.

Records are joined over two names, such as dataset and embryo: a graph between names. Its adjacency lists are written
hash-partitioned, long lists salted. Names whose hash is less than that of all their neighbours are seeds, so each
component has one; all seeds expand at once, breadth first, and each name takes the least label that reaches it. Labels
that collide are pairs of a small graph, which union-find over bounded chunks merges. Components then go to splits in
the order of their hashes.

The hash of a component puts it into one of UNITS units, whatever its size, so that what is ordered stays small: units stand
in the order of a seeded hash, and each goes to the split whose span of the shares holds its middle. Of SEEDS such orders
the one whose shares come nearest to the targets is taken, as a few large components can miss them in a single one.

Defined cases: rows without a first name (dataset) are left out; names are compared in lower case without surrounding
blanks and tabs; repeated rows count once; no rows, or no split with a share, give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.llm.groups import consolidate
from stemline.skew import lookup
from stemline.store import Scratch

#: A list of neighbours is cut into parts of about this length.
PART = 100_000
#: Units of hashes (four hexadecimal digits), and orders that are tried.
UNITS, SEEDS = 16**4, 32


def tidy(name: Column) -> Column:
    return F.btrim(F.lower(name), F.lit(" \t"))


def dataset_name(name: Column) -> Column:
    return tidy(F.regexp_replace(tidy(name), r"\.(zarr|geff)$", ""))


def names_of(rows: DataFrame, dataset: str = "dataset", embryo: str = "embryo_id") -> DataFrame:
    """(dataset, embryo) as compared: a blank embryo stands for the dataset's name before the first underscore."""
    rows = rows.select(dataset_name(F.col(dataset)).alias("dataset"), tidy(F.col(embryo)).alias("embryo")).where(F.col("dataset").isNotNull())
    return rows.select("dataset", F.when(F.coalesce(F.col("embryo"), F.lit("")) == "", F.split("dataset", "_", 2)[0]).otherwise(F.col("embryo")).alias("embryo")).distinct()


def frontier_labels(links: DataFrame, scratch: Scratch, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """For links(u, v) between names: (v, label) of each name, and the (a, b) of labels that met."""
    keep = scratch.keep
    both = keep(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "both")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    degree = both.groupBy("u").agg(F.count("*").alias("n"), F.min(rank("v")).alias("nearest"))
    long = keep(degree.where(F.col("n") > part).select("u", F.ceil(F.col("n") / part).cast("int").alias("parts")), "long")
    adjacency = lookup(both, long, "u", F.col("v")).withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int"))
    adjacency = keep(adjacency.select("u", "salt", "v").repartition("u", "salt").sortWithinPartitions("u", "salt"), "adjacency")

    seeds = degree.where(rank("u") < F.col("nearest")).select(F.col("u").alias("v"), F.col("u").alias("label"))
    front = seen = keep(seeds, "seeds")
    met = None
    while True:
        out = front.withColumnRenamed("v", "u").join(long, "u", "left")
        out = out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        reached = keep(adjacency.join(out, ["u", "salt"]).select("v", "label").distinct(), "reached")
        # very many labels may meet at one name: its own one is found by a combined minimum, and given back by a salted join
        own = reached.groupBy("v").agg(F.min("label").alias("least")).join(seen.withColumnRenamed("label", "first"), "v", "left")
        own = own.select("v", F.coalesce("first", "least").alias("own"), F.col("first").isNull().alias("new"))
        step = keep(lookup(reached, own, "v", F.col("label"), "inner"), "step")
        pairs = step.where("label <> own").select(F.col("own").alias("a"), F.col("label").alias("b")).distinct()
        met = pairs if met is None else met.unionByName(pairs)
        front = step.where("new and label = own").select("v", "label")
        if not front.limit(1).count():
            return seen, keep(met.distinct(), "met")
        seen = seen.unionByName(front)


def related_groups(names: DataFrame, scratch: Scratch, part: int = PART) -> DataFrame:
    """For names(dataset, embryo): (dataset, group_id), the least embryo of all that hang together."""
    links = names.select(F.concat(F.lit("d:"), "dataset").alias("u"), F.concat(F.lit("e:"), "embryo").alias("v"))
    labels, met = frontier_labels(scratch.keep(links, "links"), scratch, part)
    merged = consolidate(met).select(F.col("node").alias("label"), "group")
    labelled = scratch.keep(lookup(labels, merged, "label", F.col("v")).select("v", F.coalesce("group", "label").alias("group")), "labels")
    embryos = labelled.where(F.col("v").startswith("e:")).groupBy("group").agg(F.min(F.substring("v", 3, 1 << 30)).alias("group_id"))
    return lookup(labelled.where(F.col("v").startswith("d:")), embryos, "group", F.col("v"), "inner").select(F.substring("v", 3, 1 << 30).alias("dataset"), "group_id")


def unit(group) -> Column:
    return F.conv(F.substring(F.md5(group), 1, 4), 16, 10).cast("int")


def assign_splits(groups: DataFrame, targets: DataFrame, scratch: Scratch, seeds: int = SEEDS) -> DataFrame:
    """For groups(dataset, group_id) and targets(split_name, share): (unit, split_name), the split of all groups of a unit.

    Datasets are counted. Equal errors of shares go to the lower seed; sums are rounded to twelve decimals.
    """
    sizes = scratch.keep(groups.groupBy(unit(F.col("group_id")).alias("unit")).agg(F.count("*").alias("n")), "units")  # at most UNITS rows
    goal = targets.where(F.col("share") > 0).groupBy("split_name").agg(F.sum("share").alias("share"))
    spans = goal.select("split_name", "share", F.sum("share").over(W.orderBy("split_name")).alias("upto"), F.sum("share").over(W.partitionBy()).alias("all"))
    spans = spans.select("split_name", (F.col("share") / F.col("all")).alias("want"), F.round(F.col("upto") / F.col("all"), 12).alias("hi"))
    spans = scratch.keep(spans.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("split_name")), F.lit(0.0))), "spans")
    tried = sizes.select("unit", "n", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    order = W.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("unit").cast("string"))), "unit")
    upto = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    middle = F.round((2 * upto - F.col("n")) / (2 * F.sum("n").over(W.partitionBy("seed"))), 12)
    placed = tried.withColumn("at", middle).join(F.broadcast(spans), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    placed = scratch.keep(placed.select("seed", "unit", "n", "split_name"), "orders")
    got = placed.groupBy("seed", "split_name").agg(F.sum("n").alias("n"))
    got = got.select("seed", "split_name", (F.col("n") / F.sum("n").over(W.partitionBy("seed"))).alias("share"))
    every = got.select("seed").distinct().crossJoin(F.broadcast(spans.select("split_name", "want")))
    error = every.join(got, ["seed", "split_name"], "left").groupBy("seed").agg(F.round(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.col("want"))), 12).alias("error"))
    best = error.agg(F.min(F.struct("error", "seed")).alias("best")).select("best.seed")
    return placed.join(F.broadcast(best), "seed", "left_semi").select("unit", "split_name")

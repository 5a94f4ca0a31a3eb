"""Parent-child links to full hierarchies, by nested sets.

Links with one parent per node form a forest (but for cycles). Its nodes are range-partitioned by id and cut into chunks
of bounded size. In a chunk, subtree sizes are summed upward and siblings get preorder ranges by prefix sums downward;
what is left without a root is on or below a cycle, which is cut at one node. Pieces that hang on a node of another
chunk become one vertex for each chunk and outer parent, and the much smaller graph of these is solved in the same way:
sizes come up from it, positions go down to it. So the number of Spark jobs follows the number of levels of chunks, not
the depth of the trees, and a parent of very many children is spread over chunks.

Nodes with several parents (and nodes at which a cycle was cut) are roots of their own trees in that forest. The links
into them form a small graph between trees, over which distances and reachability are computed; nested-set ranges then
tell which nodes lie above a link, and so which ones are on cycles.

Defined cases: links with a null or unknown end do not count; repeated links count once; a node may be its own parent;
siblings ascend by id; empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.functions.forest import break_cycles, measure, path_sums, strong_components
from stemline.functions.runs import chunks, whole_groups
from stemline.skew import hot_ends, hot_keys, lookup
from stemline.store import Scratch

#: Rows of a chunk.
BOUND = 1_000_000


def existing_links(edges: DataFrame, nodes: DataFrame, source: str = "source_id", target: str = "target_id", key: str = "node_id") -> DataFrame:
    """(p, c) of links whose ends both exist; repeated links may remain."""
    ids = nodes.where(F.col(key).isNotNull()).select(F.col(key)).distinct()
    links = edges.select(F.col(source).alias("p"), F.col(target).alias("c")).where(F.col("p").isNotNull() & F.col("c").isNotNull())
    hot = hot_ends(links, ["p", "c"])
    links = lookup(links, ids.withColumnRenamed(key, "p"), "p", F.col("c"), "left_semi", hot["p"])
    return lookup(links, ids.withColumnRenamed(key, "c"), "c", F.col("p"), "left_semi", hot["c"])


def _ints(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = t.column(name)
    known = col.is_valid().to_numpy()
    return col.fill_null(0).to_numpy().astype(np.int64), known


def _parents(v: np.ndarray, p: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the parent among v (sorted), and whether it is there."""
    at = np.minimum(np.searchsorted(v, p), len(v) - 1)
    local = has & (v[at] == p)
    return np.where(local, at, np.arange(len(v))), local


def _rows(schema: str, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n.split()[0]] if isinstance(columns[n.split()[0]], pa.Array) else pa.array(columns[n.split()[0]]) for n in schema.split(", ")], [n.split()[0] for n in schema.split(", ")])


#: v: node, p: parent, lr: root of its piece, b: bundle of pieces with one outer parent, d: links below lr, pre: position
#: below lr, boff: position of lr in its bundle, size: of the subtree, cut: a cycle was cut above v.
PIECES = "v long, p long, lr long, b long, d long, pre long, boff long, size long, cut boolean"


def _bundles(p, has, lr, size):
    """Bundle and offset in it for each piece root, by outer parent (or bundle); siblings ascend by id."""
    n = len(p)
    roots = np.flatnonzero((lr == np.arange(n)) & has)
    o = roots[np.lexsort((roots, p[roots]))]
    first = np.r_[True, p[o][1:] != p[o][:-1]] if len(o) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0)) if len(o) else np.zeros(0, np.int64)
    before = np.cumsum(size[o]) - size[o]
    name, off = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    if len(o):
        name[o], off[o] = o[start], before - before[start]
    return name, off


def _cut_pieces(bound: int):
    def run(batches):
        for t in chunks(batches, bound):
            v, _ = _ints(t, "v")
            o = np.argsort(v)
            p, has = _ints(t, "p")
            v, p, has = v[o], p[o], has[o]
            par, local = _parents(v, p, has)
            cut = np.zeros(len(v), bool)
            cut[break_cycles(par, local)] = True
            root, hops, size, pre = measure(par, local, np.ones(len(v), np.int64), v)
            name, off = _bundles(p, has & ~local & ~cut, root, size)
            b = name[root]
            yield _rows(PIECES, v=v, p=pa.array(p, mask=~has), lr=v[root], b=pa.array(v[b], mask=b < 0), d=hops, pre=pre, boff=off[root], size=size, cut=cut)

    return run


#: kind 0: a node of the forest with new size, pre and boff; kind 1: an outer bundle e with its place under its parent.
PLACED = "kind int, v long, size long, pre long, boff long"


def _place(batches):
    for t in whole_groups(batches, "f"):
        kind = t.column("kind").to_numpy()
        v, _ = _ints(t, "v")
        p, has = _ints(t, "p")
        w, _ = _ints(t, "w")
        f, _ = _ints(t, "f")
        o = np.lexsort((v, kind))
        kind, v, p, has, w, f = (x[o] for x in (kind, v, p, has, w, f))
        n = int((kind == 0).sum())
        # outer bundles hang on nodes of this table as leaves, never as parents
        at = np.minimum(np.searchsorted(v[:n], p), n - 1)
        out = t.column("out").to_numpy()[o]
        local = has & (v[at] == p) & ~out
        par = np.where(local, at, np.arange(len(v)))
        root, hops, size, pre = measure(par, local, w, v)
        _, off = _bundles(f[:n], out[:n], root[:n], size[:n])
        boff = off[root]
        yield _rows(PLACED, kind=pa.array(kind, pa.int32()), v=v, size=size, pre=pre, boff=boff)


STEPS = "v long, root long, dist long, pos long, size long, cut boolean, p long, w long, len long, off long"


def _solve_chunk(bound: int):
    def run(batches):
        for t in chunks(batches, bound):
            v, _ = _ints(t, "v")
            o = np.argsort(v)
            p, has = _ints(t, "p")
            w, ln, off = (_ints(t, c)[0][o] for c in ("w", "len", "off"))
            v, p, has = v[o], p[o], has[o]
            par, local = _parents(v, p, has)
            cut = np.zeros(len(v), bool)
            cut[break_cycles(par, local)] = True
            root, _, size, _ = measure(par, local, w, v)
            _, (dist, pos) = path_sums(par, local, ln, off)
            yield _rows(STEPS, v=v, root=v[root], dist=dist, pos=pos, size=size, cut=cut, p=pa.array(p, mask=~has), w=w, len=ln, off=off)

    return run


def path_and_subtree_sums(t: DataFrame, scratch: Scratch, bound: int = BOUND, mate: int = 0) -> DataFrame:
    """For t(v, p, w, len, off), with a row for each p: (v, root, dist, pos, size, cut).

    dist and pos sum len and off from v up to its root, size sums w over the subtree, cut says that a cycle was cut
    above v. Up to bound rows take one task; beyond, chunks are contracted and the rest is solved in the same way. Where
    chunks of near ids do not shrink the graph, each of about a quarter of the nodes, drawn by hash, joins its parent.
    """
    spark = t.sparkSession
    n = t.count()
    if n <= bound:
        return t.repartition(1).mapInArrow(_solve_chunk(bound), STEPS).select("v", "root", "dist", "pos", "size", "cut")
    if mate:
        head = lambda c: F.pmod(F.xxhash64(c, F.lit(mate)), F.lit(2)) == 0
        loop = F.coalesce(F.col("p") == F.col("v"), F.lit(False))
        roots = t.where(F.col("p").isNull()).select(F.col("v").alias("p"), F.lit(True).alias("top"))
        known = t.where(F.col("p").isNotNull()).join(roots, "p", "left").unionByName(t.where(F.col("p").isNull()).withColumn("top", F.lit(False)))
        joins = F.col("p").isNotNull() & ~loop & (head("p") | F.coalesce(F.col("top"), F.lit(False))) & ~head("v")
        joins = F.coalesce(joins, F.lit(False))
        chunk = scratch.keep(
            known.select("v", F.when(joins, F.col("p")).otherwise(F.col("v")).alias("root"), F.when(joins, F.col("len")).otherwise(0).alias("dist"),
                         F.when(joins, F.col("off")).otherwise(0).alias("pos"), F.col("w").alias("size"), loop.alias("cut"), "p", "w", "len", "off"),
            "mate",
        )
        whole = chunk.groupBy(F.col("root").alias("v")).agg(F.sum("w").alias("sum"))
        tops = chunk.where(F.col("v") == F.col("root")).join(whole, "v").withColumn("size", F.col("sum")).drop("sum")
    else:
        parts = -(-n // bound)
        chunk = scratch.keep(t.repartitionByRange(parts, "v").sortWithinPartitions("v").mapInArrow(_solve_chunk(bound), STEPS), "chunk")
        tops = chunk.where(F.col("v") == F.col("root"))
    above = chunk.select(F.col("v").alias("att"), F.col("root").alias("up"), F.col("dist").alias("up_dist"), F.col("pos").alias("up_pos"))
    cross = scratch.keep(
        tops.where(F.col("p").isNotNull() & ~F.col("cut"))
        .select("v", F.col("p").alias("att"), F.col("size").alias("w"), "len", "off")
        .join(above, "att")
        .select("v", "att", F.col("up").alias("p"), "w", (F.col("len") + F.col("up_dist")).alias("len"), (F.col("off") + F.col("up_pos")).alias("off")),
        "cross",
    )
    ends = cross.select(F.col("p").alias("v")).distinct().join(cross.select("v"), "v", "left_anti")
    ends = ends.join(tops.select("v", F.col("size").alias("w")), "v").select("v", F.lit(None).cast("long").alias("p"), "w", F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("off"))
    smaller = scratch.keep(cross.drop("att").unionByName(ends), "smaller")
    slow = smaller.count() > 0.7 * n
    solved = scratch.keep(path_and_subtree_sums(smaller, scratch, bound, mate + 1 if slow or mate else 0), "solved")

    top = solved.select(F.col("v").alias("root"), F.col("root").alias("r"), F.col("dist").alias("r_dist"), F.col("pos").alias("r_pos"), F.col("size").alias("r_size"), F.col("cut").alias("r_cut"))
    placed = chunk.join(top, "root", "left")
    # subtree sums of nodes in contracted pieces: what hangs on them from other pieces, summed up the piece
    outer = cross.join(solved.where(~F.col("cut")).select("v", F.col("size").alias("s")), "v").groupBy(F.col("att").alias("v")).agg(F.sum("s").alias("more"))
    placed = placed.join(outer, "v", "left")
    if mate:
        size = F.when(F.col("v") == F.col("root"), F.coalesce("r_size", "size")).otherwise(F.col("w") + F.coalesce("more", F.lit(0)))
        # a node that no piece hangs on and that is not part of the smaller graph keeps its own sum
        tops_size = tops.select("v", F.col("size").alias("t_size"))
        placed = placed.join(tops_size, "v", "left").withColumn("size", F.when(F.col("v") == F.col("root"), F.coalesce("r_size", "t_size")).otherwise(size))
    else:
        open_ = placed.withColumn("f", F.col("root"))
        fed = open_.where(F.col("more").isNotNull()).select(F.col("f")).distinct()
        work = open_.join(fed, "f", "left_semi").select("f", F.lit(0).alias("kind"), "v", F.when((F.col("v") != F.col("root")), F.col("p")).alias("p"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.lit(False).alias("out"))
        sizes = work.repartition("f").sortWithinPartitions("f").mapInArrow(_place, PLACED).select("v", F.col("size").alias("n_size"))
        placed = placed.join(sizes, "v", "left").withColumn("size", F.coalesce("n_size", "size"))
    own = F.col("v") == F.col("root")
    return placed.select(
        "v", F.coalesce("r", "root").alias("root"), (F.col("dist") + F.coalesce("r_dist", F.lit(0))).alias("dist"), (F.col("pos") + F.coalesce("r_pos", F.lit(0))).alias("pos"),
        "size", (F.col("cut") | (own & F.coalesce("r_cut", F.lit(False)))).alias("cut"),
    )


def nested_sets(vertices: DataFrame, scratch: Scratch, bound: int = BOUND) -> DataFrame:
    """For vertices(v, p), p null for roots, with a row for each p: (v, p, root, depth, pre, size, cut).

    The descendants of v are the nodes of its root with pre in (v.pre, v.pre + v.size - 1]; its ancestors are those whose
    range holds v.pre. cut: v was on a cycle and is now a root.
    """
    spark = vertices.sparkSession
    pieces = scratch.keep(vertices.repartitionByRange("v").sortWithinPartitions("v").mapInArrow(_cut_pieces(bound), PIECES), "pieces")
    tops = pieces.where((F.col("v") == F.col("lr")) & F.col("b").isNotNull())
    bundles = tops.groupBy(F.col("b").alias("e"), F.col("p").alias("att")).agg(F.sum("size").alias("w"))
    above = pieces.select(F.col("v").alias("att"), F.col("lr").alias("a_lr"), F.col("b").alias("a_b"), F.col("d").alias("a_d"))
    cross = scratch.keep(bundles.join(above, "att"), "bundles")
    whole = pieces.select("v", "p", F.col("lr").alias("root"), F.col("d").alias("depth"), "pre", "size", "cut")
    if not cross.limit(1).count():
        return whole
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

    def with_ends(t: DataFrame) -> DataFrame:
        ends = t.select(F.col("p").alias("v")).where(F.col("v").isNotNull()).distinct().join(t.select("v"), "v", "left_anti")
        return t.unionByName(ends.select("v", none.alias("p"), zero.alias("w"), zero.alias("len"), zero.alias("off")))

    up = with_ends(cross.select(F.col("e").alias("v"), F.coalesce("a_b", "a_lr").alias("p"), "w", zero.alias("len"), zero.alias("off")))
    sums = scratch.keep(path_and_subtree_sums(scratch.keep(up, "up"), scratch, bound), "sums")
    sized = scratch.keep(cross.drop("w").join(sums.select(F.col("v").alias("e"), F.col("size").alias("w"), "cut"), "e"), "sized")

    hung = sized.where(~F.col("cut")).select(F.coalesce("a_b", "a_lr").alias("f"), F.lit(1).alias("kind"), F.col("e").alias("v"), F.col("att").alias("p"), "w", F.lit(False).alias("out"))
    open_ = pieces.withColumn("f", F.coalesce("b", "lr")).join(hung.select("f").distinct(), "f", "left_semi")
    own = F.col("v") == F.col("lr")
    # the outer parent of a piece root stays, so that its bundle is laid out again
    work = open_.select("f", F.lit(0).alias("kind"), "v", F.when(~own | F.col("b").isNotNull(), F.col("p")).alias("p"), F.lit(1).cast("long").alias("w"), (own & F.col("b").isNotNull()).alias("out"))
    laid = scratch.keep(work.unionByName(hung).repartition("f").sortWithinPartitions("f").mapInArrow(_place, PLACED), "laid")

    cut_bundles = sized.where("cut").select(F.col("e").alias("a_b"), F.lit(True).alias("a_cut"))
    inside = F.col("a_b").isNotNull() & F.col("a_cut").isNull()
    down = (
        sized.where(~F.col("cut"))
        .join(cut_bundles, "a_b", "left")
        .join(laid.where("kind = 1").select(F.col("v").alias("e"), "pre", "boff"), "e")
        .select(
            F.col("e").alias("v"), F.when(inside, F.col("a_b")).otherwise(F.col("a_lr")).alias("p"), zero.alias("w"),
            F.when(inside, F.col("a_d") + 1).otherwise(F.col("a_d")).alias("len"), F.when(inside, F.col("pre") + F.col("boff")).otherwise(F.col("pre")).alias("off"),
        )
    )
    placed = path_and_subtree_sums(scratch.keep(with_ends(down), "down"), scratch, bound)
    info = placed.select(F.col("v").alias("f"), F.col("root").alias("r"), "dist", "pos").join(sized.where(~F.col("cut")).select(F.col("e").alias("f")), "f", "left_semi")
    touched = hung.select("f").distinct().withColumn("redone", F.lit(True))
    broken = sized.where("cut").select(F.col("e").alias("f"), F.lit(True).alias("broken"))
    info = scratch.keep(info.join(touched, "f", "full").join(broken, "f", "full"), "info")

    kept = pieces.withColumn("f", F.coalesce("b", "lr")).join(info, "f", "left")
    fresh = laid.where("kind = 0").select("v", F.col("size").alias("n_size"), F.col("pre").alias("n_pre"), F.col("boff").alias("n_boff"))
    still = kept.where(F.col("redone").isNull())
    redone = kept.where(F.col("redone")).drop("size", "pre", "boff").join(fresh.withColumnsRenamed({"n_size": "size", "n_pre": "pre", "n_boff": "boff"}), "v")
    rows = still.unionByName(redone, allowMissingColumns=True)
    return rows.select(
        "v", "p", F.coalesce("r", "lr").alias("root"),
        F.when(F.col("r").isNotNull(), F.col("d") + 1 + F.col("dist")).otherwise(F.col("d")).alias("depth"),
        F.when(F.col("r").isNotNull(), F.col("pos") + F.col("boff") + F.col("pre")).otherwise(F.col("pre")).alias("pre"),
        "size", (F.col("cut") | (own & F.coalesce("broken", F.lit(False)))).alias("cut"),
    )


class Hierarchies:
    """The forest of links, and the links between its trees."""

    def __init__(self, links: DataFrame, bound: int = BOUND, bucket: int = 1_000_000):
        """links: (p, c), both ends known; may repeat."""
        self.spark: SparkSession = links.sparkSession
        self.scratch, self.bound, self.bucket = Scratch(self.spark, "hierarchies"), bound, bucket
        keep = self.scratch.keep
        self._hot: list | None = None
        links = keep(links.distinct(), "links")
        none = F.lit(None).cast("long")
        ends = links.select(F.col("c").alias("v"), F.col("p")).unionByName(links.select(F.col("p").alias("v"), none.alias("p")))
        seen = ends.groupBy("v").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
        single = (F.col("lo") == F.col("hi")) & (F.col("lo") != F.col("v"))
        vertices = seen.select("v", F.when(single, F.col("lo")).alias("p"))
        joined = seen.where(F.col("lo").isNotNull() & ~single).select(F.col("v").alias("c"))
        self.sets = keep(nested_sets(vertices, self.scratch, bound), "sets")
        into = links.join(keep(joined, "joined"), "c", "left_semi").select("p", "c")
        cut = self.sets.where("cut").select(F.col("p"), F.col("v").alias("c"))
        into = keep(into.unionByName(cut), "into")
        at = self.sets.select(F.col("v").alias("p"), F.col("root").alias("a"), "depth", "pre")
        #: Links into roots of trees: from node p (depth, pre) of the tree of a to the tree of c.
        self.between = keep(lookup(into, at, "p", F.col("c"), "inner").select("p", "c", "a", "depth", "pre"), "between")

    def hot_roots(self) -> list:
        """Roots of trees that hold much of all nodes."""
        if self._hot is None:
            self._hot = hot_keys(self.sets, "root")
        return self._hot

    def reached(self) -> DataFrame:
        """(c, r, dist): the fewest links from each true root r to each root c of a tree that has parents; r null where no root leads to c."""
        keep = self.scratch.keep
        trees = self.between.select("c").distinct()
        steps = keep(self.between.groupBy("a", "c").agg((F.min("depth") + 1).cast("long").alias("len")), "steps")
        inner = keep(trees, "trees")
        new = keep(steps.join(inner.select(F.col("c").alias("a")), "a", "left_anti").select("c", F.col("a").alias("r"), F.col("len").alias("dist")), "new")
        best = self._relaxed(new, steps)
        return keep(inner.join(best, "c", "left"), "reached")

    def _relaxed(self, new: DataFrame, steps: DataFrame) -> DataFrame:
        """(c, r, dist): the fewest links, from the distances new(c, r, dist) on over steps(a, c, len)."""
        known = [new]
        while new.limit(1).count():
            further = new.withColumnsRenamed({"c": "a"}).join(steps, "a").groupBy("c", "r").agg(F.min(F.col("dist") + F.col("len")).alias("dist"))
            best = self._union(known).groupBy("c", "r").agg(F.min("dist").alias("had"))
            new = self.scratch.keep(further.join(best, ["c", "r"], "left").where(F.col("had").isNull() | (F.col("dist") < F.col("had"))).select("c", "r", "dist"), "new")
            known.append(new)
        return self._union(known).groupBy("c", "r").agg(F.min("dist").alias("dist"))

    def _closure(self, trees: DataFrame) -> DataFrame:
        """(x, c): the trees c that each of trees(c) leads to over any number of links, itself included."""
        keep = self.scratch.keep
        steps = keep(self.between.select("a", "c").distinct(), "steps")
        known = front = keep(trees.select(F.col("c").alias("x"), "c"), "closure")
        while front.limit(1).count():
            nxt = front.withColumnRenamed("c", "a").join(steps, "a").select("x", "c").distinct()
            front = keep(nxt.join(known, ["x", "c"], "left_anti"), "closure")
            known = known.unionByName(front)
        return known

    def starts(self) -> DataFrame:
        """(c, r, dist, rootless, p) for each tree c that has parents and each start r of its paths.

        p is the parent of c on a path of fewest links from r (the least such p). Starts are the roots; for trees that no
        root leads to (rootless), the least root of a tree on each first cycle above them.
        """
        keep = self.scratch.keep
        reached = self.reached()
        found = reached.where(F.col("r").isNotNull()).withColumn("rootless", F.lit(False))
        lost = keep(reached.where(F.col("r").isNull()).select("c"), "lost")
        if lost.limit(1).count():
            pairs = keep(self._closure(lost).join(lost, "c", "left_semi"), "lost_pairs")
            back = pairs.select(F.col("c").alias("x"), F.col("x").alias("c"), F.lit(True).alias("both"))
            # on a first cycle, whatever leads to a tree is also led to by it
            tops = pairs.join(back, ["x", "c"], "left").groupBy("c").agg(F.min(F.col("both").isNotNull()).alias("first"), F.min("x").alias("r"))
            new = keep(tops.where("first").select(F.col("r").alias("c"), "r", F.lit(0).cast("long").alias("dist")).distinct(), "first")
            steps = self.between.join(lost, "c", "left_semi").groupBy("a", "c").agg((F.min("depth") + 1).cast("long").alias("len"))
            found = found.unionByName(self._relaxed(new, keep(steps, "lost_steps")).withColumn("rootless", F.lit(True)))
        found = keep(found, "starts")
        trees = self.between.select(F.col("c").alias("a")).distinct()
        direct = self.between.join(trees, "a", "left_anti").select("c", "p", F.col("a").alias("r"), (F.col("depth") + 1).alias("total"))
        later = self.between.join(found.select(F.col("c").alias("a"), "r", "dist"), "a").select("c", "p", "r", (F.col("dist") + F.col("depth") + 1).alias("total"))
        via = direct.unionByName(later).join(found.select("c", "r", "dist"), ["c", "r"]).where("total = dist").groupBy("c", "r").agg(F.min("p").alias("p"))
        return keep(found.join(via, ["c", "r"], "left"), "starts")

    def table(self) -> DataFrame:
        """(node_id, parent_id, tree_id, depth, pre, last, on_cut, merged): nested sets; merged: the tree's root has parents."""
        trees = self.between.select(F.col("c").alias("tree_id")).distinct().withColumn("merged", F.lit(True))
        rows = self.sets.select(
            F.col("v").alias("node_id"), F.when(F.col("root") != F.col("v"), F.col("p")).alias("parent_id"), F.col("root").alias("tree_id"),
            F.col("depth").cast("int").alias("depth"), "pre", (F.col("pre") + F.col("size") - 1).alias("last"), F.col("cut").alias("on_cut"),
        )
        return self.scratch.keep(lookup(rows, trees, "tree_id", F.col("node_id")).withColumn("merged", F.coalesce("merged", F.lit(False))), "table")

    def exits(self, table: DataFrame, segment: int) -> DataFrame:
        """(p, a, upto) of each node p with a link into another tree, or back to its tree's root: the path from the root of its tree a."""
        ends = self.between.select(F.col("p").alias("node_id"), F.lit(True).alias("wanted")).distinct()
        trees = self.between.select(F.col("a").alias("tree_id")).distinct()
        rows = lookup(table, trees, "tree_id", F.col("node_id"), "left_semi")
        rows = lookup(rows, ends, "node_id", F.col("tree_id"), hot=[]).withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        return self.scratch.keep(paths(rows.withColumnRenamed("tree_id", "root_id"), self.scratch, segment).select(F.col("node_id").alias("p"), F.col("root_id").alias("a"), F.col("path").alias("upto")), "exits")

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _strong(self, steps: DataFrame) -> DataFrame:
        """(v, comp) of the strong components of the graph of trees, for trees that can be on a cycle."""
        keep = self.scratch.keep
        core = keep(steps, "core")
        while (n := core.count()) > self.bound:  # trees without a link in or out are on no cycle
            left = core.join(core.select(F.col("c").alias("a")).distinct(), "a", "left_semi")
            left = keep(left.join(left.select(F.col("a").alias("c")).distinct(), "c", "left_semi").select("a", "c"), "core")
            if left.count() == n:
                return self._coloured(left)
            core = left
        spark_schema = "v long, comp long"

        def run(batches):
            t = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("c", pa.int64())]))
            if not t.num_rows:
                return
            ids, at = np.unique(np.r_[t.column("a").to_numpy(), t.column("c").to_numpy()], return_inverse=True)
            comp = strong_components(len(ids), at[: t.num_rows], at[t.num_rows :])
            least = np.full(comp.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, comp, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least[comp])], ["v", "comp"])

        return keep(core.select("a", "c").repartition(1).mapInArrow(run, spark_schema), "strong")

    def _coloured(self, core: DataFrame) -> DataFrame:
        """Strong components of a graph of any size: spread the largest id forward, then collect each colour backward."""
        keep, found = self.scratch.keep, []
        while core.limit(1).count():
            colour = keep(core.select(F.col("a").alias("v")).union(core.select("c")).distinct().withColumn("col", F.col("v")), "colour")
            while True:
                got = core.join(colour.withColumnRenamed("v", "a"), "a").groupBy(F.col("c").alias("v")).agg(F.max("col").alias("in"))
                nxt = keep(colour.join(got, "v", "left").select("v", F.greatest("col", F.coalesce("in", "col")).alias("col"), (F.coalesce("in", "col") > F.col("col")).alias("moved")), "colour")
                colour = nxt.drop("moved")
                if not nxt.where("moved").limit(1).count():
                    break
            comp = keep(colour.where(F.col("v") == F.col("col")).select("v", F.col("v").alias("comp")), "comp")
            same = core.join(colour.select(F.col("v").alias("a"), F.col("col").alias("ca")), "a").join(colour.select(F.col("v").alias("c"), F.col("col").alias("cc")), "c").where("ca = cc").select("a", "c")
            same, front = keep(same, "same"), comp
            while front.limit(1).count():
                back = same.join(front.select(F.col("v").alias("c"), "comp"), "c").select(F.col("a").alias("v"), "comp").distinct()
                front = keep(back.join(comp, "v", "left_anti"), "front")
                comp = keep(comp.unionByName(front), "comp")
            found.append(comp)
            done = comp.select("v")
            core = core.join(done.withColumnRenamed("v", "a"), "a", "left_anti").join(done.withColumnRenamed("v", "c"), "c", "left_anti")
            core = keep(core.select("a", "c"), "core")
        return self._union(found) if found else core.select(F.col("a").alias("v"), F.col("c").alias("comp"))

    def on_cycles(self) -> DataFrame:
        """(v, root) of nodes that can be reached from themselves."""
        trees = self.between.select("c").distinct()
        steps = self.between.select("a", "c").join(trees.select(F.col("c").alias("a")), "a", "left_semi").distinct()
        strong = self._strong(steps)
        ends = self.between.join(strong.select(F.col("v").alias("a"), F.col("comp").alias("x")), "a").join(strong.select(F.col("v").alias("c"), F.col("comp").alias("y")), "c").where("x = y")
        sources = self.scratch.keep(ends.select(F.col("a").alias("root"), F.col("pre").alias("at")).distinct(), "cyclic")
        nodes = lookup(self.sets, sources.select("root").distinct(), "root", F.col("v"), "left_semi", self.hot_roots()).select("root", "v", F.col("pre").alias("at"), (F.col("pre") + F.col("size") - 1).alias("upto"))
        # a node is above a cyclic link's source if its range holds it: the next source at or behind the node's own place.
        # Buckets of places keep the windows bounded.
        none = F.lit(None).cast("long")
        marks = nodes.unionByName(sources.select("root", none.alias("v"), "at", none.alias("upto"))).withColumn("bucket", F.floor(F.col("at") / self.bucket))
        later = sources.groupBy("root", F.floor(F.col("at") / self.bucket).alias("bucket")).agg(F.min("at").alias("first"))
        spans = marks.select("root", "bucket").distinct().join(later, ["root", "bucket"], "left")
        ahead = W.partitionBy("root").orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
        spans = spans.withColumn("beyond", F.min("first").over(ahead)).select("root", "bucket", "beyond")
        here = W.partitionBy("root", "bucket").orderBy(F.col("at").desc(), F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
        nearest = F.coalesce(F.min(F.when(F.col("v").isNull(), F.col("at"))).over(here), F.col("beyond"))
        above = marks.join(spans, ["root", "bucket"]).withColumn("next", nearest)
        return above.where(F.col("v").isNotNull() & (F.col("next") <= F.col("upto"))).select("v", "root")

    def rows(self) -> DataFrame:
        """(node_id, root_id, depth) as p3_found has them: from each root by the fewest links; -1 on cycles; -2 only behind cycles."""
        keep = self.scratch.keep
        reached = self.reached()
        mark = F.lit(True)
        hot = self.hot_roots()
        found = lookup(self.sets.select("v", "root", "depth"), reached.withColumn("known", mark).withColumnRenamed("c", "root"), "root", F.col("v"), hot=hot)
        direct = found.where(F.col("known").isNull() | F.col("r").isNotNull()).select(
            F.col("v").alias("node_id"), F.coalesce("r", "root").alias("root_id"), (F.coalesce("dist", F.lit(0)) + F.col("depth")).cast("int").alias("depth")
        )
        if not self.between.limit(1).count():
            return direct
        cyclic = keep(self.on_cycles(), "on_cycles")
        on = cyclic.select(F.col("v").alias("node_id"), F.lit(-1).cast("long").alias("root_id"), F.lit(-1).alias("depth"))
        # trees behind cycles
        steps = self.between.select("a", "c").distinct()
        behind = front = keep(cyclic.select(F.col("root").alias("c")).distinct(), "behind")
        while front.limit(1).count():
            nxt = front.withColumnRenamed("c", "a").join(steps, "a").select("c").distinct()
            front = keep(nxt.join(behind, "c", "left_anti"), "behind")
            behind = behind.unionByName(front)
        unrooted = behind.join(reached.where(F.col("r").isNotNull()).select("c").distinct(), "c", "left_anti")
        after = lookup(self.sets.select("v", "root"), unrooted.withColumnRenamed("c", "root"), "root", F.col("v"), "left_semi", hot).join(cyclic.select("v"), "v", "left_anti")
        return direct.unionByName(on).unionByName(after.select(F.col("v").alias("node_id"), F.lit(-2).cast("long").alias("root_id"), F.lit(-2).alias("depth")))


def hierarchy_table(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node_id, parent_id, root_id, depth, pre, last, n_descendants, on_cut): the nested sets of the forest of links.

    A node with several parents is the root of its own tree here; full_hierarchy() and full_paths() follow all its parents.
    """
    sets = Hierarchies(links, bound).sets
    return sets.select(
        F.col("v").alias("node_id"), F.when(F.col("root") != F.col("v"), F.col("p")).alias("parent_id"), F.col("root").alias("root_id"),
        F.col("depth").cast("int").alias("depth"), "pre", (F.col("pre") + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("n_descendants"), F.col("cut").alias("on_cut"),
    )


def paths(table: DataFrame, scratch: Scratch, segment: int = 200_000) -> DataFrame:
    """(node_id, root_id, depth, path): ids from the root down to the node, for a hierarchy_table; of rows that are wanted, where it says so.

    Trees are walked in preorder, in segments of bounded length; the path to the head of a segment comes from the
    nested-set ranges that hold it.
    """
    wanted = F.col("wanted") if "wanted" in table.columns else F.lit(True)
    rows = table.select("node_id", "root_id", "depth", "pre", wanted.alias("wanted"), F.floor(F.col("pre") / segment).alias("seg"), F.floor(F.col("last") / segment).alias("last_seg"))
    # a node is above the heads of all segments that start within its range
    above = rows.where("last_seg > seg").select("root_id", F.explode(F.sequence(F.col("seg") + 1, F.col("last_seg"))).alias("seg"), "node_id", "depth", F.lit(-1).cast("long").alias("at"), F.lit(False).alias("wanted"))
    every = rows.select("root_id", "seg", "node_id", "depth", F.col("pre").alias("at"), "wanted").unionByName(above)
    keys = ["root_id", "seg"]
    walked = every.repartition(*keys).sortWithinPartitions(*keys, "at", "depth")

    def walk(batches):
        stack: pa.Table | None = None  # the path to the last row
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            old = 0 if stack is None else stack.num_rows
            t = pa.concat_tables([stack, t]).combine_chunks() if old else t
            v, d, at = (t.column(c).to_numpy() for c in ("node_id", "depth", "at"))
            # the ancestor at a depth is the last row so deep: every path comes in preorder behind its head's
            start = np.r_[0, np.cumsum(d + 1)].astype(np.int64)
            flat, rows, k = np.empty(start[-1], np.int64), np.arange(len(v)), 0
            while len(rows):
                last = np.maximum.accumulate(np.where(d[rows] == k, rows, -1))
                flat[start[rows] + k] = v[last]
                if k <= d[-1]:  # the last row is among these rows
                    path = [*path, last[-1]] if k else [last[-1]]
                rows = rows[d[rows] > k]
                k += 1
            out = np.flatnonzero((np.arange(len(v)) >= old) & t.column("wanted").to_numpy())
            size = d[out] + 1
            offsets = np.r_[0, np.cumsum(size)]
            took = flat[np.repeat(start[out] - offsets[:-1], size) + np.arange(offsets[-1])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(took))
            take = pa.array(out)
            yield pa.RecordBatch.from_arrays([t.column(c).take(take).combine_chunks() for c in ("node_id", "root_id", "depth")] + [lists], ["node_id", "root_id", "depth", "path"])
            stack = t.take(pa.array(path))

    return walked.mapInArrow(walk, "node_id long, root_id long, depth int, path array<long>")


def node_ranges(h: Hierarchies, segment: int = 200_000) -> DataFrame:
    """(node_id, parent_id, tree_id, depth, pre, last, trees_below, n_descendants, on_cycle): a row for each node; depth is within its tree.

    The descendants of a node are the nodes of its tree with pre behind its own up to last, and all nodes of trees_below;
    n_descendants counts them, without the node itself. on_cycle: the node is its own ancestor.
    """
    keep, table = h.scratch.keep, h.table()
    exits = h.exits(table, segment)
    trees = h.between.select("c").distinct()
    tops = exits.select("p", "a", F.explode("upto").alias("node_id")).join(h.between.select("p", "c"), "p").select("node_id", "a", "c").distinct()
    leads = h._closure(trees).select(F.col("x").alias("c"), F.col("c").alias("tree"))
    below = tops.join(leads, "c").select("node_id", "a", "tree").distinct()
    sizes = table.where("merged and node_id = tree_id").select(F.col("tree_id").alias("tree"), (F.col("last") - F.col("pre") + 1).alias("size"))
    below = below.join(sizes, "tree").groupBy("node_id").agg(F.sort_array(F.collect_list("tree")).alias("trees_below"), F.sum("size").alias("more"), F.max(F.col("tree") == F.col("a")).alias("on_cycle"))
    rows = lookup(table, keep(below, "below"), "node_id", F.col("tree_id"), hot=[])
    rows = rows.withColumns({"trees_below": F.coalesce("trees_below", F.array().cast("array<long>")), "on_cycle": F.coalesce("on_cycle", F.lit(False))})
    # a node on a cycle has its whole tree among the trees below it, and so itself
    own = F.when(F.col("on_cycle"), -1).otherwise(F.col("last") - F.col("pre"))
    rows = rows.withColumn("n_descendants", F.coalesce("more", F.lit(0)) + own)
    return rows.select("node_id", "parent_id", "tree_id", "depth", "pre", "last", "trees_below", "n_descendants", "on_cycle")


def full_hierarchy(links: DataFrame, bound: int = BOUND, segment: int = 200_000) -> DataFrame:
    """(node_id, parent_id, root_id, depth, rootless, tree_id, pre, last, trees_below, n_descendants, on_cycle): node_ranges() for each root above a node.

    depth is the fewest links from the root, parent_id the parent on such a path (the least, where there are several).
    rootless: no root leads to the node, root_id is on a first cycle above it.
    """
    h = Hierarchies(links, bound)
    rows = h.scratch.keep(node_ranges(h, segment), "ranges")
    found = lookup(rows, h.starts().withColumnRenamed("c", "tree_id"), "tree_id", F.col("node_id"))
    return found.select(
        "node_id", F.when(F.col("node_id") == F.col("tree_id"), F.col("p")).otherwise(F.col("parent_id")).alias("parent_id"), F.coalesce("r", "tree_id").alias("root_id"),
        (F.coalesce("dist", F.lit(0)) + F.col("depth")).cast("int").alias("depth"), F.coalesce("rootless", F.lit(False)).alias("rootless"),
        "tree_id", "pre", "last", "trees_below", "n_descendants", "on_cycle",
    )


def full_paths(links: DataFrame, bound: int = BOUND, segment: int = 200_000) -> DataFrame:
    """(node_id, root_id, depth, path, rootless): for each node and root above it a path of fewest links, from the root to the node.

    rootless: no root leads to the node, and the path comes from a node on a first cycle above it, as in full_hierarchy().
    """
    h = Hierarchies(links, bound)
    keep, table = h.scratch.keep, h.table()
    plain = paths(table.where("not merged").withColumnRenamed("tree_id", "root_id"), h.scratch, segment).withColumn("rootless", F.lit(False))
    if not h.between.limit(1).count():
        return plain
    starts = h.starts()
    via = keep(starts.where(F.col("p").isNotNull()).join(h.exits(table, segment), "p").select("c", "r", "rootless", "a", "upto"), "via")
    # paths down to the parents of trees, from the start on, a tree in each round
    front = keep(via.where("a = r").select("c", "r", "rootless", F.col("upto").alias("head")), "heads")
    heads = [starts.where(F.col("p").isNull()).select("c", "r", "rootless", F.array().cast("array<long>").alias("head")), front]
    while front.limit(1).count():
        nxt = via.where("a <> r").join(front.select(F.col("c").alias("a"), "r", "head"), ["a", "r"])
        front = keep(nxt.select("c", "r", "rootless", F.concat("head", "upto").alias("head")), "heads")
        heads.append(front)
    merged = table.where("merged").withColumnRenamed("tree_id", "root_id")
    hot = hot_keys(merged, "root_id")
    found = lookup(paths(merged, h.scratch, segment), h._union(heads).withColumnRenamed("c", "root_id"), "root_id", F.col("node_id"), "inner", hot)
    path = F.concat("head", "path")
    return plain.unionByName(found.select("node_id", F.col("r").alias("root_id"), (F.size(path) - 1).alias("depth"), path.alias("path"), "rootless"))

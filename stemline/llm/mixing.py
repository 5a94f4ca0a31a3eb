"""Mixing sources to target weights.

The mix is cut into blocks of equal tokens. Sainte-Laguë apportionment gives them to the sources by highest quotients
share / (2 k + 1), each at most as many as its texts allow when all are used max_repeats times; what a source cannot
take goes to the others. The blocks of each source are then given to the shards as integer quotas, evenly. Only then are
texts selected: the texts of a source, in the order of a seeded hash, fill its blocks, again and again.

Only sums for each listed source (the rows of the target table) come to the driver. Positions of texts are prefix sums
over hash buckets, so that a source with most texts is not one task.

Defined cases: the size of the mix is that of all texts, those without a listed source included; these take no part, nor
do texts without tokens; repeated target rows count once, a null max_repeats is 1, a null or negative share is 0; without
documents or targets the mix is empty. Extra columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.llm.bpe import VOCABULARY, count_tokens
from stemline.store import Scratch

BLOCK = 512
SHARDS = 16
#: Most rows of the target table.
MOST_SOURCES = 10_000


def sainte_lague(seats: int, shares: list[float], caps: list[int]) -> list[int]:
    """Seats for each share by highest quotients share / (2 k + 1), within caps; ties go to the earlier one."""
    caps = [c if w > 0 else 0 for w, c in zip(shares, caps)]
    if sum(caps) <= seats:
        return caps
    at = lambda m: [min(c, int(w * m + 0.5)) for w, c in zip(shares, caps)]
    lo, hi = 0.0, 1.0
    while sum(at(hi)) <= seats:
        lo, hi = hi, hi * 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) <= seats else (lo, mid)
    got = at(lo)
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(shares, got, caps)) if g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


class Mix:
    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK, shards: int = SHARDS, path: str = VOCABULARY):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "mixing")
        self.sizes = self.scratch.keep(count_tokens(docs, ["doc_id", "source"], path=path), "sizes")
        wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
            F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats")
        )
        goal = wanted.orderBy("source").limit(MOST_SOURCES + 1).collect()
        if len(goal) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources in the target table")
        have = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(wanted.select("source", F.lit(1).alias("listed")), "source", "left")
        have = have.groupBy(F.when(F.col("listed") == 1, F.col("source")).alias("source")).agg(F.sum("n").alias("n")).collect()
        tokens = {r.source: r.n or 0 for r in have}
        self.total = sum(tokens.values())
        self.block, self.seed = block, seed
        caps = [-(-max(0, g.repeats) * tokens.get(g.source, 0) // block) for g in goal]
        blocks = sainte_lague(round(self.total / block), [g.share for g in goal], caps)
        quotas, turn = [], 0
        self.plan = []
        for g, q, c in zip(goal, blocks, caps):
            own, at = [q // shards + (s < q % shards) for s in range(shards)], 0
            for s, n in enumerate(own):  # spare blocks go round the shards over all sources
                quotas.append((g.source, (s + turn) % shards, at, at + n))
                at += n
            turn += q % shards
            self.plan.append((g.source, float(g.share), int(g.repeats), int(tokens.get(g.source, 0)), int(q), q == c))
        #: One row for each source: share, repeats, tokens there, blocks given, and whether its texts allow no more.
        self.sources = spark.createDataFrame(self.plan, "source string, target_share double, max_repeats int, available_tokens long, blocks long, capped boolean")
        #: One row for each source and shard: its blocks, from and to.
        self.quotas = spark.createDataFrame(quotas, "source string, shard int, first_block long, end_block long")

    def rows(self) -> DataFrame:
        """(doc_id, source, copy, block, shard, n_tokens): the texts of the mix."""
        listed = self.sizes.where(F.col("n_tokens") > 0).join(F.broadcast(self.sources.where("blocks > 0")), "source")
        placed = listed.withColumn("h", F.xxhash64("doc_id", F.lit(self.seed))).withColumn("bucket", F.shiftright("h", 48))
        buckets = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))  # at most 65,536 for each source
        before = buckets.select("source", "bucket", (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
        run = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
        middle = placed.withColumn("upto", run).join(before, ["source", "bucket"]).withColumn("at", F.col("before") + F.col("upto") - F.col("n_tokens") / 2)
        drawn = F.col("blocks") * self.block
        whole = F.floor(drawn / F.col("available_tokens"))
        copies = (whole + F.when(F.col("at") < drawn - whole * F.col("available_tokens"), 1).otherwise(0)).cast("int")
        # the last block of a source that is used up may not be full
        used = middle.withColumn("n_copies", F.least(copies, "max_repeats")).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        used = used.withColumn("block", F.floor((F.col("copy") * F.col("available_tokens") + F.col("at")) / self.block))
        shard = F.broadcast(self.quotas.withColumnRenamed("source", "q_source"))
        inside = (F.col("source") == F.col("q_source")) & (F.col("block") >= F.col("first_block")) & (F.col("block") < F.col("end_block"))
        return used.join(shard, inside).select("doc_id", "source", "copy", "block", "shard", "n_tokens")

    def report(self) -> DataFrame:
        """One row for each listed source: what it should have, has and gives."""
        drawn = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.countDistinct("doc_id").alias("n_docs"), (F.max("copy") + 1).alias("most_copies"))
        out = self.sources.join(drawn, "source", "left").fillna(0, ["drawn_tokens", "n_docs", "most_copies"])
        return out.select(
            "source", "target_share", (F.col("drawn_tokens") / F.sum("drawn_tokens").over(W.partitionBy())).alias("actual_share"), "max_repeats", "most_copies",
            "available_tokens", "drawn_tokens", "n_docs", "capped", F.lit(self.total).alias("mix_size"),
        )

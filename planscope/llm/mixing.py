"""Mixing sources to target weights: exact block quotas, a multivariate-hypergeometric splitting tree, and
disjoint permuted blocks per output shard.

1. Target words per source: the sources share ``epochs`` of all words by weight; a target stops at
   ``most`` times its source's words and the excess goes to the others by weight until none is above.
2. Every source is cut into ``BLOCKS`` blocks by a hash of its documents. Blocks in a seeded permutation are
   taken whole, one pass after another, as long as they fit the target (a block that doesn't fit is passed
   over for later, smaller ones), then the best closing document of the first block passed over is sought
   document by document, so the words taken come as near as whole documents allow. This gives the quota: an
   exact number of (pass, block) units per source.
3. A binary tree over the output shards splits the vector of quotas at each node with a multivariate
   hypergeometric draw; a leaf holds how many units of each source its shard gets. Each shard takes that
   many consecutive units of the source's permutation, so shards are disjoint and exhaust the quota.
4. Inside a shard rows are ordered by a seeded hash: the local shuffle.

What reaches the driver are one row per source (quotas for the tree). Block plans stay distributed: a group
is one source with at most ``2 * BLOCKS`` rows whatever its size, and a source with a third of all rows
spreads over its blocks. Reruns agree: all randomness is hashing or seeded generators.

Texts move once at most: sizes and plans are made from hashes and word counts, and a plan of at most ``PLAN`` rows is
broadcast to the documents (a larger one is joined by source and block).

Defined cases: null text has size 0; null source is a source of its own, last in order; documents of size 0
are taken in full passes only as their block is; sources without words have target 0; rows that share an id or have
none are separate documents (block and order depend on id and text); of rows with equal id and text, which only the
closing block can split, some get a copy more than others; an empty table gives an empty plan.
Input columns other than the operator's own outputs are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planscope.llm.common import WORD, checkpointed, small_batches, table

BLOCKS = 1024
#: Rows of the plan (source, block) up to which it is broadcast: some 10 MB.
PLAN = 100_000
#: Pieces of an output shard that are shuffled and sorted apart.
PIECES = 16
OWN = ["size", "source_size", "target", "taken", "copies", "shards"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and in the order of code points with null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def targets(sizes: DataFrame, weights: tuple[float, ...], epochs: float, most: float) -> DataFrame:
    """``sizes``: (__source, source_size), a row per source. Adds target: min(cap, level * weight) with the
    level at which the targets add up, found from prefix sums over the sources by cap per weight."""
    rank = F.row_number().over(Window.orderBy("__source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__w", w).withColumn("__cap", F.lit(most) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), "__source")
    full = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(epochs)
    left_words = total - F.coalesce(F.sum("__cap").over(full), F.lit(0.0))
    left_weight = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(full), F.lit(0.0))
    rows = rows.withColumn("__level", left_words / left_weight)
    # the level holds from the first source on whose cap is not reached at it
    level = F.min(F.when(F.col("__cap") > F.col("__level") * F.col("__w"), F.struct("__cap_rate", "__level"))).over(every)["__level"]
    rows = rows.withColumn("__cap_rate", F.col("__cap") / F.col("__w")).withColumn("__at", level)
    target = F.when(F.col("__at").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__at") * F.col("__w")))
    return rows.select("__source", "source_size", target.alias("target"))


def _plan_source(seed: int):
    """Units (pass, block) of one source in the order in which they are taken."""

    def plan(key, blocks: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *key[0].encode("utf-8", "surrogatepass")])
        blocks = blocks.sort_values("__block")
        number, size, target = blocks["__block"].to_numpy(), blocks["words"].to_numpy(), float(blocks["target"].iloc[0])
        out, got = [], 0
        for turn in range(2):
            spare = None
            for i in rng.permutation(len(number)):
                if got + size[i] <= target and target > 0:
                    got += size[i]
                    out.append((turn, number[i], len(out), False))
                elif spare is None and target > 0:
                    spare = number[i]
            if spare is not None:
                out.append((turn, spare, len(out), True))
                break
        return pd.DataFrame({
            "__source": key[0], "__turn": [x[0] for x in out], "__block": [x[1] for x in out], "__at": [x[2] for x in out],
            "__part": [x[3] for x in out], "__rest": float(target - got),
        })

    return plan


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Units of each source (column) per shard (row): halves of the shards draw their units without replacement."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    rng = np.random.default_rng(seed)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        draw = int(round(counts.sum() * (mid - lo) / (hi - lo)))
        left = rng.multivariate_hypergeometric(counts, draw, method="marginals") if counts.sum() else counts
        split(left, lo, mid)
        split(counts - left, mid, hi)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    epochs: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words), copies, shards (one per copy, in order of passes)."""
    assert 0 < epochs <= most <= 2
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    order = F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    block = F.pmod(F.xxhash64(F.lit("block"), order), F.lit(BLOCKS)).cast("int")
    rows = docs.select(
        *kept, word_count(F.col(text_col)).alias("size"), source_key(F.col(source_col)).alias("__source"),
        block.alias("__block"), order.alias("__order"),
    )
    slim = checkpointed(rows.select("__source", "__block", "__order", "size"))
    # one row per source and block: at most BLOCKS times the number of sources
    blocks = checkpointed(slim.groupBy("__source", "__block").agg(F.sum("size").alias("words")))
    target = targets(blocks.groupBy("__source").agg(F.sum("words").alias("source_size")), weights, epochs, most)
    units = blocks.join(target, "__source").groupBy("__source").applyInPandas(
        _plan_source(seed), "__source string, __turn int, __block int, __at int, __part boolean, __rest double"
    )
    units = checkpointed(units)
    quota = units.groupBy("__source").agg(F.count("*").alias("n")).orderBy("__source").collect()
    per_shard = split_tree(np.array([r.n for r in quota], dtype=np.int64), shards, seed)
    until = np.cumsum(per_shard, axis=0)
    cuts = spark.createDataFrame([(r["__source"], [int(x) for x in until[:, k]]) for k, r in enumerate(quota)], "__source string, __cuts array<bigint>")
    units = units.join(cuts, "__source", "left").withColumn("__shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__at"))))
    plan = units.groupBy("__source", "__block").agg(
        F.array_sort(F.collect_list(F.when(~F.col("__part"), F.struct("__turn", "__shard")))).alias("__full"),
        F.max(F.when(F.col("__part"), F.struct("__turn", "__shard", "__rest"))).alias("__last"),
    )
    plan = checkpointed(plan.join(_closing(slim, plan), ["__source", "__block"], "left").join(target, "__source"))
    few = plan.count() <= PLAN
    out = rows.join((F.broadcast(plan) if few else plan).drop("source_size", "target"), ["__source", "__block"], "left")
    sizes = target.select("__source", "source_size", "target")
    return _finish(out.join(F.broadcast(sizes) if few else sizes, "__source", "left"), plan, kept)


def _closing(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """(__source, __block, __end): where a block taken in part ends, as a struct of the order and size of the last rows and
    how many of the rows with these are taken (__take of __of); null if all of the block is."""
    spare = plan.where(F.col("__last").isNotNull()).select("__source", "__block", F.col("__last.__rest").alias("__rest"))
    keys = slim.join(spare, ["__source", "__block"]).groupBy("__source", "__block", "__order", "size", "__rest").agg(F.count("*").alias("__of"))
    upto = Window.partitionBy("__source", "__block").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("__of")
    keys = keys.withColumn("__sum", F.sum(words).over(upto)).where(F.col("__sum") > F.col("__rest"))
    take = F.floor((F.col("__rest") - (F.col("__sum") - words)) / F.col("size") + 0.5)
    end = F.struct("__order", "size", F.greatest(F.lit(0), F.least("__of", take.cast("long"))).alias("__take"), "__of")
    return keys.groupBy("__source", "__block").agg(F.min(end).alias("__end"))


def _finish(out: DataFrame, plan: DataFrame, kept: list[Column]) -> DataFrame:
    """Copies per document from the plan of its block; documents of blocks that no unit takes have none."""
    end, here = F.col("__end"), F.struct("__order", "size")
    before = F.coalesce(here < F.struct("__end.__order", "__end.size"), end.isNull())
    at_end = F.coalesce(here == F.struct("__end.__order", "__end.size"), F.lit(False))
    some = at_end & (end["__take"] > 0) & (end["__take"] < end["__of"])
    whole = F.col("__last").isNotNull() & (before | (at_end & (end["__take"] == end["__of"])))
    rest = out.withColumn("__more", F.coalesce(whole, F.lit(False)))
    split = plan.where((F.col("__end.__take") > 0) & (F.col("__end.__take") < F.col("__end.__of")))
    if not split.isEmpty():
        # equal rows of which only some are taken: numbered within their partition, whose numbers follow one another
        equal = checkpointed(rest.where(some).withColumns({"__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()}))
        per = equal.groupBy("__source", "__order", "__pid").agg(F.count("*").alias("__n"))
        earlier = Window.partitionBy("__source", "__order").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
        number = F.row_number().over(Window.partitionBy("__source", "__order", "__pid").orderBy("__mid")) + F.col("__before")
        equal = equal.join(per, ["__source", "__order", "__pid"]).withColumn("__more", number <= F.col("__end.__take"))
        rest = rest.where(~some).unionByName(equal.select(*rest.columns))
    taken = F.coalesce(F.transform("__full", lambda u: u["__shard"]), F.array().cast("array<int>"))
    taken = F.when(F.col("__more"), F.concat(taken, F.array(F.col("__last.__shard")))).otherwise(taken)
    rest = rest.withColumn("shards", taken).withColumn("copies", F.size("shards"))
    return rest.select(*kept, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def shuffled(mixed: DataFrame, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """One row per copy with its shard and its place in the shard's local order; each shard's ``PIECES`` pieces are a partition's
    sorted run each."""
    kept = [c for c in mixed.columns if c not in ("shards", "shard", "place", "copy")]
    rows = mixed.select(*[F.col(f"`{c}`") for c in kept], F.posexplode("shards").alias("copy", "shard"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), F.col("copy"), F.col(id_col)))
    return rows.repartition(F.col("shard"), F.pmod("place", F.lit(PIECES))).sortWithinPartitions("shard", F.pmod("place", F.lit(PIECES)), "place")


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy taken, shard by shard in the shards' local order; documents that the mix leaves out have none."""
    small_batches(spark)
    return shuffled(mix(docs)).select("doc_id", "text", "lang", "source", "n_chars")

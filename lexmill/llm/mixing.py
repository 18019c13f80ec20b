"""Problem 9: mixing sources to target shares of the total size, by a multivariate-hypergeometric splitting tree.

Each source is a stream of its documents, permuted anew in every repetition, cut where its quota is met, in blocks of equal size.
The tree deals the exact numbers of blocks to output shards: at each node the blocks of every source for the left half of the
shards are a multivariate-hypergeometric draw. Each shard then takes its own blocks of each source's permuted block order and
shuffles them. Places in a stream come from sums over hash ranges, so that a source that holds most documents needs no single task.
A shard walks down the tree by itself, every node being drawn from its own seed, so that no list of shards or blocks meets the driver.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators import ranks
from lexmill.session import durable

SHARD_TOKENS = 1 << 26  # size of an output shard; the identifiers of its uses are put in order by one task
BLOCKS_A_SHARD = 64


def walk(shard: int, shards: int, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the blocks of each source that a shard gets, in the source's permuted order."""
    lo, hi, counts, first, total = 0, shards, blocks.astype(np.int64), np.zeros(len(blocks), dtype=np.int64), int(blocks.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, total * mid // shards - total * lo // shards, method="marginals")
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, first = mid, counts - left, first + left
    return first, counts


def deal(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """[shards, sources]: how many blocks of each source each shard gets, sums exact and shard sizes equal up to one block."""
    return np.array([walk(i, shards, np.array(blocks), seed)[1] for i in range(shards)])


def permuted(at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places below ``n`` that a keyed permutation gives to places below ``n`` (a Feistel network; what falls beyond ``n`` goes round again)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, rest = at.astype(np.uint64), np.arange(len(at))
    while len(rest):
        x = out[rest]
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (b + np.uint64((seed * 4 + r + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[rest] = (a << np.uint64(half)) | b
        rest = rest[out[rest] >= n]
    return out.astype(np.int64)


def mix(sizes: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 1, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, report) from (doc_id, source, n_tokens) and (source, target_share, max_repeats).

    uses: (shard, seq, source, doc_id, repetition, n_tokens), a row for each use of a document; there are as many shards as the
    mixture has SHARD_TOKENS where ``shards`` isn't given. report: a row for each target source with quota, available, taken,
    taken_share and met; a source misses its target where all its uses are taken and yet less than target_share x ``size``, the total
    of all documents where it isn't given. Sources without documents or without a target take nothing; null sources have no target;
    a null share is none and null repeats are one; documents without tokens are left out; repeated rows are documents of their own.
    The targets are a parameter and are held by the driver; documents never are.
    """
    spark = sizes.sparkSession
    all_docs = durable(sizes.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")))
    if size is None:
        size = float(all_docs.agg(F.sum("n_tokens")).first()[0] or 0)
    docs = all_docs.filter("n_tokens > 0 AND source IS NOT NULL")
    wanted = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    plan = wanted.join(docs.groupBy("source").agg(F.sum("n_tokens").alias("available")), "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).orderBy("source").collect()
    quota = [min(p.target_share * size, float(p.available * p.max_repeats)) for p in plan]
    shards = shards or max(1, ceil(sum(quota) / SHARD_TOKENS))
    block = max(1.0, sum(quota) / (shards * BLOCKS_A_SHARD))
    n_blocks = np.array([int(np.ceil(q / block)) for q in quota], dtype=np.int64)
    names = [p.source for p in plan]

    def places(batches):
        for b in batches:
            for shard in b["id"]:
                first, count = walk(int(shard), shards, n_blocks, seed)
                at = [permuted(np.arange(f, f + c), int(n), seed * 1_000_003 + k) for k, (f, c, n) in enumerate(zip(first, count, n_blocks))]
                yield pd.DataFrame({"source": np.repeat(np.array(names, dtype=object), count), "block": np.concatenate(at) if at else np.zeros(0, dtype=np.int64), "shard": np.int32(shard)})

    place = spark.range(shards).mapInPandas(places, "source string, block long, shard int")
    quotas = spark.createDataFrame([(p.source, p.max_repeats, float(q), p.available) for p, q in zip(plan, quota)], "source string, max_repeats int, quota double, available long")
    uses = docs.join(quotas, "source").filter("quota > 0")
    uses = uses.withColumn("repetition", F.explode(F.expr("sequence(0, least(max_repeats - 1, int(floor(quota / available))))")))
    uses = durable(uses.withColumn("h", F.xxhash64(F.lit(seed), "source", "repetition", "doc_id")))
    bits = ranks.range_bits(uses.count())
    uses = uses.withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    ranges = uses.groupBy("source", "repetition", "range").agg(F.sum("n_tokens").alias("n"))
    ranges = ranks.totals_before(ranges, ["source", "repetition"], "range", "n", "before", 1 << bits).drop("n")
    inside = Window.partitionBy("source", "repetition", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    uses = uses.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ranges, ["source", "repetition", "range"])
    uses = uses.withColumn("at", F.col("repetition") * F.col("available") + F.col("before") + F.col("inside"))
    uses = uses.filter(F.col("at") + F.col("n_tokens") / 2 < F.col("quota")).withColumn("block", F.floor(F.col("at") / F.lit(block)).cast("long"))
    uses = uses.join(place, ["source", "block"])
    seq = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "h", "repetition"), "doc_id", "repetition"))
    uses = durable(uses.select("shard", seq.alias("seq"), "source", "doc_id", "repetition", "n_tokens"))
    taken = uses.groupBy("source").agg(F.sum("n_tokens").alias("taken"))
    total = uses.agg(F.sum("n_tokens")).first()[0]
    report = wanted.join(quotas.select("source", "quota", "available"), "source").join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    report = report.withColumn("taken_share", F.when(F.lit(bool(total)), F.col("taken") / F.lit(float(total or 1))))
    return uses, report.withColumn("met", (F.col("taken") < F.col("available") * F.col("max_repeats")) | (F.col("taken") >= F.col("target_share") * F.lit(size)))

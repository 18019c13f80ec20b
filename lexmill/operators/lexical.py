"""Lexical diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators import ranks
from lexmill.operators.select import hash_order

EPSILON = 0.1


def ngram_rows(df: DataFrame, keys: list[str], tokens: str, n: int) -> DataFrame:
    """(keys..., gram) of every n-gram, as hashes."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))))
    return df.select(*keys, tokens, F.explode(starts).alias("_at")).select(*keys, F.xxhash64(F.lit(n), F.slice(tokens, F.col("_at"), F.lit(n))).alias("gram"))


def lexical_summary(df: DataFrame, by: str, tokens: str) -> DataFrame:
    """n, tokens, vocabulary, mean words, type-token ratio and distinct-1/2 of each group; zeros where there is nothing."""
    base = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.size(tokens)).alias("tokens"))

    def per(n: int) -> DataFrame:
        grams = ngram_rows(df, [by], tokens, n).groupBy(by, "gram").agg(F.count("*").alias("c"))
        return grams.groupBy(by).agg(F.count("*").alias(f"u{n}"), F.sum("c").alias(f"t{n}"))

    rows = base.join(per(1), by, "left").join(per(2), by, "left").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(by, "n", "tokens", F.col("u1").alias("vocabulary"), ratio("tokens", "n").alias("mean_words"), ratio("u1", "t1").alias("ttr"), ratio("u2", "t2").alias("distinct_2"))


def self_bleu(df: DataFrame, by: str, ident: str, tokens: str, longest: int = 4) -> DataFrame:
    """(by, n, self_bleu): mean BLEU of each sentence against the others of its group; 0 where there are fewer than two.

    The largest count of a gram among the others is its largest count, or the second largest for the sentence that has the largest.
    """
    rows = df.select(by, ident, tokens).filter(F.size(tokens) > 0)
    sizes = rows.select(by, ident, F.size(tokens).alias("h"))
    precisions = []
    for n in range(1, longest + 1):
        c = ngram_rows(rows, [by, ident], tokens, n).groupBy(by, ident, "gram").agg(F.count("*").alias("c"))
        top = c.groupBy(by, "gram").agg(F.max(F.struct("c", ident)).alias("m"), F.max("c").alias("m1"), F.count("*").alias("k"))
        second = c.join(top, [by, "gram"]).filter(F.col(ident) != F.col(f"m.{ident}")).groupBy(by, "gram").agg(F.max("c").alias("m2"))
        both = c.join(top.filter("k > 1"), [by, "gram"], "left").join(second, [by, "gram"], "left")
        other = F.when(F.col(ident) == F.col(f"m.{ident}"), F.coalesce("m2", F.lit(0))).otherwise(F.coalesce("m1", F.lit(0)))
        p = both.groupBy(by, ident).agg(F.sum("c").alias("t"), F.sum(F.least("c", other)).alias("k"))
        precisions.append(p.select(by, ident, F.ln(F.when(F.col("k") > 0, F.col("k") / F.col("t")).otherwise(EPSILON / F.col("t"))).alias(f"p{n}")))
    out = sizes
    for p in precisions:
        out = out.join(p, [by, ident], "left")
    missing = F.ln(F.lit(EPSILON))
    mean = sum((F.coalesce(f"p{n}", missing) for n in range(1, longest + 1)), F.lit(0.0)) / longest
    lengths = sizes.groupBy(by, "h").agg(F.count("*").alias("k"))
    w = Window.partitionBy(by).orderBy("h")
    lengths = lengths.withColumn("lo", F.lag("h").over(w)).withColumn("hi", F.lead("h").over(w))
    closest = F.when(F.col("k") > 1, F.col("h")).when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(F.col("h") - F.col("lo") <= F.col("hi") - F.col("h"), F.col("lo")).otherwise(F.col("hi"))
    out = out.join(lengths.select(by, "h", closest.alias("r")), [by, "h"])
    bp = F.when(F.col("h") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    scored = out.select(by, F.when(F.col("r").isNotNull(), bp * F.exp(mean)).otherwise(0.0).alias("s"))
    return scored.groupBy(by).agg(F.count("*").alias("n"), F.avg("s").alias("self_bleu"))


def mtld_of(tokens: list[str], threshold: float = 0.72) -> float:
    """Mean length of the stretches over which the type-token ratio stays above the threshold, read both ways."""
    if len(tokens) < 2:
        return 0.0

    def one(seq) -> float:
        factors, types, count = 0.0, set(), 0
        for t in seq:
            count += 1
            types.add(t)
            if len(types) <= threshold * count:
                factors, types, count = factors + 1, set(), 0
        if count and len(types) < count:
            factors += (1 - len(types) / count) / (1 - threshold)
        return len(tokens) / factors if factors else float(len(tokens))

    return (one(tokens) + one(reversed(tokens))) / 2


def mtld(tokens: Column | str) -> Column:
    """Lexical diversity of each document's tokens: a fold over an ordered list, in Arrow batches."""

    @F.pandas_udf("double")
    def fold(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else mtld_of(list(x)))

    return fold(F.col(tokens) if isinstance(tokens, str) else tokens)


def length_matched(df: DataFrame, by: str, ident: str, tokens: str, size: int, seed: str) -> DataFrame:
    """(by, tokens, ttr, hapax) of the first ``size`` tokens of each group's texts in random order; the last text is cut."""
    n = F.size(tokens)
    rows = df.select(by, ident, tokens, hash_order(seed, by, F.col(ident).cast("string")).alias("_h"))
    placed = ranks.running(rows, [by], [F.col("_h"), F.col(ident)], {"_b": n})
    cut = placed.filter(F.col("_b") < size).select(by, F.explode(F.slice(tokens, F.lit(1), F.least(n, F.lit(size) - F.col("_b")).cast("int"))).alias("w"))
    c = cut.groupBy(by, "w").agg(F.count("*").alias("c"))
    return c.groupBy(by).agg(F.sum("c").alias("tokens"), (F.count("*") / F.sum("c")).alias("ttr"), (F.count_if(F.col("c") == 1) / F.count("*")).alias("hapax"))


def length_matched_mean(df: DataFrame, by: str, ident: str, tokens: str, size: int, seeds: int) -> DataFrame:
    """(by, tokens, samples, ttr, distinct_2, hapax): means over ``seeds`` samples of exactly ``size`` tokens; nulls for groups of fewer.

    Each sample is of whole texts in random order, the last one cut; bigrams are those inside texts. Only hash ranges that begin before
    ``size`` tokens are ranked, so that no task sees a whole group.
    """
    n = F.size(tokens)
    totals = df.groupBy(by).agg(F.sum(n).alias("tokens"))
    seed = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))
    rows = df.filter(n > 0).select(by, ident, tokens, seed.alias("_s")).withColumn("_h", F.sha2(F.concat_ws("|", F.col("_s").cast("string"), by, F.col(ident).cast("string")), 256)).withColumn("_r", F.substring("_h", 1, 3))
    sizes = rows.groupBy(by, "_s", "_r").agg(F.sum(n).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(by, "_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.withColumn("_start", start).filter(F.col("_start") < size).drop("_n")
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(by, "_s", "_r").orderBy("_h", ident).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(ranges, [by, "_s", "_r"]).withColumn("_b", F.col("_start") + inside).filter(F.col("_b") < size)
    cut = placed.select(by, "_s", F.slice(tokens, F.lit(1), F.least(n, F.lit(size) - F.col("_b")).cast("int")).alias("_w"))
    words = cut.select(by, "_s", F.explode("_w").alias("w")).groupBy(by, "_s", "w").agg(F.count("*").alias("c"))
    words = words.groupBy(by, "_s").agg(F.sum("c").alias("t"), F.count("*").alias("u"), F.count_if(F.col("c") == 1).alias("h")).filter(F.col("t") == size)
    pairs = ngram_rows(cut, [by, "_s"], "_w", 2).groupBy(by, "_s", "gram").agg(F.count("*").alias("c"))
    pairs = pairs.groupBy(by, "_s").agg((F.count("*") / F.sum("c")).alias("d"))
    each = words.join(pairs, [by, "_s"], "left")
    means = each.groupBy(by).agg(F.count("*").alias("samples"), F.avg(F.col("u") / F.col("t")).alias("ttr"), F.avg(F.coalesce("d", F.lit(0.0))).alias("distinct_2"), F.avg(F.col("h") / F.col("t")).alias("hapax"))
    return totals.join(means, by, "left").na.fill(0, ["samples"])

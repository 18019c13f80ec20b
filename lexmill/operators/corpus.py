"""Joining labels to texts and profiling the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import portable as P


def join_labels(labels: DataFrame, posts: DataFrame) -> DataFrame:
    """Label rows with the text of their post; of posts delivered again the last row counts. Text is null where no post is."""
    last = posts.groupBy(F.col("source").alias("nadi_source"), F.col("id").alias("train_id")).agg(F.max_by(F.struct("text", "country", "province"), "ord").alias("post"))
    return labels.join(last, ["nadi_source", "train_id"], "left").withColumn("text", F.col("post.text"))


def build_records(labels: DataFrame, posts: DataFrame, dialects: tuple[str, ...] = P.DIALECTS) -> DataFrame:
    """One record a text: its posts' countries, a majority vote for each dialect (ties are valid), conflicts and the mean score.

    Texts of posts are aggregated first and meet label votes on the text: two small sides, whatever the number of copies.
    """
    votes = join_labels(labels, posts).filter("text is not null")
    agg = [F.sum(F.coalesce(F.col(d), F.lit(0))).alias(d) for d in dialects]
    votes = votes.groupBy("text").agg(*agg, F.count("*").alias("n_label_rows"), F.round(F.avg("aldi_score"), 6).alias("aldi_score"))
    refs = posts.filter("text is not null").groupBy("text").agg(F.array_sort(F.collect_set("country")).alias("countries"), F.count("*").alias("n_posts"), F.min("ord").alias("ord"))
    n = F.col("n_label_rows")
    valid = F.map_from_arrays(F.array(*map(F.lit, dialects)), F.array(*[(2 * F.col(d) >= n).cast("int") for d in dialects]))
    conflict = F.exists(F.array(*[(F.col(d) > 0) & (F.col(d) < n) for d in dialects]), lambda x: x)
    rows = refs.join(votes, "text").select("ord", "text", "countries", "n_posts", valid.alias("labels"), "n_label_rows", conflict.alias("label_conflict"), "aldi_score")
    return rows.withColumn("cardinality", F.aggregate(F.map_values("labels"), F.lit(0), lambda a, x: a + x))


def summarize(values: Column) -> list[Column]:
    """mean, median, the 95 % order statistic at floor(0.95 (n - 1)), min and max, over a group."""
    s = F.sort_array(F.collect_list(values))
    at = F.floor(F.lit(0.95) * (F.size(s) - 1)).cast("int")
    return [F.round(F.avg(values), 2).alias("mean"), F.median(values).alias("median"), F.get(s, at).alias("p95"), F.min(values).alias("min"), F.max(values).alias("max")]


def summarize_by_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``summarize`` of whole numbers over large groups: counts of each value come first, and no group is ever collected."""
    from pyspark.sql.window import Window

    per = df.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    run = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("upto", run).withColumn("total", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    t = F.col("total")
    return per.groupBy(*by).agg(
        F.first("total").alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.first("total"), 2).alias("mean"),
        ((at(F.floor((t - 1) / 2)) + at(F.floor(t / 2))) / 2).alias("median"), at(F.floor(F.lit(0.95) * (t - 1))).alias("p95"), F.min("v").alias("min"), F.max("v").alias("max"),
    )


def shares(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by..., label, n, share) with the largest count of the group over its smallest."""
    from pyspark.sql.window import Window

    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("imbalance", F.max("n").over(w) / F.min("n").over(w))


def bag_union(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of all parts with their ``origin`` and its ``precedence``, the order in which parts are named; repeated rows stay, columns that a part lacks are null."""
    out = None
    for k, (name, df) in enumerate(parts.items()):
        rows = df.withColumns({"origin": F.lit(name), "precedence": F.lit(k)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out

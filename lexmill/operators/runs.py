"""Roll-ups of experiment logs (SC13, SC14, J13-J15, A25, A26, A59, T02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "folder string, seed int, config struct<model:string,dataset:string>, epochs array<struct<epoch:int,train_loss:double,dev_macro_f1:double>>, best_epoch int, dev struct<macro_f1:double,accuracy:double>, test struct<macro_f1:double,accuracy:double>"


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Logs of run folders, without limited trial runs; ``run`` is the folder without its seed."""
    logs = spark.read.schema(RUN).option("multiLine", True).json(pattern)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    logs = logs.withColumn("folder", folder).filter(~F.col("folder").rlike(r"_limit\d+$"))
    return logs.withColumn("run", F.regexp_replace("folder", r"_seed\d+$", ""))


def leaderboard(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds of each run with its name in the registry; runs it lacks come last."""
    s = runs.groupBy("run").agg(F.count("*").alias("n_seeds"), F.avg("dev.macro_f1").alias("dev"), F.coalesce(F.stddev_samp("dev.macro_f1"), F.lit(0.0)).alias("dev_std"), F.avg("test.macro_f1").alias("test"))
    named = s.join(registry.select("run", "name").distinct(), "run", "left").withColumn("name", F.coalesce("name", F.lit("unassigned")))
    return named.orderBy(F.col("name") == "unassigned", F.desc("dev"), "run")


def paired(runs: DataFrame, base: str, by: list[str], score: str) -> DataFrame:
    """(condition, by..., delta): the difference of each condition's score to that of ``base`` with the same keys."""
    b = runs.filter(F.col("condition") == base).select(*by, F.col(score).alias("_base"))
    return runs.filter(F.col("condition") != base).join(b, by).select("condition", *by, (F.col(score) - F.col("_base")).alias("delta"))


def aligned(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with the gold label of their row number, as identifiers repeat; a number without a row fails the query."""
    both = predictions.join(gold.select("row_no", F.col("gold").alias("_gold")), "row_no", "left")
    return both.filter(F.assert_true(F.col("_gold").isNotNull(), F.lit("a prediction without a gold row")).isNull()).withColumnRenamed("_gold", "gold_label")

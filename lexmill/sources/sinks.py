"""Writing results (SK01-SK08)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with nulls written out; an existing folder is never overwritten."""
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, cols: list[str]) -> None:
    """The named columns, missing values empty."""
    df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).write.mode("errorifexists").option("header", True).csv(path)


def write_decided(checked: DataFrame, path: str) -> None:
    """Kept and rejected records in one pass, in folders by status."""
    status = F.when(F.col("rejected_by").isNull(), "kept").otherwise("rejected")
    checked.withColumn("status", status).write.mode("errorifexists").partitionBy("status").parquet(path)


def append_missing(plan: DataFrame, path: str, key: str, make) -> int:
    """Rows of ``plan`` whose key the sink lacks go through ``make`` and are appended; gives how many were missing."""
    spark = plan.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    left = plan.join(spark.read.parquet(path).select(key), key, "left_anti") if done else plan
    n = left.count()
    if n:
        make(left).write.mode("append").parquet(path)
    return n


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report table; larger results are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def provenance(spark: SparkSession, inputs: list[str], params: dict) -> str:
    """JSON of parameters and the SHA-256 of each input file, on any file system; files are read by tasks, not by the driver."""
    sums = {}
    if inputs:
        files = spark.read.format("binaryFile").load(inputs).select("path", F.sha2("content", 256).alias("sum"))
        sums = {r.path: r.sum for r in files.collect()}
    return json.dumps({"params": params, "inputs": sums}, sort_keys=True)

"""Ranks and running totals of groups of any size, without a task that holds a whole group.

Rows are cut into ranges of their order; totals of ranges are few, and what comes before a row is what comes before its range and,
inside the range, before the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.session import durable

BLOCK = 4096  # places that one window holds
ROWS_A_RANGE = 100_000
MOST_BITS = 24


def range_bits(rows: int) -> int:
    """Leading bits of an evenly spread hash that cut ``rows`` rows into ranges of about ROWS_A_RANGE, at least eight ranges."""
    return max(3, min(MOST_BITS, (max(rows, 1) // ROWS_A_RANGE).bit_length() + 1))


def totals_before(df: DataFrame, by: list[str], at: str, value: str, name: str, places: int = BLOCK**3) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group whose whole number ``at`` is smaller; (by, at) is unique, ``at`` below ``places``.

    A window holds BLOCK places at most: more of them are summed by blocks, and blocks by blocks of blocks.
    """
    if places <= BLOCK:
        before = F.sum(value).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(name, F.coalesce(before, F.lit(0)))
    rows = df.withColumn("_block", F.floor(F.col(at) / BLOCK).cast("long"))
    blocks = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_n"))
    blocks = totals_before(blocks.withColumnRenamed("_block", "_at"), by, "_at", "_n", "_all", -(-places // BLOCK)).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_at").alias("_of"), F.col("_all").alias("_earlier"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_block") == F.col("_of"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(blocks, same).withColumn(name, F.col("_inside") + F.col("_earlier")).drop("_inside", "_earlier", "_block", "_of", *[f"_by_{c}" for c in by])


def ranked(df: DataFrame, by: list[str], spread: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place in its group, from 1, by ``spread`` and then ``order``; ``spread`` is a whole number of MOST_BITS bits, evenly spread.

    A group is cut by the leading bits of ``spread``, as many as its own share of rows asks for, so that no task ranks a whole one.
    """
    rows = df.withColumn("_spread", spread)
    bits = range_bits(df.count())
    rows = rows.withColumn("_range", F.shiftright("_spread", MOST_BITS - bits).cast("long"))
    ranges = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    ranges = totals_before(ranges, by, "_range", "_n", "_before", 1 << bits).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_range") == F.col("_of"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_spread", *order))
    return rows.withColumn("_inside", inside).join(ranges, same).withColumn(name, F.col("_inside") + F.col("_before")).drop("_spread", "_range", "_of", "_before", "_inside", *[f"_by_{c}" for c in by])


def running(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``values`` by its name, the sum over the rows of the group that come before, and with ``<name>_all``, that of the whole group.

    Rows are cut into parts of their order of nearly equal size and kept, so that a part is a task's work however large its group;
    sums of parts are a few numbers a group. Null groups are groups; ties come in the order that ``order`` ends with.
    """
    keys = [F.col(c) for c in by]
    parts = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    parts = durable(parts.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id().cast("long")))
    sums = parts.groupBy(*by, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    w = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values], *[F.sum(f"_s_{n}").over(w).alias(f"{n}_all") for n in values])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_of"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values}).join(sums, same)
    out = out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in values})
    return out.drop("_part", "_of", *[f"_by_{c}" for c in by], *[f"{x}_{n}" for n in values for x in ("_v", "_i", "_b")])


def hash_spread(hexed: Column) -> Column:
    """The first MOST_BITS bits of a hash in hexadecimal digits, as a whole number."""
    return F.conv(F.substring(hexed, 1, MOST_BITS // 4), 16, 10).cast("long")

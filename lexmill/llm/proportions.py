"""Problem 5: a sample whose categories follow target proportions, by divisor-method priorities.

Every record gets the priority (rank - 0.5) / target, its rank being its place in a random order of its category; records within a
category's floor come first, and the records of smallest priority are kept. As the records kept of a category are its first ones,
counts alone tell how many: the smallest priorities are found from the last rank of each category, and no order over all rows is
needed. The rank itself comes from counts of hash ranges, so that a category that holds most rows is ranked in many tasks.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators import ranks
from lexmill.session import durable


def seats(available: list[int], targets: list[float], floors: list[int], size: int) -> list[int]:
    """How many records of each category are among the ``size`` of smallest priority, floors first; ties go to the earlier category."""
    n = min(size, sum(available))
    low = [min(f, a) for f, a in zip(floors, available)]
    if sum(low) > n:
        available, low = low, [0] * len(low)
    share = lambda x: [min(a, max(f, floor(x * t + 0.5))) for a, t, f in zip(available, targets, low)]
    lo, hi = 0.0, 1.0
    while hi < 1e300 and sum(share(hi)) < n:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(share(mid)) <= n else (lo, mid)
    got = share(lo)
    while sum(got) < n:
        rest = [i for i, a in enumerate(available) if got[i] < a]
        i = min(rest, key=lambda i: ((got[i] + 0.5) / targets[i] if targets[i] > 0 else float("inf"), i))
        got[i] += 1
    return got


def proportional_sample(df: DataFrame, targets: DataFrame, by: list[str], ident: str, size: float | None = None, divide_by: float = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of ``df``.

    sample: (by..., ident, rank, priority, in_floor), one row a distinct identifier and category. report: a row for each row of
    ``targets`` (by..., target_share, min_rows) with available, taken, wanted and met, ``wanted`` being the larger of ``min_rows`` and
    target_share x size, unrounded; ``available`` is the last rank that the category's records reach, and a target is met where the
    record of rank ``wanted`` exists. ``size`` is the number of distinct identifiers over ``divide_by`` where it isn't given. Rows
    without an identifier aren't counted; rows whose category is null or not among the targets count for the size only; repeated rows
    count once; a category without rows takes nothing; a null share or floor is none; empty tables give an empty sample and a report
    of unmet targets. The targets are a parameter and are held by the driver; records never are.
    """
    rows = df.filter(F.col(ident).isNotNull())
    if size is None:
        size = rows.agg(F.count_distinct(ident)).first()[0] / divide_by
    want = targets.select(*by, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
    rows = rows.select(*by, F.col(ident).alias("id")).join(want.select(*by), by, "left_semi").distinct()
    rows = durable(rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit(str(seed)), *by, "id"), 256)))
    ranked = durable(ranks.ranked(rows, by, ranks.hash_spread(F.col("h")), [F.col("h"), F.col("id")]).drop("h"))
    cells = want.join(ranked.groupBy(*by).agg(F.max("rank").alias("available")), by, "left").select(*by, "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"))
    cells = cells.orderBy(*by).collect()
    taken = seats([c.available for c in cells], [c.target_share for c in cells], [c.min_rows for c in cells], floor(size)) if cells else []
    fields = [*[targets.schema[b] for b in by], *[T.StructField(n, t) for n, t in (("target_share", T.DoubleType()), ("min_rows", T.IntegerType()), ("available", T.LongType()), ("taken", T.LongType()))]]
    report = df.sparkSession.createDataFrame([(*c, n) for c, n in zip(map(tuple, cells), taken)], T.StructType(fields))
    kept = ranked.join(report, by).filter("rank <= taken")
    sample = kept.select(*by, F.col("id").alias(ident), "rank", ((F.col("rank") - 0.5) / F.col("target_share")).alias("priority"), (F.col("rank") <= F.col("min_rows")).alias("in_floor"))
    report = report.withColumn("wanted", F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.lit(float(size))))
    return sample, report.withColumn("met", F.col("available") >= F.col("wanted"))

"""Splitting, sampling and selecting.

Random order is the order of a SHA-256 of seed, group and identifier: the same everywhere, and independent between groups. Ranks of
large groups come from counts of ranges of their order, so that a group that holds most rows is ranked in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import ranks


def hash_order(seed: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256)


def ranked(df: DataFrame, by: list[str], order: Column, ident: str, rank: str = "rn") -> DataFrame:
    """``df`` with the place of each row in its group by ``order`` and ``ident``, and the group's size ``n_group``, in many tasks a group."""
    rows = ranks.running(df.withColumn("_order", order), by, [F.col("_order"), F.col(ident)], {rank: F.lit(1)})
    return rows.withColumn(rank, F.col(rank) + 1).withColumnRenamed(f"{rank}_all", "n_group").drop("_order")


def stratified_split(df: DataFrame, by: list[str], ident: str, fraction: float, seed: str) -> DataFrame:
    """``df`` with ``part``: of each stratum round(n x fraction) rows, half to even, are ``dev``."""
    rows = ranked(df, by, hash_order(seed, *by, F.col(ident).cast("string")), ident)
    return rows.withColumn("part", F.when(F.col("rn") <= F.bround(F.col("n_group") * F.lit(fraction)), "dev").otherwise("train")).drop("rn", "n_group")


def sample_cells(df: DataFrame, wants: DataFrame, by: list[str], ident: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows, shortfall): ``want`` rows of each cell of ``wants`` in random order, and what each cell lacks."""
    rows = ranked(df, by, hash_order(seed, *by, F.col(ident).cast("string")), ident).join(wants.select(*by, "want"), by).filter("rn <= want").drop("rn", "n_group", "want")
    have = df.groupBy(*by).agg(F.count("*").alias("have"))
    short = wants.join(have, by, "left").select(*by, "want", F.coalesce("have", F.lit(0)).alias("have")).withColumn("shortfall", F.greatest(F.lit(0), F.col("want") - F.col("have")))
    return rows, short


def cap_groups(df: DataFrame, by: list[str], ident: str, cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows a group, at random."""
    return ranked(df, by, hash_order(seed, *by, F.col(ident).cast("string")), ident).filter(F.col("rn") <= cap).drop("rn", "n_group")


def folds(df: DataFrame, ident: str, k: int, seed: str, group: str | None = None) -> DataFrame:
    """``df`` with ``fold``: the place in random order modulo k, of rows or of whole groups."""
    key = group or ident
    keys = df.select(key).distinct().withColumn("_all", F.lit(1))
    placed = ranked(keys, ["_all"], hash_order(seed, F.col(key).cast("string")), key).select(key, ((F.col("rn") - 1) % k).cast("int").alias("fold"))
    return df.join(placed, key)


def permuted_labels(df: DataFrame, by: list[str], ident: str, label: str, seed: str) -> DataFrame:
    """(by..., ident, shuffled): labels permuted inside each stratum."""
    a = ranked(df.select(*by, ident), by, F.col(ident), ident).select(*by, "rn", ident)
    b = ranked(df.select(*by, ident, label), by, hash_order(seed, *by, F.col(ident).cast("string")), ident).select(*by, "rn", F.col(label).alias("shuffled"))
    return a.join(b, [*by, "rn"]).select(*by, ident, "shuffled")


def interleaved(df: DataFrame, by: str, ident: str) -> DataFrame:
    """``df`` with ``at``: the greedy round-robin that always takes from the group that is least done, in closed form."""
    rows = ranked(df, [by], F.col(ident), ident)
    return rows.withColumn("at", (F.col("rn") - 1) / F.col("n_group")).drop("rn", "n_group")


def few_shots(requests: DataFrame, pool: DataFrame, by: list[str], k: int, seed: str) -> DataFrame:
    """(request, rank, pool_id): ``k`` examples of the request's cell for each request, from a place of its own on in the cell's random order.

    The pool is ranked once; a request meets the ``k`` ranks it takes and no others, however large its cell.
    """
    placed = ranked(pool.select(*by, "pool_id"), by, hash_order(seed, "pool_id"), "pool_id")
    cells = placed.groupBy(*by).agg(F.max("n_group").alias("n"))
    start = F.conv(F.substring(hash_order(seed, "request_id"), 1, 12), 16, 10).cast("long") % F.col("n")
    wants = requests.select("request_id", *by).distinct().join(cells, by).withColumn("rank", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int")))))
    wants = wants.withColumn("rn", (start + F.col("rank") - 1) % F.col("n") + 1)
    return wants.join(placed.select(*by, "rn", "pool_id"), [*by, "rn"]).select("request_id", "rank", "pool_id")


def role_pairs(df: DataFrame, pair: str, role: str, roles: tuple[str, str], confirmed: Column) -> DataFrame:
    """(pair, n, complete, confirmed): rows, whether there are exactly these two roles, and how many of the sides are confirmed by a row."""
    per = df.groupBy(pair, role).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(confirmed), F.lit(False)).alias("ok"))
    named = F.col(role).isNotNull()
    return per.groupBy(pair).agg(F.sum("n").alias("n"), (F.array_sort(F.collect_set(role)) == F.array(*map(F.lit, sorted(roles)))).alias("complete"), F.count_if(F.col("ok") & named).alias("confirmed"))


def equal_words(df: DataFrame, pair: str, role: str, roles: tuple[str, str], text: str, ident: str) -> DataFrame:
    """(pair, n_words) of the pairs whose two sides, each the first text of its role, have equal word lists; null texts are none."""
    first = df.filter(F.col(text).isNotNull() & F.col(role).isin(*roles)).groupBy(pair, role).agg(F.min_by(text, ident).alias("t"))
    side = lambda r, n: first.filter(F.col(role) == r).select(pair, X.tokenize("t").alias(n))
    return side(roles[0], "a").join(side(roles[1], "b"), pair).filter("a = b").select(pair, F.size("a").alias("n_words"))

"""Splits, samples and selections over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import select as S
from lexmill.plans.registry import Registry
from lexmill.sources.tables import table

r = Registry()


def _rank(by: str, seed: str, ident: str) -> str:
    parts = ", ".join([f"'{seed}'", *[f"{c}" for c in by.split(", ")], f"{ident}::VARCHAR"])
    return f"row_number() OVER (PARTITION BY {by} ORDER BY sha256(concat_ws('|', {parts})), {ident})"


@r.query(f"SELECT ord, CASE WHEN {_rank('dataset, label', 's1', 'ord')} <= round_even(count(*) OVER (PARTITION BY dataset, label) * 0.1::DOUBLE, 0) THEN 'dev' ELSE 'train' END AS part FROM quality_rows")
def select_w02_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_split(table(spark, sf, "quality_rows").select("ord", "dataset", "label"), ["dataset", "label"], "ord", 0.1, "s1").select("ord", "part")


@r.query(f"SELECT ord, variety, sentiment FROM (SELECT ord, variety, sentiment, {_rank('variety, sentiment', 's2', 'ord')} AS rn FROM requests) JOIN target_shares USING (variety, sentiment) WHERE rn <= min_rows")
def select_w03_cells(spark: SparkSession, sf: str) -> DataFrame:
    wants = table(spark, sf, "target_shares").select("variety", "sentiment", F.col("min_rows").alias("want"))
    return S.sample_cells(table(spark, sf, "requests").select("ord", "variety", "sentiment"), wants, ["variety", "sentiment"], "ord", "s2")[0].select("ord", "variety", "sentiment")


@r.query("SELECT variety, sentiment, min_rows AS want, coalesce(have, 0) AS have, greatest(0, min_rows - coalesce(have, 0)) AS shortfall FROM target_shares LEFT JOIN (SELECT variety, sentiment, count(*) AS have FROM requests GROUP BY ALL) USING (variety, sentiment)")
def select_w03_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    wants = table(spark, sf, "target_shares").select("variety", "sentiment", F.col("min_rows").alias("want"))
    return S.sample_cells(table(spark, sf, "requests").select("ord", "variety", "sentiment"), wants, ["variety", "sentiment"], "ord", "s2")[1]


@r.query("SELECT ord, generator, condition FROM (SELECT ord, generator, condition, row_number() OVER (PARTITION BY generator, condition ORDER BY parse_ok DESC, sha256(concat_ws('|', 's3', ord::VARCHAR))) AS rn FROM synthetic) WHERE rn <= 20")
def select_w04_best_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "synthetic").select("ord", "generator", "condition", "parse_ok")
    order = F.concat(F.when(F.col("parse_ok"), "0").otherwise("f"), S.hash_order("s3", F.col("ord").cast("string")))
    return S.ranked(rows, ["generator", "condition"], order, "ord").filter("rn <= 20").select("ord", "generator", "condition")


@r.query(f"SELECT ord, source FROM (SELECT ord, source, {_rank('source', 's4', 'ord')} AS rn FROM tweets) WHERE rn <= 100")
def select_w06_cap(spark: SparkSession, sf: str) -> DataFrame:
    return S.cap_groups(table(spark, sf, "tweets").select("ord", "source"), ["source"], "ord", 100, "s4").select("ord", "source")


@r.query("SELECT item_id, (row_number() OVER (ORDER BY sha256(concat_ws('|', 's5', item_id::VARCHAR)), item_id) - 1) % 5 AS fold FROM eval_items")
def select_w13_folds(spark: SparkSession, sf: str) -> DataFrame:
    return S.folds(table(spark, sf, "eval_items").select("item_id"), "item_id", 5, "s5").select("item_id", "fold")


@r.query("WITH f AS (SELECT train_id, (row_number() OVER (ORDER BY sha256(concat_ws('|', 's5', train_id)), train_id) - 1) % 5 AS fold FROM (SELECT DISTINCT train_id FROM label_rows WHERE train_id IS NOT NULL)) SELECT ord, fold FROM label_rows JOIN f USING (train_id)")
def select_w13_grouped_folds(spark: SparkSession, sf: str) -> DataFrame:
    return S.folds(table(spark, sf, "label_rows").select("ord", "train_id").filter("train_id is not null"), "ord", 5, "s5", "train_id").select("ord", "fold")


@r.query("WITH a AS (SELECT item_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY item_id) AS rn FROM eval_items), b AS (SELECT dataset, sentiment, row_number() OVER (PARTITION BY dataset ORDER BY sha256(concat_ws('|', 's6', dataset, item_id::VARCHAR)), item_id) AS rn FROM eval_items) SELECT item_id, dataset, sentiment AS shuffled FROM a JOIN b USING (dataset, rn)")
def select_w14_permutation(spark: SparkSession, sf: str) -> DataFrame:
    return S.permuted_labels(table(spark, sf, "eval_items"), ["dataset"], "item_id", "sentiment", "s6").select("item_id", "dataset", "shuffled")


@r.query("SELECT ord, variety, round((row_number() OVER (PARTITION BY variety ORDER BY ord) - 1) / count(*) OVER (PARTITION BY variety), 6) AS at FROM requests")
def select_w15_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return S.interleaved(table(spark, sf, "requests").select("ord", "variety"), "variety", "ord").select("ord", "variety", F.round("at", 6).alias("at"))


@r.query("""WITH q AS (SELECT DISTINCT request_id, variety, sentiment FROM requests), p AS (SELECT *, row_number() OVER (PARTITION BY variety, sentiment ORDER BY sha256('s7|' || pool_id), pool_id) AS rn, count(*) OVER (PARTITION BY variety, sentiment) AS n FROM fewshot_pool),
c AS (SELECT DISTINCT variety, sentiment, n FROM p), w AS (SELECT request_id, variety, sentiment, n, unnest(range(1, least(3, n) + 1)) AS rank, list_sum(list_transform(range(1, 13), lambda i: (strpos('0123456789abcdef', substr(sha256('s7|' || request_id), i, 1)) - 1) * (16::BIGINT ** (12 - i))::BIGINT))::BIGINT AS h FROM q JOIN c USING (variety, sentiment))
SELECT request_id, rank::INT AS rank, pool_id FROM w JOIN p ON p.variety = w.variety AND p.sentiment = w.sentiment AND p.rn = (h % w.n + rank - 1) % w.n + 1""")
def select_j16_few_shots(spark: SparkSession, sf: str) -> DataFrame:
    return S.few_shots(table(spark, sf, "requests"), table(spark, sf, "fewshot_pool"), ["variety", "sentiment"], 3, "s7")


@r.query("WITH n AS (SELECT dataset, label, count(*) AS n FROM quality_rows WHERE label IS NOT NULL GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY dataset) AS t FROM n), q AS (SELECT *, floor(60 * n / t)::BIGINT AS need FROM w) SELECT dataset, label, CASE WHEN k = 1 THEN 60 - (sum(need) OVER (PARTITION BY dataset) - need) ELSE need END::BIGINT AS need FROM q")
def select_w05_composition(spark: SparkSession, sf: str) -> DataFrame:
    """What each label must give to 60 rows of a dataset so that shares stay; the largest label takes the rest."""
    from pyspark.sql.window import Window

    n = table(spark, sf, "quality_rows").filter("label is not null").groupBy("dataset", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dataset")
    q = n.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "label"))).withColumn("need", F.floor(60 * F.col("n") / F.sum("n").over(w)))
    return q.select("dataset", "label", F.when(F.col("k") == 1, 60 - (F.sum("need").over(w) - F.col("need"))).otherwise(F.col("need")).alias("need"))


@r.query("SELECT round(max(n) / greatest(1, min(n)), 6) AS imbalance, count_if(n = 0) AS n_empty FROM (SELECT variety, sentiment, coalesce(n, 0) AS n FROM target_shares LEFT JOIN (SELECT variety, sentiment, count(*) AS n FROM requests GROUP BY ALL) USING (variety, sentiment))")
def select_a38_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "requests").groupBy("variety", "sentiment").agg(F.count("*").alias("n"))
    cells = table(spark, sf, "target_shares").join(n, ["variety", "sentiment"], "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return cells.agg(F.round(F.max("n") / F.greatest(F.lit(1), F.min("n")), 6).alias("imbalance"), F.count_if(F.col("n") == 0).alias("n_empty"))


@r.query("SELECT variety, sentiment, unnest(range(ceil(target_share * 1000 * 1.2::DOUBLE)::BIGINT)) AS no FROM target_shares")
def select_m22_plan(spark: SparkSession, sf: str) -> DataFrame:
    n = F.ceil(F.col("target_share") * 1000 * 1.2).cast("long")
    return table(spark, sf, "target_shares").select("variety", "sentiment", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("no"))


@r.query("SELECT stage, count(*) AS n FROM (SELECT unnest(CASE WHEN aldi_score >= 0.77 THEN [1, 2, 3, 4] WHEN aldi_score >= 0.44 THEN [2, 3, 4] WHEN aldi_score >= 0.11 THEN [3, 4] ELSE [4] END) AS stage FROM label_rows WHERE aldi_score IS NOT NULL) GROUP BY stage")
def select_m12_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("aldi_score")
    first = F.when(s >= 0.77, 1).when(s >= 0.44, 2).when(s >= 0.11, 3).otherwise(4)
    return table(spark, sf, "label_rows").filter("aldi_score is not null").select(F.explode(F.sequence(first, F.lit(4))).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@r.query("SELECT r.ord FROM requests r WHERE NOT EXISTS (SELECT 1 FROM synthetic s WHERE s.request_id = r.request_id)")
def select_sk05_resume(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "requests").join(table(spark, sf, "synthetic").select("request_id"), "request_id", "left_anti").select("ord")

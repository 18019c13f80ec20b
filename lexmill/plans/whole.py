"""Further operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import portable as P
from lexmill.functions import text as X
from lexmill.operators import corpus, dedup, metrics, semantic
from lexmill.operators import select as S
from lexmill.plans.dedup import KEY, near_sql
from lexmill.plans.registry import Registry
from lexmill.plans.text import _CLEAN, _tok
from lexmill.sources.tables import table

r = Registry()

_PAIRED = "WITH p AS (SELECT " + ", ".join(f"a.{d} AS {d}_g, b.{d} AS {d}_p" for d in P.DIALECTS) + " FROM label_rows a JOIN label_rows b ON b.ord = a.ord + 1), c AS (" + " UNION ALL ".join(
    f"SELECT coalesce(sum({d}_g * {d}_p), 0) AS tp, coalesce(sum({d}_g), 0) AS g, coalesce(sum({d}_p), 0) AS p FROM p" for d in P.DIALECTS) + ")"


@r.query(_PAIRED + """, s AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS re, CASE WHEN g + p > 0 THEN 2 * tp / (g + p) ELSE 0 END AS f FROM c)
SELECT round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(tp) / sum(p), 6) AS micro_precision, round(sum(tp) / sum(g), 6) AS micro_recall, round(2 * sum(tp) / (sum(g) + sum(p)), 6) AS micro_f1 FROM s""")
def measure_a21_averages(spark: SparkSession, sf: str) -> DataFrame:
    """The labels of each row against those of the next one, as gold and predicted labels."""
    rows = table(spark, sf, "label_rows").select("ord", *P.DIALECTS)
    both = rows.alias("a").join(rows.withColumn("ord", F.col("ord") - 1).alias("b"), "ord")
    out = metrics.multilabel_averages(metrics.multilabel_scores(both, {d: F.col(f"a.{d}") for d in P.DIALECTS}, {d: F.col(f"b.{d}") for d in P.DIALECTS}))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@r.query("""WITH e AS (SELECT event_type, value, user_id % 2 = 0 AS pos FROM events WHERE value IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rk FROM e),
a AS (SELECT event_type, count_if(pos) AS p, count_if(NOT pos) AS n, sum(CASE WHEN pos THEN rk END) AS s FROM k GROUP BY event_type), v AS (SELECT p + n AS w, (s - p * (p + 1) / 2) / (p * n) AS auc FROM a WHERE p > 0 AND n > 0)
SELECT count(*) AS n_strata, sum(w)::BIGINT AS n, round(sum(w * auc) / sum(w), 6) AS auc FROM v""")
def measure_a45_stratified_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stratified_auc(table(spark, sf, "events").filter("value is not null"), "value", F.col("user_id") % 2 == 0, "event_type").withColumn("auc", F.round("auc", 6))


@r.query(f"""WITH t AS (SELECT ord, {_CLEAN} AS text, dataset, split, label, label2 FROM quality_rows WHERE text IS NOT NULL AND label IS NOT NULL AND label2 IS NOT NULL),
k AS (SELECT *, unnest(list_concat(['all'], CASE WHEN contains(text, 'URL') THEN ['link'] ELSE [] END, CASE WHEN len({_tok('text')}) <= 10 THEN ['short'] ELSE [] END, CASE WHEN contains(text, '#') THEN ['hashtag'] ELSE [] END)) AS kind FROM t),
c AS (SELECT kind, label, dataset, split, avg((label <> label2)::INT) AS e FROM k GROUP BY ALL), d AS (SELECT kind, label, dataset, avg(e) AS e FROM c GROUP BY ALL) SELECT kind, label AS gold, count(*) AS n_conditions, round(avg(e), 6) AS error FROM d GROUP BY kind, label""")
def report_a31_errors_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Error rates of kinds of text and gold labels: means of cells, then of conditions. The second label stands for a prediction, the dataset for a condition, the split for a cell."""
    q = table(spark, sf, "quality_rows").filter("text is not null and label is not null and label2 is not null").select(X.clean_text("text")[0].alias("text"), "dataset", "split", "label", "label2")
    t = F.col("text")
    kinds = F.filter(F.array(F.lit("all"), F.when(t.contains("URL"), "link"), F.when(F.size(X.tokenize("text")) <= 10, "short"), F.when(t.contains("#"), "hashtag")), lambda x: x.isNotNull())
    out = metrics.mean_of_means(q.withColumn("kind", F.explode(kinds)), ["kind", "label"], ["dataset", "split"], (F.col("label") != F.col("label2")).cast("int"))
    return out.select("kind", F.col("label").alias("gold"), F.col("n").alias("n_conditions"), F.round("mean", 6).alias("error"))


@r.query("SELECT request_id, count(*) AS n, list_sort(list(DISTINCT condition)) = ['fewshot', 'open'] AS complete, count(DISTINCT CASE WHEN parse_ok THEN condition END) AS confirmed FROM synthetic GROUP BY request_id")
def select_a36_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Which requests have both roles, here the conditions, and how many of their sides are confirmed."""
    return S.role_pairs(table(spark, sf, "synthetic"), "request_id", "condition", ("fewshot", "open"), F.col("parse_ok"))


@r.query(f"""WITH f AS (SELECT request_id, condition, text FROM (SELECT *, row_number() OVER (PARTITION BY request_id, condition ORDER BY ord) AS k FROM synthetic WHERE text IS NOT NULL) WHERE k = 1)
SELECT a.request_id, len({_tok('a.text')}) AS n_words FROM f a JOIN f b ON a.request_id = b.request_id AND a.condition = 'fewshot' AND b.condition = 'open' WHERE {_tok('a.text')} = {_tok('b.text')}""")
def select_a37_equal_words(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose two sides have equal word lists, a side being the first text of its role."""
    return S.equal_words(table(spark, sf, "synthetic"), "request_id", "condition", ("fewshot", "open"), "text", "ord")


@r.query("WITH " + near_sql("quality_rows", "ord") + f""", ag AS (WITH sh2 AS (SELECT item_id, list_distinct(list_transform(range(1, length(key) - 3), lambda j: substr(key, j, 5))) AS s FROM (SELECT item_id, {KEY} AS key FROM eval_items)),
q AS (SELECT DISTINCT key, list_distinct(list_transform(range(1, length(key) - 3), lambda j: substr(key, j, 5))) AS s FROM (SELECT {KEY} AS key FROM quality_rows WHERE text IS NOT NULL)), a AS (SELECT key, unnest(s) AS g FROM q), b AS (SELECT item_id, unnest(s) AS g FROM sh2),
o AS (SELECT key, item_id, count(*) AS o FROM a JOIN b USING (g) GROUP BY ALL) SELECT DISTINCT o.key FROM o JOIN q USING (key) JOIN sh2 USING (item_id) WHERE o / (len(q.s) + len(sh2.s) - o) >= 0.8)
SELECT dataset, count(*) AS n, round(count_if(exact) / count(*), 6) AS exact_rate, round(count_if(near.ord IS NOT NULL) / count(*), 6) AS near_rate, round(count_if(key IN (SELECT key FROM ag)) / count(*), 6) AS reference_rate
FROM (SELECT dataset, ord, {KEY} AS key, min(ord) OVER (PARTITION BY {KEY}) < ord AS exact FROM quality_rows WHERE {KEY} <> '') d LEFT JOIN near USING (ord) GROUP BY dataset""")
def dedup_n07_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Of each dataset, the shares of exact and near repeats within the table and of near copies of evaluation items."""
    q = table(spark, sf, "quality_rows").select("ord", "dataset", "text").filter(X.dedup_key("text") != "")
    near = dedup.near_duplicates_within(q, "text", "ord").select("ord", F.lit(True).alias("near"))
    against = dedup.near_duplicates_against(q, table(spark, sf, "eval_items"), "text", "ord", "text", "item_id").select("ord", F.lit(True).alias("against"))
    rows = dedup.exact_duplicates(q, X.dedup_key("text"), "ord").join(near, "ord", "left").join(against, "ord", "left")
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), rate(F.col("duplicate_of").isNotNull()).alias("exact_rate"), rate(F.col("near").isNotNull()).alias("near_rate"), rate(F.col("against").isNotNull()).alias("reference_rate"))


@r.query("SELECT 'real' AS origin, 0 AS precedence, ord, text, label AS target FROM quality_rows WHERE split = 'train' UNION ALL SELECT 'synthetic', 1, ord, text, target_dialect FROM synthetic")
def corpus_s04_bag_union(spark: SparkSession, sf: str) -> DataFrame:
    real = table(spark, sf, "quality_rows").filter("split = 'train'").select("ord", "text", F.col("label").alias("target"))
    return corpus.bag_union({"real": real, "synthetic": table(spark, sf, "synthetic").select("ord", "text", F.col("target_dialect").alias("target"))})


_NEED = "WITH n AS (SELECT dataset, label, count(*) AS n FROM quality_rows WHERE label IS NOT NULL GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY dataset) AS t FROM n), q AS (SELECT *, floor(60 * n / t)::BIGINT AS need FROM w), x AS (SELECT dataset, label, CASE WHEN k = 1 THEN 60 - (sum(need) OVER (PARTITION BY dataset) - need) ELSE need END::BIGINT AS need FROM q)"


@r.query(_NEED + ", o AS (SELECT ord, dataset, label, row_number() OVER (PARTITION BY dataset, label ORDER BY sha256(concat_ws('|', 's8', dataset, label, ord::VARCHAR)), ord) AS rn FROM quality_rows WHERE label IS NOT NULL) SELECT ord, dataset, label FROM o JOIN x USING (dataset, label) WHERE rn <= need")
def select_w05_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty rows a dataset in the proportions of its labels; what a label lacks isn't made up for."""
    from lexmill.plans.select import select_w05_composition

    rows = table(spark, sf, "quality_rows").filter("label is not null").select("ord", "dataset", "label")
    return S.sample_cells(rows, select_w05_composition(spark, sf).withColumnRenamed("need", "want"), ["dataset", "label"], "ord", "s8")[0]


_DIRECTION = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
l AS (SELECT vec_id, label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM u WHERE label IN (0, 1)),
m AS (SELECT d, avg(CASE WHEN label = 1 THEN x END) - avg(CASE WHEN label = 0 THEN x END) AS a, avg(CASE WHEN label = 1 AND vec_id % 3 <> 0 THEN x END) - avg(CASE WHEN label = 0 AND vec_id % 3 <> 0 THEN x END) AS b FROM l GROUP BY d),
g AS (SELECT list(a ORDER BY d) AS a, list(b ORDER BY d) AS b FROM m)"""


@r.query("WITH " + _DIRECTION + ", p AS (SELECT vec_id, list_dot_product(v, a) / sqrt(list_dot_product(a, a)) AS x FROM u, g) SELECT vec_id, round(x, 6) AS projection, 'top' AS side FROM (SELECT *, row_number() OVER (ORDER BY x DESC, vec_id) AS k FROM p) WHERE k <= 10 UNION ALL SELECT vec_id, round(x, 6), 'bottom' FROM (SELECT *, row_number() OVER (ORDER BY x, vec_id) AS k FROM p) WHERE k <= 10")
def vectors_t05_direction_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the feature: the ten vectors at each end of the direction from label 0 to label 1."""
    rows = table(spark, sf, "embeddings")
    return semantic.direction_ends(rows, semantic.direction(rows, F.col("label") == 1, F.col("label") == 0), 10).withColumn("projection", F.round("projection", 6))


@r.query("WITH " + _DIRECTION + " SELECT round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS cosine, round(sqrt(list_dot_product(a, a)), 6) AS length_all, round(sqrt(list_dot_product(b, b)), 6) AS length_without FROM g")
def vectors_m19_without_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The direction from label 0 to label 1 over all rows against that without a third of them: how far it hangs on these."""
    rows = table(spark, sf, "embeddings")
    one, zero, rest = F.col("label") == 1, F.col("label") == 0, F.col("vec_id") % 3 != 0
    return semantic.link_check(semantic.direction(rows, one, zero), semantic.direction(rows.filter(rest), one, zero)).select(*[F.round(c, 6).alias(c) for c in ("cosine", "length_all", "length_without")])

"""Lexical, classification and distribution measures over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import portable as P
from lexmill.functions import text as X
from lexmill.operators import lexical, metrics
from lexmill.plans.registry import Registry
from lexmill.plans.text import _tok
from lexmill.sources.tables import table

r = Registry()


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@r.query(f"""WITH t AS (SELECT dataset, {_tok('text')} AS w FROM quality_rows WHERE text IS NOT NULL), a AS (SELECT dataset, count(*) AS n, sum(len(w))::BIGINT AS tokens FROM t GROUP BY dataset), u AS (SELECT dataset, count(DISTINCT x) AS u1 FROM (SELECT dataset, unnest(w) AS x FROM t) GROUP BY dataset),
b AS (SELECT dataset, count(DISTINCT x) AS u2, count(*) AS t2 FROM (SELECT dataset, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1])) AS x FROM t) GROUP BY dataset)
SELECT dataset, n, tokens, u1 AS vocabulary, round(tokens / n, 6) AS mean_words, round(u1 / tokens, 6) AS ttr, round(u2 / t2, 6) AS distinct_2 FROM a JOIN u USING (dataset) JOIN b USING (dataset)""")
def measure_a15_lexical(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").filter("text is not null").select("dataset", X.tokenize("text").alias("w"))
    return _rounded(lexical.lexical_summary(rows, "dataset", "w"), "mean_words", "ttr", "distinct_2")


_BLEU = """WITH t AS (SELECT dataset, item_id, {tok} AS w FROM eval_items WHERE text IS NOT NULL), g AS (SELECT dataset, item_id, n, array_to_string(w[i:i + n - 1], chr(1)) AS g FROM (SELECT dataset, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (VALUES (1), (2), (3), (4)) v(n))),
c AS (SELECT dataset, item_id, n, g, count(*) AS c FROM g GROUP BY ALL), o AS (SELECT *, max(c) OVER (PARTITION BY dataset, n, g ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m1, max(c) OVER (PARTITION BY dataset, n, g ORDER BY item_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m2 FROM c),
p AS (SELECT dataset, item_id, n, sum(c) AS t, sum(least(c, greatest(coalesce(m1, 0), coalesce(m2, 0)))) AS k FROM o GROUP BY ALL), s AS (SELECT dataset, item_id, len(w) AS h FROM t WHERE len(w) > 0),
l AS (SELECT s.dataset, s.item_id, s.h, sum(coalesce(ln(CASE WHEN k > 0 THEN k / t ELSE 0.1 / t END), ln(0.1))) / 4 AS lp FROM s CROSS JOIN (VALUES (1), (2), (3), (4)) v(n) LEFT JOIN p ON p.dataset = s.dataset AND p.item_id = s.item_id AND p.n = v.n GROUP BY ALL),
r AS (SELECT a.dataset, a.item_id, arg_min(b.h, abs(b.h - a.h) * 100000 + b.h) AS r FROM s a JOIN s b ON a.dataset = b.dataset AND a.item_id <> b.item_id GROUP BY ALL)
SELECT dataset, count(*) AS n, round(avg(CASE WHEN h > r THEN 1.0 ELSE exp(1 - r / h) END * exp(lp)), 6) AS self_bleu FROM l JOIN r USING (dataset, item_id) GROUP BY dataset"""


@r.query(_BLEU.replace("{tok}", _tok("text")))
def measure_m09_self_bleu(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "eval_items").filter("text is not null").select("dataset", "item_id", X.tokenize("text").alias("w"))
    return _rounded(lexical.self_bleu(rows, "dataset", "item_id", "w"), "self_bleu")


@r.query()
def measure_w08_mtld(spark: SparkSession, sf: str) -> DataFrame:
    """A sequential fold, checked against a literal version on fixtures."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.round(lexical.mtld(X.tokenize("text")), 6).alias("mtld"))


@r.query(f"""WITH t AS (SELECT dataset, ord, {_tok('text')} AS w, sha256(concat_ws('|', 's8', dataset, ord::VARCHAR)) AS h FROM quality_rows WHERE text IS NOT NULL), b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY dataset ORDER BY h, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM t),
x AS (SELECT dataset, unnest(w[1:least(len(w), 1000 - b)]) AS w FROM b WHERE b < 1000), c AS (SELECT dataset, w, count(*) AS c FROM x GROUP BY ALL) SELECT dataset, sum(c)::BIGINT AS tokens, round(count(*) / sum(c), 6) AS ttr, round(count_if(c = 1) / count(*), 6) AS hapax FROM c GROUP BY dataset""")
def measure_w16_length_matched(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").filter("text is not null").select("dataset", "ord", X.tokenize("text").alias("w"))
    return _rounded(lexical.length_matched(rows, "dataset", "ord", "w", 1000, "s8"), "ttr", "hapax")


@r.query(f"""WITH t AS (SELECT dataset, ord, {_tok('text')} AS w FROM quality_rows WHERE text IS NOT NULL), n AS (SELECT dataset, sum(len(w))::BIGINT AS tokens FROM t GROUP BY dataset), b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY s, dataset ORDER BY sha256(concat_ws('|', s::VARCHAR, dataset, ord::VARCHAR)), ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM t, (SELECT unnest(range(30)) AS s) WHERE len(w) > 0),
x AS (SELECT dataset, s, w[1:least(len(w), 5000 - b)] AS w FROM b WHERE b < 5000), c AS (SELECT dataset, s, w, count(*) AS c FROM (SELECT dataset, s, unnest(w) AS w FROM x) GROUP BY ALL), u AS (SELECT dataset, s, sum(c) AS t, count(*) AS u, count_if(c = 1) AS h FROM c GROUP BY ALL HAVING sum(c) = 5000),
p AS (SELECT dataset, s, w[i] || chr(1) || w[i + 1] AS g FROM (SELECT dataset, s, w, unnest(range(1, len(w))) AS i FROM x)), d AS (SELECT dataset, s, count(DISTINCT g) / count(*) AS d FROM p GROUP BY ALL), m AS (SELECT dataset, count(*) AS samples, avg(u / t) AS ttr, avg(coalesce(d, 0)) AS distinct_2, avg(h / t) AS hapax FROM u LEFT JOIN d USING (dataset, s) GROUP BY dataset)
SELECT dataset, tokens, coalesce(samples, 0) AS samples, round(ttr, 6) AS ttr, round(distinct_2, 6) AS distinct_2, round(hapax, 6) AS hapax FROM n LEFT JOIN m USING (dataset)""")
def measure_w16_mean_of_30(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").filter("text is not null").select("dataset", "ord", X.tokenize("text").alias("w"))
    return _rounded(lexical.length_matched_mean(rows, "dataset", "ord", "w", 5000, 30), "ttr", "distinct_2", "hapax")


_PRED = "(SELECT q.generator, q.sentiment AS gold, q.controls.sentiment AS pred FROM synthetic q)"


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    """Two labellings of one set: the label of a row as gold, that of the row five numbers on as prediction."""
    s = table(spark, sf, "synthetic").select("ord", "generator", "sentiment")
    return s.select("ord", "generator", F.col("sentiment").alias("gold")).join(s.select((F.col("ord") - 5).alias("ord"), F.col("sentiment").alias("pred")), "ord")


_PAIRS = "pr AS (SELECT a.generator, a.sentiment AS gold, b.sentiment AS pred FROM synthetic a JOIN synthetic b ON b.ord = a.ord + 5 WHERE a.sentiment IS NOT NULL AND b.sentiment IS NOT NULL)"
_CLS = f"WITH {_PAIRS}, cl AS (SELECT DISTINCT generator, c FROM (SELECT generator, gold AS c FROM pr UNION ALL SELECT generator, pred FROM pr)), s AS (SELECT cl.generator, cl.c, count_if(gold = c) AS support, count_if(pred = c) AS predicted, count_if(gold = c AND pred = c) AS tp FROM cl JOIN pr USING (generator) GROUP BY ALL), f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM s)"


@r.query(_CLS + " SELECT generator, c AS class, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def measure_a22_class_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.class_scores(_pred(spark, sf), "gold", "pred", ["generator"]), "precision", "recall", "f1").drop("tp")


@r.query(_CLS + " SELECT generator, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(CASE WHEN support > 0 THEN f1 END), 6) AS macro_f1_gold, round(sum(CASE WHEN c IN ('POS', 'NEG') THEN f1 ELSE 0 END) / 2, 6) AS f1_pn FROM f GROUP BY generator")
def measure_a23_overall_scores(spark: SparkSession, sf: str) -> DataFrame:
    per = metrics.class_scores(_pred(spark, sf), "gold", "pred", ["generator"])
    return _rounded(metrics.overall_scores(per, ["generator"]), "accuracy", "macro_f1", "macro_f1_gold", "f1_pn")


@r.query(f"WITH {_PAIRS}, n AS (SELECT generator, count(*) AS n, count_if(gold = pred) / count(*) AS po FROM pr GROUP BY generator), e AS (SELECT generator, sum(a.n * b.n) AS e FROM (SELECT generator, gold AS c, count(*) AS n FROM pr GROUP BY ALL) a JOIN (SELECT generator, pred AS c, count(*) AS n FROM pr GROUP BY ALL) b USING (generator, c) GROUP BY generator) SELECT generator, n, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n JOIN e USING (generator)")
def measure_a24_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.cohens_kappa(_pred(spark, sf), "gold", "pred", ["generator"]), "kappa")


@r.query("WITH p AS (SELECT " + ", ".join(f"a.{d} AS {d}_g, b.{d} AS {d}_p" for d in P.DIALECTS) + " FROM label_rows a JOIN label_rows b ON b.ord = a.ord + 1) " + " UNION ALL ".join(f"SELECT '{d}' AS label, round(CASE WHEN sum({d}_p) > 0 THEN sum({d}_g * {d}_p) / sum({d}_p) ELSE 0 END, 6) AS precision, round(CASE WHEN sum({d}_g) > 0 THEN sum({d}_g * {d}_p) / sum({d}_g) ELSE 0 END, 6) AS recall, round(count_if({d}_g = {d}_p) / count({d}_g + {d}_p), 6) AS accuracy FROM p" for d in P.DIALECTS))
def measure_a21_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "label_rows").select("ord", *P.DIALECTS)
    both = rows.alias("a").join(rows.withColumn("ord", F.col("ord") - 1).alias("b"), "ord")
    out = metrics.multilabel_scores(both, {d: F.col(f"a.{d}") for d in P.DIALECTS}, {d: F.col(f"b.{d}") for d in P.DIALECTS})
    return _rounded(out, "precision", "recall", "accuracy").select("label", "precision", "recall", "accuracy")


@r.query("""WITH e AS (SELECT event_type, value, user_id % 2 = 0 AS pos FROM events WHERE value IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rk FROM e)
SELECT event_type, count_if(pos) AS n_pos, count_if(NOT pos) AS n_neg, round((sum(CASE WHEN pos THEN rk END) - count_if(pos) * (count_if(pos) + 1) / 2) / (count_if(pos) * count_if(NOT pos)), 6) AS auc FROM k GROUP BY event_type""")
def measure_a45_auc(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("value is not null")
    return _rounded(metrics.auc(e, "value", F.col("user_id") % 2 == 0, ["event_type"]), "auc")


@r.query("""WITH l AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b FROM lineitem), k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM l) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k""")
def measure_a44_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"))
    return _rounded(metrics.spearman(rows, "a", "b"), "pearson", "spearman")


@r.query("WITH n AS (SELECT dataset, label, count(*) AS n FROM quality_rows WHERE label IS NOT NULL GROUP BY ALL), p AS (SELECT dataset, n / sum(n) OVER (PARTITION BY dataset) AS p FROM n) SELECT dataset, count(*) AS n_labels, round(exp(-sum(p * ln(p))), 6) AS effective FROM p GROUP BY dataset")
def measure_a48_effective_number(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.effective_number(table(spark, sf, "quality_rows"), ["dataset"], "label"), "effective")


@r.query("""WITH a AS (SELECT label, count(*) AS x FROM quality_rows WHERE split = 'train' AND label IS NOT NULL GROUP BY label), b AS (SELECT label, count(*) AS y FROM quality_rows WHERE split = 'test' AND label IS NOT NULL GROUP BY label), s AS (SELECT coalesce(x, 0) / sum(x) OVER () AS p, coalesce(y, 0) / sum(y) OVER () AS q FROM a FULL JOIN b USING (label))
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM s""")
def measure_a49_js_divergence(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "quality_rows")
    return _rounded(metrics.js_divergence(q.filter("split = 'train'"), q.filter("split = 'test'"), "label"), "js")


@r.query("WITH s AS (SELECT avg(value) FILTER (user_id % 2 = 0) AS m1, avg(value) FILTER (user_id % 2 = 1) AS m0, var_samp(value) FILTER (user_id % 2 = 0) AS v1, var_samp(value) FILTER (user_id % 2 = 1) AS v0, count(value) FILTER (user_id % 2 = 0) AS n1, count(value) FILTER (user_id % 2 = 1) AS n0 FROM events) SELECT n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM s")
def measure_a43_cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.cohens_d(table(spark, sf, "events").filter("value is not null"), "value", F.col("user_id") % 2 == 0), "d")


@r.query("""WITH w AS (SELECT event_type, user_id AS u, avg(value) AS m FROM events GROUP BY ALL), c AS (SELECT a.event_type AS a, b.event_type AS b, count_if(a.m > b.m) AS wins, count_if(a.m < b.m) AS losses FROM w a JOIN w b ON a.u = b.u AND a.event_type < b.event_type GROUP BY ALL)
SELECT a, b, wins, losses, round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses)::BIGINT + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))), 6) AS p FROM c""")
def measure_a33_sign_test(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "events").groupBy("event_type", F.col("user_id").alias("u")).agg(F.avg("value").alias("m"))
    c = w.toDF("a", "u", "ma").join(w.toDF("b", "u", "mb"), "u").filter("a < b").groupBy("a", "b").agg(F.count_if(F.col("ma") > F.col("mb")).alias("wins"), F.count_if(F.col("ma") < F.col("mb")).alias("losses"))
    return c.withColumn("p", F.round(metrics.sign_test(F.col("wins"), F.col("losses")), 6))


@r.query("""WITH n AS (SELECT round(aldi_score, 2) AS t, count_if(egypt = 1) AS p, count_if(egypt = 0) AS q FROM label_rows WHERE aldi_score IS NOT NULL AND egypt IS NOT NULL GROUP BY t), s AS (SELECT t, (sum(p) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(p) OVER () + coalesce(sum(q) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(q) OVER ()) / 2 AS acc FROM n)
SELECT min(t) AS threshold, round(any_value(acc), 6) AS balanced_accuracy FROM s WHERE acc >= (SELECT max(acc) - 1e-12 FROM s)""")
def measure_a39_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "label_rows").filter("aldi_score is not null and egypt is not null").select(F.round("aldi_score", 2).alias("t"), "egypt")
    return _rounded(metrics.best_threshold(rows, "t", F.col("egypt") == 1), "balanced_accuracy")


@r.query("WITH e AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, count(*) AS n, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std, array_to_string(list(printf('%d:%.2f', seed, m) ORDER BY seed), ' ') AS seeds FROM e GROUP BY event_type")
def measure_a25_over_seeds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("m"))
    seeds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", "m"))), lambda x: F.format_string("%d:%.2f", x["seed"], x["m"])), " ")
    return _rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std"), seeds.alias("seeds")), "mean", "std")


@r.query("WITH c AS (SELECT generator, condition, avg(new_tokens) AS m FROM synthetic GROUP BY ALL) SELECT coalesce(generator, '(all)') AS generator, coalesce(condition, '(all)') AS condition, round(avg(m), 6) AS mean, count(*) AS cells FROM c GROUP BY CUBE (generator, condition)")
def measure_a27_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Subtotals are means of cell means, not pooled means."""
    c = table(spark, sf, "synthetic").groupBy("generator", "condition").agg(F.avg("new_tokens").alias("m"))
    out = c.cube("generator", "condition").agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("cells"))
    return out.select(F.coalesce("generator", F.lit("(all)")).alias("generator"), F.coalesce("condition", F.lit("(all)")).alias("condition"), "mean", "cells")


@r.query("WITH e AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS n, arg_max(event_type, n * 1e12 - f) AS most, max(n) * 2 > sum(n) AS majority FROM e GROUP BY user_id")
def measure_a28_most_common(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent value of a group; ties go to the one that came first."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return e.groupBy("user_id").agg(F.sum("n").alias("n"), F.max_by("event_type", F.struct("n", -F.col("f"))).alias("most"), (F.max("n") * 2 > F.sum("n")).alias("majority"))


@r.query("WITH k AS (SELECT event_type, value, user_id % 2 = 0 AS rel, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn, sum((user_id % 2 = 0)::INT) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS c FROM events WHERE value IS NOT NULL) SELECT event_type, round(sum(CASE WHEN rel THEN c / rn END) / count_if(rel), 6) AS ap FROM k GROUP BY event_type")
def measure_a46_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.average_precision(table(spark, sf, "events"), "value", F.col("user_id") % 2 == 0, "event_id", "event_type"), "ap")


@r.query("WITH e AS (SELECT event_type, user_id % 10 AS epoch, avg(value) AS m FROM events GROUP BY ALL), b AS (SELECT *, max(m) OVER (PARTITION BY event_type) AS best FROM e) SELECT event_type, min(epoch) AS epoch FROM b WHERE m >= best - 0.25 GROUP BY event_type")
def measure_a35_pick_epoch(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("epoch")).agg(F.avg("value").alias("m"))
    return e.withColumn("best", F.max("m").over(Window.partitionBy("event_type"))).filter("m >= best - 0.25").groupBy("event_type").agg(F.min("epoch").alias("epoch"))

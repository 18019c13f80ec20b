"""Further operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import portable as P
from lexmill.functions import text as X
from lexmill.operators import codemix, numeric, semantic
from lexmill.plans.registry import Registry
from lexmill.plans.text import _n, _sub, _tok, topic_sql
from lexmill.plans.vectors import _SUM, _U
from lexmill.sources.tables import table

r = Registry()
_K = " + ".join(f"coalesce({d}, 0)" for d in P.DIALECTS)


@r.query(f"SELECT CASE WHEN k = 18 THEN 'all' WHEN k = 0 THEN 'none' ELSE 'some' END AS grp, count(*) AS n, count_if(aldi_score >= 0.5) AS high, count_if(aldi_score IS NULL) AS unscored FROM (SELECT {_K} AS k, aldi_score FROM label_rows) GROUP BY grp")
def more_a07_group_profile(spark: SparkSession, sf: str) -> DataFrame:
    k = sum((F.coalesce(F.col(d), F.lit(0)) for d in P.DIALECTS), F.lit(0))
    return table(spark, sf, "label_rows").groupBy(F.when(k == 18, "all").when(k == 0, "none").otherwise("some").alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("aldi_score") >= 0.5).alias("high"), F.count_if(F.col("aldi_score").isNull()).alias("unscored"))


@r.query("SELECT dialect, count(v) AS n, sum(v)::BIGINT AS positive, round(avg(v), 6) AS rate FROM (UNPIVOT (SELECT " + ", ".join(P.DIALECTS) + " FROM label_rows) ON COLUMNS(*) INTO NAME dialect VALUE v) GROUP BY dialect")
def more_a08_wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "label_rows").select(*P.DIALECTS).unpivot([], list(P.DIALECTS), "dialect", "v").filter("v is not null")
    return rows.groupBy("dialect").agg(F.count("v").alias("n"), F.sum("v").alias("positive"), F.round(F.avg("v"), 6).alias("rate"))


@r.query("SELECT coalesce(target_dialect, '(all)') AS target, n, round(hit / n, 6) AS agreement FROM (SELECT target_dialect, count(*) AS n, count_if(controls.variety = target_dialect) AS hit FROM synthetic WHERE target_dialect IS NOT NULL GROUP BY ROLLUP (target_dialect))")
def more_a20_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "synthetic").filter("target_dialect is not null").rollup("target_dialect").agg(F.count("*").alias("n"), F.count_if(F.col("controls.variety") == F.col("target_dialect")).alias("hit"))
    return rows.select(F.coalesce("target_dialect", F.lit("(all)")).alias("target"), "n", F.round(F.col("hit") / F.col("n"), 6).alias("agreement"))


@r.query("WITH s AS (SELECT ord, unnest(list_concat([dataset], CASE WHEN n_label_rows >= 3 THEN ['well labelled'] ELSE [] END, CASE WHEN cardinality > 1 THEN ['several'] ELSE [] END)) AS slice, label = label2 AS ok FROM quality_rows WHERE label IS NOT NULL AND label2 IS NOT NULL) SELECT slice, count(*) AS n, count_if(NOT ok) AS wrong FROM s GROUP BY slice")
def more_a41_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping slices by explode: a row counts in each of its own."""
    q = table(spark, sf, "quality_rows").filter("label is not null and label2 is not null")
    slices = F.filter(F.array(F.col("dataset"), F.when(F.col("n_label_rows") >= 3, "well labelled"), F.when(F.col("cardinality") > 1, "several")), lambda x: x.isNotNull())
    return q.select(F.explode(slices).alias("slice"), (F.col("label") == F.col("label2")).alias("ok")).groupBy("slice").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("wrong"))


@r.query(f"WITH {_U}, {_SUM}, n AS (SELECT u.vec_id, arg_max(cc.label, round(list_dot_product(v, c), 12)) AS cl FROM u, cc GROUP BY u.vec_id), k AS (SELECT cl, count(*) AS c FROM n GROUP BY cl) SELECT count_if(c >= 0.01 * (SELECT count(*) FROM n)) AS n_clusters, max(c) AS largest FROM k")
def more_a50_topic_count(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    k = semantic.nearest_centre(v, semantic.centroids(v, "label"), "vec_id", "label").groupBy("label").agg(F.count("*").alias("c"))
    k = k.withColumn("total", F.sum("c").over(Window.partitionBy()))
    return k.agg(F.count_if(F.col("c") >= 0.01 * F.col("total")).alias("n_clusters"), F.max("c").alias("largest"))


@r.query("SELECT dataset, count(*) AS n, count_if(map_extract(labels, label)[1] = 1) AS top_in_gold, count_if(labels IS NULL OR label IS NULL) AS unscorable FROM quality_rows GROUP BY dataset")
def more_a55_top_in_gold(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "quality_rows")
    return q.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.try_element_at("labels", "label") == 1).alias("top_in_gold"), F.count_if(F.col("labels").isNull() | F.col("label").isNull()).alias("unscorable"))


@r.query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events WHERE json_valid(props) AND len(json_keys(props)) > 0")
def more_a56_flatten_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.filter(F.size("m") > 0).select("event_id", F.map_values("m")[0].alias("first_value"), F.size("m").alias("n_keys"))


@r.query(f"SELECT dataset, count(*) AS n, count_if(regexp_matches(text, '{P.DISLIKE}')) AS dislike, round(avg((contains(text, '#'))::INT), 6) AS hashtag_share FROM quality_rows WHERE text IS NOT NULL GROUP BY dataset")
def more_a61_mention_share(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "quality_rows").filter("text is not null")
    return q.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(P.DISLIKE)).alias("dislike"), F.round(F.avg(F.col("text").contains("#").cast("int")), 6).alias("hashtag_share"))


@r.query(f"WITH t AS (SELECT ord, len({_tok('text')}) AS w FROM tweets WHERE text IS NOT NULL), s AS (SELECT seed, w, row_number() OVER (PARTITION BY seed ORDER BY sha256(concat_ws('|', seed::VARCHAR, ord::VARCHAR)), ord) AS rn FROM t, (SELECT unnest(range(20)) AS seed)), m AS (SELECT seed, avg(w) AS m FROM s WHERE rn <= 200 GROUP BY seed) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM m")
def more_a62_reference_samples(spark: SparkSession, sf: str) -> DataFrame:
    """A measure over twenty random samples of one size."""
    from lexmill.operators import select as S

    t = table(spark, sf, "tweets").filter("text is not null").select("ord", F.size(X.tokenize("text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("seed"))
    s = S.ranked(t, ["seed"], F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("ord").cast("string")), 256), "ord").filter("rn <= 200")
    return s.groupBy("seed").agg(F.avg("w").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"))


@r.query(f"SELECT ord, list_sum(map_values(labels)) AS k, len({_tok('text')}) AS words FROM quality_rows WHERE labels IS NOT NULL AND list_sum(map_values(labels)) <= 3 AND len({_tok('text')}) BETWEEN 5 AND 25 AND NOT regexp_matches(mtext, '\\b(?:USER|URL)\\b') AND split = 'train'")
def more_f19_eligible(spark: SparkSession, sf: str) -> DataFrame:
    k = F.aggregate(F.map_values("labels"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    rows = table(spark, sf, "quality_rows").filter("labels is not null and split = 'train'").select("ord", k.alias("k"), F.size(X.tokenize("text")).alias("words"), "mtext")
    return rows.filter((F.col("k") <= 3) & F.col("words").between(5, 25) & ~F.col("mtext").rlike(r"\b(?:USER|URL)\b")).select("ord", "k", "words")


@r.query()
def more_f17_latin_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Word lists from the tables: words of English and of Arabizi posts, each with five uses or more."""
    t = table(spark, sf, "tweets").filter("text is not null")
    words = t.filter("lang in ('en', 'ar-latn')").select("lang", F.explode(X.connective_words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).filter("n >= 5")
    return codemix.tag_latin(t, "ord", "text", words.filter("lang = 'en'"), words.filter("lang = 'ar-latn'")).groupBy("tag").agg(F.count("*").alias("n"))


@r.query("WITH h AS (SELECT DISTINCT text FROM quality_rows WHERE split <> 'train' AND text IS NOT NULL) SELECT dataset, count(*) AS n FROM quality_rows q WHERE split = 'train' AND text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.text = q.text) GROUP BY dataset")
def more_j05_train_only(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "quality_rows").filter("text is not null").select("dataset", "split", "text")
    return q.filter("split = 'train'").join(q.filter("split <> 'train'").select("text").distinct(), "text", "left_anti").groupBy("dataset").agg(F.count("*").alias("n"))


@r.query("SELECT r.ord, f.pool_id, f.text IS NOT DISTINCT FROM r.few_shot_texts[k] AS same FROM (SELECT ord, few_shot_ids, few_shot_texts, unnest(range(1, len(few_shot_ids) + 1)) AS k FROM requests) r JOIN fewshot_pool f ON f.pool_id = r.few_shot_ids[k]")
def more_j11_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """Texts meet the pool by the identifier at their position."""
    q = table(spark, sf, "requests").select("ord", F.posexplode("few_shot_ids").alias("k", "pool_id"), "few_shot_texts")
    pool = table(spark, sf, "fewshot_pool").select("pool_id", F.col("text").alias("t"))
    return q.join(pool, "pool_id").select("ord", "pool_id", F.col("t").eqNullSafe(F.get("few_shot_texts", F.col("k"))).alias("same"))


@r.query("SELECT split_part(request_id, ':', 1) AS set, split_part(request_id, ':', 2) AS variety, count(*) AS n, count_if(split_part(request_id, ':', 4)::BIGINT % 2 = 0) AS even FROM requests GROUP BY ALL")
def more_j10_derived_key(spark: SparkSession, sf: str) -> DataFrame:
    p = F.split("request_id", ":")
    q = table(spark, sf, "requests").select(p[0].alias("set"), p[1].alias("variety"), (p[3].cast("long") % 2 == 0).alias("e"))
    return q.groupBy("set", "variety").agg(F.count("*").alias("n"), F.count_if("e").alias("even"))


@r.query("WITH l AS (SELECT source, id, arg_max(country, ord) AS country, max(ord) AS ord FROM tweets GROUP BY source, id) SELECT country, count(*) AS n, max(ord) AS last FROM l GROUP BY country")
def more_j14_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "tweets").groupBy("source", "id").agg(F.max_by("country", "ord").alias("country"), F.max("ord").alias("ord"))
    return last.groupBy("country").agg(F.count("*").alias("n"), F.max("ord").alias("last"))


@r.query(f"WITH {_U}, p AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS s, round(list_dot_product(a.v, b.v), 3) AS t FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT q, list(id ORDER BY s DESC, id)[1:5] AS x, list(id ORDER BY t DESC, id)[1:5] AS y FROM p GROUP BY q) SELECT count(*) AS n, count_if(x = y) AS same_order, count_if(list_sort(x) = list_sort(y)) AS same_set FROM k")
def more_j21_two_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of the same neighbours, by the full and by a coarse score, compared in order and as sets."""
    v = table(spark, sf, "embeddings")
    full = semantic.nearest(v, v.filter("vec_id % 20 = 0"), "vec_id", 60)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 3)), "id"))
    both = full.withColumn("r2", rank)
    lists = both.groupBy("query").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= 5, F.struct(F.col(c).alias("r"), "id")))), lambda x: x["id"]).alias(n) for c, n in (("rank", "x"), ("r2", "y"))])
    return lists.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same_order"), F.count_if(F.array_sort("x") == F.array_sort("y")).alias("same_set"))


@r.query(f"WITH t AS (SELECT ord, {topic_sql('text')} AS c FROM quality_rows WHERE text IS NOT NULL) SELECT min(ord) AS ord, c AS topic_text FROM t WHERE len(str_split(c, ' ')) >= 5 GROUP BY c")
def more_n10_topic_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of each cleaned text; texts of under five words never count as seen."""
    c = X.clean_for_topics("text")
    rows = table(spark, sf, "quality_rows").filter("text is not null").select("ord", c.alias("topic_text")).filter(F.size(F.split("topic_text", " ")) >= 5)
    return rows.groupBy("topic_text").agg(F.min("ord").alias("ord")).select("ord", "topic_text")


@r.query("SELECT (SELECT count(*) FROM (SELECT request_id FROM requests EXCEPT SELECT request_id FROM synthetic)) AS only_a, (SELECT count(*) FROM (SELECT request_id FROM synthetic EXCEPT SELECT request_id FROM requests)) AS only_b")
def more_s05_equal_sets(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "requests").select("request_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = a.unionAll(table(spark, sf, "synthetic").select("request_id", F.lit(0), F.lit(1))).groupBy("request_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


@r.query("WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, d, avg((x > 0)::INT) AS f FROM l GROUP BY ALL), g AS (SELECT label, d, f, f - (sum(f) OVER (PARTITION BY d) - f) / (count(*) OVER (PARTITION BY d) - 1) AS gap FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(gap, 9) DESC, d) AS rn FROM g) SELECT label, d, round(f, 6) AS rate, round(gap, 6) AS gap, rn FROM k WHERE rn <= 5")
def more_m17_firing_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions that fire more for a class than for the others on average; the top five are the report."""
    return numeric.firing_gaps(table(spark, sf, "embeddings"), "label", 5).select("label", "d", F.round("rate", 6).alias("rate"), F.round("gap", 6).alias("gap"), "rn")


@r.query("WITH l AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, d, avg((x > 0)::INT) AS f FROM l GROUP BY ALL), p AS (SELECT d, f / sum(f) OVER (PARTITION BY d) AS p FROM m), e AS (SELECT d, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS e FROM p GROUP BY d), k AS (SELECT *, row_number() OVER (ORDER BY round(e, 9), d) AS rn FROM e) SELECT d, round(e, 6) AS entropy, rn FROM k WHERE rn <= 10")
def more_m16_selective_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return numeric.selective_dimensions(table(spark, sf, "embeddings"), "label", 10).select("d", F.round("entropy", 6).alias("entropy"), "rn")


@r.query()
def more_m11_tfidf_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out accuracy of a term-weight classifier of sentiment."""
    return numeric.tfidf_accuracy(table(spark, sf, "eval_items").filter("text is not null and sentiment is not null"), "item_id", "text", "sentiment")


@r.query()
def more_m15_pca_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out accuracy of a linear probe over principal components."""
    return numeric.pca_probe(table(spark, sf, "embeddings"), "vec_id", "label", 8)


@r.query()
def more_m18_direction_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of a class's directions in two halves of its rows."""
    return numeric.split_half(table(spark, sf, "embeddings"), "vec_id", "label")

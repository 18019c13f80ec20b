"""Building and profiling the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import portable as P
from lexmill.functions import text as X
from lexmill.operators import corpus
from lexmill.plans.registry import Registry
from lexmill.plans.text import _BUCKET, _n, _sub, _tok
from lexmill.sources.tables import table

r = Registry()
_LAST = "last AS (SELECT source, id, arg_max(coalesce(text, chr(1)), ord) AS t, arg_max(ord, ord) AS o FROM tweets GROUP BY source, id), lastt AS (SELECT source, id, nullif(t, chr(1)) AS text FROM last)"
_VOTES = f"""{_LAST}, v AS (SELECT text, count(*) AS n, round(avg(aldi_score), 6) AS aldi_score, {', '.join(f'sum(coalesce({d}, 0)) AS {d}' for d in P.DIALECTS)} FROM label_rows l JOIN lastt ON nadi_source = source AND train_id = lastt.id WHERE text IS NOT NULL GROUP BY text),
refs AS (SELECT text, list_sort(list_distinct(list(country))) AS countries, count(*) AS n_posts, min(ord) AS ord FROM tweets WHERE text IS NOT NULL GROUP BY text),
rec AS (SELECT ord, text, array_to_string(countries, ',') AS countries, n_posts, n AS n_label_rows, aldi_score, {' OR '.join(f'({d} > 0 AND {d} < n)' for d in P.DIALECTS)} AS label_conflict, {' + '.join(f'(2 * {d} >= n)::INT' for d in P.DIALECTS)} AS cardinality, [{', '.join(f"CASE WHEN 2 * {d} >= n THEN '{d}' END" for d in P.DIALECTS)}] AS valid FROM refs JOIN v USING (text))"""


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweets").select("ord", "source", "id", "text", "country", "province")


@r.query(f"WITH {_LAST} SELECT count(*) AS n, count_if(text IS NULL) AS n_unmatched, count(DISTINCT train_id) AS n_ids FROM label_rows LEFT JOIN lastt ON nadi_source = source AND train_id = lastt.id")
def corpus_j01_label_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.join_labels(table(spark, sf, "label_rows").select("nadi_source", "train_id"), _posts(spark, sf))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("n_unmatched"), F.count_distinct("train_id").alias("n_ids"))


@r.query(f"WITH {_VOTES} SELECT ord, countries, n_posts, n_label_rows, aldi_score, label_conflict, cardinality, array_to_string(list_filter(valid, lambda x: x IS NOT NULL), ',') AS valid FROM rec")
def corpus_a01_records(spark: SparkSession, sf: str) -> DataFrame:
    rec = corpus.build_records(table(spark, sf, "label_rows").drop("ord", "id"), _posts(spark, sf))
    valid = F.array_join(F.map_keys(F.map_filter("labels", lambda k, v: v == 1)), ",")
    return rec.select("ord", F.array_join("countries", ",").alias("countries"), "n_posts", "n_label_rows", "aldi_score", "label_conflict", "cardinality", valid.alias("valid"))


@r.query("SELECT count(*) AS n FROM (SELECT DISTINCT source, id FROM tweets) t WHERE NOT EXISTS (SELECT 1 FROM label_rows WHERE nadi_source = t.source AND train_id = t.id)")
def corpus_j03_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "label_rows").select(F.col("nadi_source").alias("source"), F.col("train_id").alias("id"))
    return table(spark, sf, "tweets").select("source", "id").distinct().join(keys, ["source", "id"], "left_anti").agg(F.count("*").alias("n"))


@r.query("WITH g AS (SELECT nadi_source, train_id, count(*) AS copies FROM label_rows GROUP BY ALL) SELECT copies, count(*) AS n_keys, count(DISTINCT nadi_source) AS n_sources FROM g GROUP BY copies")
def corpus_a02_copies(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "label_rows").groupBy("nadi_source", "train_id").agg(F.count("*").alias("copies"))
    return g.groupBy("copies").agg(F.count("*").alias("n_keys"), F.count_distinct("nadi_source").alias("n_sources"))


def _summary_sql(v: str) -> str:
    return f"count(*) AS n, round(avg({v}), 2) AS mean, median({v}) AS median, list_sort(list({v}))[(floor(0.95::DOUBLE * (count(*) - 1)) + 1)::BIGINT] AS p95, min({v}) AS min, max({v}) AS max"


@r.query(f"SELECT source, {_summary_sql('length(text)')} FROM tweets WHERE text IS NOT NULL GROUP BY source")
def corpus_a03_chars(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "tweets").filter("text is not null").select("source", F.length("text").alias("n_chars"))
    return corpus.summarize_by_counts(rows, ["source"], "n_chars")


@r.query(f"SELECT source, count_if(regexp_matches(text, '{P.ANY_URL}')) AS with_url, count_if(regexp_matches(text, '{P.ANY_MENTION}')) AS with_mention, count_if(contains(text, '#')) AS with_hashtag, count_if(regexp_matches(text, '{P.EMOJI}')) AS with_emoji, count_if(len({_tok('text')}) <= 3) AS le_3_words FROM tweets WHERE text IS NOT NULL GROUP BY source")
def corpus_a04_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    flags = X.text_flags("text")
    return table(spark, sf, "tweets").filter("text is not null").groupBy("source").agg(*[F.count_if(flags[k]).alias(k) for k in ("with_url", "with_mention", "with_hashtag", "with_emoji", "le_3_words")])


@r.query("""WITH p AS (SELECT country, count(DISTINCT province) AS provinces, count(*) AS n FROM tweets GROUP BY country), t AS (SELECT count(DISTINCT text) AS d, count(text) AS n FROM tweets), m AS (SELECT count(*) AS several FROM (SELECT text FROM tweets WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT country) > 1))
SELECT country, provinces, p.n AS n_rows, t.n - t.d AS duplicates, several, round(max(p.n) OVER () / min(p.n) OVER (), 2) AS imbalance FROM p, t, m""")
def corpus_a05_places(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, sf, "tweets").select("country", "province", "text")
    p = rows.groupBy("country", "province").agg(F.count("*").alias("n")).groupBy("country").agg(F.count("province").alias("provinces"), F.sum("n").alias("n_rows"))
    per_text = rows.filter("text is not null").groupBy("text").agg(F.count("*").alias("n"), F.min("country").alias("lo"), F.max("country").alias("hi"))
    t = per_text.agg((F.sum("n") - F.count("*")).alias("duplicates"), F.count_if(F.col("lo") != F.col("hi")).alias("several"))
    w = Window.partitionBy()
    return p.join(F.broadcast(t)).select("country", "provinces", "n_rows", "duplicates", "several", F.round(F.max("n_rows").over(w) / F.min("n_rows").over(w), 2).alias("imbalance"))


@r.query(f"WITH {_VOTES}, b AS (SELECT {_BUCKET.replace('k ', 'cardinality ')} AS bucket, aldi_score FROM rec) SELECT bucket, count(*) AS n, round(avg(aldi_score), 6) AS mean_aldi FROM b GROUP BY bucket")
def corpus_a06_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rec = corpus.build_records(table(spark, sf, "label_rows").drop("ord", "id"), _posts(spark, sf))
    return rec.groupBy(X.cardinality_bucket("cardinality").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("aldi_score"), 6).alias("mean_aldi"))


@r.query(f"WITH {_VOTES}, p AS (SELECT array_to_string(list_filter(valid, lambda x: x IS NOT NULL), '+') AS pair FROM rec WHERE cardinality = 2) SELECT pair, count(*) AS n FROM p GROUP BY pair ORDER BY n DESC, pair LIMIT 15")
def corpus_a06_top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the report: the fifteen most frequent pairs."""
    rec = corpus.build_records(table(spark, sf, "label_rows").drop("ord", "id"), _posts(spark, sf)).filter("cardinality = 2")
    pair = F.array_join(F.map_keys(F.map_filter("labels", lambda k, v: v == 1)), "+")
    return rec.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(15)


@r.query("SELECT coalesce(split, '(all)') AS split, coalesce(source, '(all)') AS source, count(*) AS n FROM tweets GROUP BY GROUPING SETS ((split, source), (split), ())")
def corpus_a10_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweets").rollup("split", "source").agg(F.count("*").alias("n")).select(F.coalesce("split", F.lit("(all)")).alias("split"), F.coalesce("source", F.lit("(all)")).alias("source"), "n")


@r.query("WITH n AS (SELECT dataset, coalesce(label, '(none)') AS label, count(*) AS n FROM quality_rows GROUP BY ALL) SELECT dataset, label, n, round(n / sum(n) OVER (PARTITION BY dataset), 6) AS share, round(max(n) OVER (PARTITION BY dataset) / min(n) OVER (PARTITION BY dataset), 6) AS imbalance FROM n")
def corpus_a11_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").select("dataset", F.coalesce("label", F.lit("(none)")).alias("label"))
    return corpus.shares(rows, ["dataset"], "label").withColumn("share", F.round("share", 6)).withColumn("imbalance", F.round("imbalance", 6))


@r.query("WITH n AS (SELECT dataset, label, label2, count(*) AS n FROM quality_rows WHERE label IS NOT NULL AND label2 IS NOT NULL GROUP BY ALL) SELECT coalesce(dataset, '(all)') AS dataset, round(sum(m) / sum(t), 6) AS majority_share FROM (SELECT dataset, label, max(n) AS m, sum(n) AS t FROM n GROUP BY dataset, label) GROUP BY ROLLUP (dataset)")
def corpus_a13_consistency(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "quality_rows").filter("label is not null and label2 is not null").groupBy("dataset", "label", "label2").agg(F.count("*").alias("n"))
    m = n.groupBy("dataset", "label").agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return m.rollup("dataset").agg(F.round(F.sum("m") / F.sum("t"), 6).alias("majority_share")).withColumn("dataset", F.coalesce("dataset", F.lit("(all)")))


@r.query("SELECT dataset, coalesce(label, '(whole)') AS subset, count(*) AS n FROM quality_rows WHERE text IS NOT NULL GROUP BY GROUPING SETS ((dataset), (dataset, label)) HAVING count(*) >= 10 AND (GROUPING(label) = 1 OR label IS NOT NULL)")
def corpus_a14_subsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").filter("text is not null").select("dataset", "label")
    per = rows.groupBy("dataset", "label").agg(F.count("*").alias("n"))
    whole = per.groupBy("dataset").agg(F.sum("n").alias("n")).select("dataset", F.lit("(whole)").alias("subset"), "n")
    return whole.unionByName(per.filter("label is not null").select("dataset", F.col("label").alias("subset"), "n")).filter("n >= 10")


@r.query("SELECT least(floor(aldi_score * 10)::INT, 9) AS bin, count(*) AS n FROM label_rows WHERE aldi_score IS NOT NULL GROUP BY bin")
def corpus_a18_aldi_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "label_rows").filter("aldi_score is not null").groupBy(F.least(F.floor(F.col("aldi_score") * 10).cast("int"), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))


@r.query("""WITH f AS (SELECT unnest([{'k': 'variety', 'v': controls.variety, 'ok': controls.variety = target_dialect}, {'k': 'sentiment', 'v': controls.sentiment, 'ok': controls.sentiment = sentiment}]) AS f FROM synthetic)
SELECT f.k AS factor, coalesce(CASE WHEN GROUPING(f.v) = 1 THEN '(all)' ELSE f.v END, '(none)') AS level, count(*) AS n, round(count_if(coalesce(f.ok, false)) / count(*), 6) AS rate FROM f GROUP BY GROUPING SETS ((f.k), (f.k, f.v))""")
def corpus_a19_adherence(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "synthetic").select("controls", "target_dialect", "sentiment")
    factor = lambda k, v, want: F.struct(F.lit(k).alias("factor"), F.coalesce(v, F.lit("(none)")).alias("level"), F.coalesce(v == want, F.lit(False)).alias("ok"))
    rows = s.select(F.explode(F.array(factor("variety", F.col("controls.variety"), F.col("target_dialect")), factor("sentiment", F.col("controls.sentiment"), F.col("sentiment")))).alias("f")).select("f.*")
    per = rows.groupBy("factor", "level").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    whole = per.groupBy("factor").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("level", F.lit("(all)"))
    return per.unionByName(whole).select("factor", "level", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"))


@r.query(f"""WITH d AS (SELECT dataset, split, count(*) AS n, avg(len({_tok('text')})) AS words, count_if(regexp_matches(text, 'https?://|\\bURL\\b')) / count(*) AS links FROM quality_rows WHERE text IS NOT NULL GROUP BY ALL), p AS (SELECT dataset, max(CASE WHEN split = 'train' THEN n END) AS n_train, max(CASE WHEN split = 'test' THEN n END) AS n_test,
max(CASE WHEN split = 'train' THEN words END) AS w1, max(CASE WHEN split = 'test' THEN words END) AS w2, max(CASE WHEN split = 'train' THEN links END) AS l1, max(CASE WHEN split = 'test' THEN links END) AS l2 FROM d GROUP BY dataset)
SELECT dataset, n_train, n_test, round(w1, 6) AS words_train, round(w2, 6) AS words_test, abs(l1 - l2) <= 0.05 AND greatest(w1, w2) / least(w1, w2) <= 1.25 AS alike FROM p""")
def corpus_a16_survey(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").filter("text is not null").select("dataset", "split", F.size(X.tokenize("text")).alias("w"), F.col("text").rlike(r"https?://|\bURL\b").alias("link"))
    p = rows.groupBy("dataset").pivot("split", ["train", "test"]).agg(F.count("w").alias("n"), F.avg("w").alias("w"), F.avg(F.col("link").cast("int")).alias("l"))
    alike = (F.abs(F.col("train_l") - F.col("test_l")) <= 0.05) & (F.greatest("train_w", "test_w") / F.least("train_w", "test_w") <= 1.25)
    return p.select("dataset", F.col("train_n").alias("n_train"), F.col("test_n").alias("n_test"), F.round("train_w", 6).alias("words_train"), F.round("test_w", 6).alias("words_test"), alike.alias("alike"))

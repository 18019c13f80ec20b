"""Duplicates, leakage and filter pipelines over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import portable as P
from lexmill.functions import text as X
from lexmill.operators import dedup
from lexmill.plans.registry import Registry
from lexmill.plans.text import _n, _sub, _tok
from lexmill.session import durable
from lexmill.sources.tables import table

r = Registry()
KEY = "lower(trim(" + _sub("text", P.WS + "+", " ") + "))"


def near_sql(src: str, ident: str, threshold: float = 0.8) -> str:
    """CTEs ``cls``, ``best`` and ``near`` (ident, duplicate_of, jaccard) over ``src`` with (ident, text)."""
    return f"""k AS (SELECT {ident} AS i, {KEY} AS key FROM {src} WHERE {KEY} <> ''), cls AS (SELECT key, min(i) AS c FROM k GROUP BY key),
sh AS (SELECT c, list_distinct(CASE WHEN length(key) <= 5 THEN [key] ELSE list_transform(range(1, length(key) - 3), lambda j: substr(key, j, 5)) END) AS s FROM cls),
ex AS (SELECT c, len(s) AS n, hash(unnest(s)) AS h FROM sh), dfq AS (SELECT h, count(*) AS df FROM ex GROUP BY h),
rk AS (SELECT c, n, h, row_number() OVER (PARTITION BY c ORDER BY df, h) AS p FROM ex JOIN dfq USING (h)), pre AS (SELECT c, n, h FROM rk WHERE p <= n - ceil({threshold} * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.c AS a, b.c AS b FROM pre a JOIN pre b ON a.h = b.h AND a.c > b.c AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) - 1e-9),
ov AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS o, len(x.s) AS na, len(y.s) AS nb FROM cand JOIN sh x ON x.c = a JOIN sh y ON y.c = b),
lk AS (SELECT a, b, o / (na + nb - o) AS j FROM ov WHERE o / (na + nb - o) >= {threshold}), best AS (SELECT a, max(j) AS j, arg_max(b, j * 1e12 - b) AS b FROM lk GROUP BY a),
near AS (SELECT k.i AS {ident}, CASE WHEN cls.c < k.i THEN cls.c ELSE best.b END AS duplicate_of, CASE WHEN cls.c < k.i THEN 1.0 ELSE best.j END AS jaccard FROM k JOIN cls USING (key) LEFT JOIN best ON best.a = cls.c WHERE cls.c < k.i OR best.b IS NOT NULL)"""


@r.query(f"SELECT doc_id, CASE WHEN f < doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {KEY}) AS f FROM documents)")
def dedup_n03_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf, "documents").select("doc_id", "text"), X.dedup_key("text"), "doc_id").select("doc_id", "duplicate_of")


@r.query("WITH " + near_sql("documents", "doc_id") + " SELECT doc_id, duplicate_of, round(jaccard, 6) AS jaccard FROM near")
def dedup_n05_near(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_duplicates_within(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "duplicate_of", F.round("jaccard", 6).alias("jaccard"))


@r.query()
def dedup_n05_near_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """MinHash bands: a subset of the exact answer, its recall measured in the tests."""
    return dedup.near_duplicates_within(table(spark, sf, "documents"), "text", "doc_id", mode="lsh").select("doc_id", "duplicate_of", F.round("jaccard", 6).alias("jaccard"))


@r.query(f"""WITH sh AS (SELECT item_id, list_distinct(list_transform(range(1, length(key) - 3), lambda j: substr(key, j, 5))) AS s FROM (SELECT item_id, {KEY} AS key FROM eval_items)),
q AS (SELECT DISTINCT key, list_distinct(list_transform(range(1, length(key) - 3), lambda j: substr(key, j, 5))) AS s FROM (SELECT {KEY} AS key FROM quality_rows WHERE text IS NOT NULL)),
a AS (SELECT key, unnest(s) AS g FROM q), b AS (SELECT item_id, unnest(s) AS g FROM sh), o AS (SELECT key, item_id, count(*) AS o FROM a JOIN b USING (g) GROUP BY ALL),
j AS (SELECT o.key, o.item_id, o / (len(q.s) + len(sh.s) - o) AS j FROM o JOIN q USING (key) JOIN sh USING (item_id)), m AS (SELECT key, max(j) AS j FROM j WHERE j >= 0.8 GROUP BY key)
SELECT ord, min(j.item_id) AS duplicate_of, round(any_value(m.j), 6) AS jaccard FROM m JOIN j ON j.key = m.key AND j.j = m.j JOIN (SELECT ord, {KEY} AS key FROM quality_rows) t ON t.key = m.key GROUP BY ord""")
def dedup_n06_against_eval(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup.near_duplicates_against(table(spark, sf, "quality_rows"), table(spark, sf, "eval_items"), "text", "ord", "text", "item_id")
    return out.select("ord", "duplicate_of", F.round("jaccard", 6).alias("jaccard"))


_CHECKED = f"""WITH {near_sql('documents', 'doc_id')},
f AS (SELECT d.doc_id, d.source, d.dialect, {KEY} = '' OR text IS NULL AS blank, min(doc_id) OVER (PARTITION BY {KEY}) < doc_id AS exact, {_n('text', P.ARABIC)} AS a, {_n('text', '\\p{L}')} AS l, len({_tok('text')}) AS w FROM documents d),
c AS (SELECT f.doc_id, f.source, f.dialect, list_filter([CASE WHEN blank THEN 'present' END, CASE WHEN exact THEN 'exact_dup' END, CASE WHEN near.doc_id IS NOT NULL THEN 'near_dup' END, CASE WHEN l = 0 OR a < 0.7 * l THEN 'script' END, CASE WHEN w NOT BETWEEN 20 AND 400 THEN 'length' END], lambda x: x IS NOT NULL) AS failed FROM f LEFT JOIN near USING (doc_id))"""


CHECKS = ("present", "exact_dup", "near_dup", "script", "length")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    docs, t = table(spark, sf, "documents").select("doc_id", "source", "dialect", "text"), F.col("text")
    key = X.dedup_key("text")  # its words are those of the text, with a space between each two
    words = F.length(key) - F.length(F.replace(key, F.lit(" "), F.lit(""))) + (key != "").cast("int")
    counted = {"arabic": X.count_chars(t, P.ARABIC), "letters": X.count_chars(t, r"\p{L}"), "words": words}
    rows = dedup.repeats(docs, "text", "doc_id", {"source": F.col("source"), "dialect": F.col("dialect"), **counted})
    return dedup.run_checks(rows, {
        "present": F.col("present"), "exact_dup": F.col("duplicate_of").isNull(), "near_dup": ~F.col("near"),
        "script": (F.col("letters") > 0) & (F.col("arabic") >= 0.7 * F.col("letters")), "length": F.col("words").between(20, 400),
    })


@r.query(_CHECKED + " SELECT doc_id, failed[1] AS rejected_by, array_to_string(failed, ',') AS failed FROM c")
def flow_n11_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("doc_id", "rejected_by", F.array_join("failed_checks", ",").alias("failed"))


@r.query(_CHECKED + " SELECT source, count(*) AS n_in, count_if(len(failed) = 0) AS n_kept, count_if(len(failed) > 0) AS n_rejected, round(count_if(len(failed) = 0) / count(*), 6) AS kept_rate FROM c GROUP BY source")
def flow_filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.filter_stats(_checked(spark, sf), "source").withColumn("kept_rate", F.round("kept_rate", 6))


@r.query(_CHECKED + """ SELECT 'failed' AS measure, k AS name, count_if(list_contains(failed, k)) AS n FROM c, (SELECT unnest(['present', 'exact_dup', 'near_dup', 'script', 'length']) AS k) GROUP BY k
UNION ALL SELECT 'rejected_by', k, count_if(failed[1] = k) FROM c, (SELECT unnest(['present', 'exact_dup', 'near_dup', 'script', 'length']) AS k) GROUP BY k
UNION ALL SELECT CASE WHEN len(failed) = 0 THEN 'kept_of' ELSE 'rejected_of' END, coalesce(dialect, ''), count(*) FROM c GROUP BY ALL""")
def flow_a17_check_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many records fail each check, how many each check rejects first, and how many of each dialect are kept and rejected."""
    return dedup.check_counts(_checked(spark, sf), list(CHECKS), "dialect")


@r.query(f"""WITH k AS (SELECT source, ord, {KEY} AS key, coalesce({_n('text', P.ARABIC_NARROW)} > 0 AND {_n('text', P.ARABIC_NARROW)} >= 0.7::DOUBLE * ({_n('text', P.ARABIC_NARROW)} + {_n('text', P.LATIN)}), false) AS ar FROM tweets),
s AS (SELECT *, CASE WHEN coalesce(key, '') = '' THEN 'empty' WHEN NOT ar THEN 'unwanted' WHEN row_number() OVER (PARTITION BY coalesce(key, ''), ar ORDER BY source, ord) = 1 THEN 'kept' ELSE 'repeat' END AS kind FROM k)
SELECT source, count(*) AS n_rows, count_if(kind = 'empty') AS empty, count_if(kind = 'unwanted') AS unwanted, count_if(kind = 'repeat') AS repeat, count_if(kind = 'kept') AS kept FROM s GROUP BY source""")
def dedup_n09_first_come(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_come(table(spark, sf, "tweets"), X.dedup_key("text"), F.coalesce(X.is_arabic("text"), F.lit(False)), ["source", "ord"], "source")


@r.query("WITH " + near_sql("documents", "doc_id") + f""" SELECT count(*) AS n, round(count_if(exact) / count(*), 6) AS exact_rate, round(count_if(near.doc_id IS NOT NULL) / count(*), 6) AS near_rate, round(count_if(exact OR near.doc_id IS NOT NULL) / count(*), 6) AS repeats
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {KEY}) < doc_id AS exact FROM documents) d LEFT JOIN near USING (doc_id)""")
def dedup_n08_measures(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    near = dedup.near_duplicates_within(docs, "text", "doc_id").select("doc_id", F.lit(True).alias("near"))
    digests = durable(docs.select("doc_id", F.unhex(F.sha2(X.dedup_key("text"), 256)).alias("digest")))
    rows = dedup.exact_duplicates(digests, F.col("digest"), "doc_id").join(near, "doc_id", "left")
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    exact, close = F.col("duplicate_of").isNotNull(), F.col("near").isNotNull()
    return rows.agg(F.count("*").alias("n"), rate(exact).alias("exact_rate"), rate(close).alias("near_rate"), rate(exact | close).alias("repeats"))


_NORM = f"array_to_string(regexp_extract_all(lower(translate({_sub(_sub(_sub(_sub('text', 'https?://\\S+|www\\.\\S+', ' '), P.HANDLE, ' '), r'\b(?:USER|URL|EMOJI|NUM)\b', ' '), P.DIACRITICS_TATWEEL, '')}, 'إأآٱ', 'اااا')), '{P.LEXICAL_WORD}'), ' ')"


@r.query(f"SELECT dataset, count(*) AS n, count_if(norm = '') AS n_empty, round((count_if(norm <> '') - count(DISTINCT CASE WHEN norm <> '' THEN norm END)) / greatest(1, count_if(norm <> '')), 6) AS repeat_share FROM (SELECT dataset, {_NORM} AS norm FROM quality_rows WHERE text IS NOT NULL) GROUP BY dataset")
def dedup_a12_repeat_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").filter("text is not null").groupBy("dataset", X.norm("text").alias("norm")).agg(F.count("*").alias("n"))
    full = F.sum(F.when(F.col("norm") != "", F.col("n")).otherwise(0))
    return rows.groupBy("dataset").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("norm") == "", F.col("n")).otherwise(0)).alias("n_empty"), F.round((full - F.count_if(F.col("norm") != "")) / F.greatest(F.lit(1), full), 6).alias("repeat_share"))


@r.query(f"""WITH d AS (SELECT DISTINCT dataset, {_NORM} AS norm FROM quality_rows WHERE text IS NOT NULL), n AS (SELECT dataset, count(*) AS n FROM d GROUP BY dataset)
SELECT a.dataset AS a, b.dataset AS b, count(*) AS n_shared, round(count(*) / any_value(n.n), 6) AS share_of_a FROM d a JOIN d b ON a.norm = b.norm AND a.dataset < b.dataset JOIN n ON n.dataset = a.dataset GROUP BY ALL""")
def dedup_j07_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """One row a norm with its set of datasets comes first, so that copies never meet each other."""
    d = table(spark, sf, "quality_rows").filter("text is not null").groupBy(X.norm("text").alias("norm")).agg(F.array_sort(F.collect_set("dataset")).alias("ds"))
    n = d.select(F.explode("ds").alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    pairs = d.filter(F.size("ds") > 1).select(F.explode("ds").alias("a"), "ds").select("a", F.explode("ds").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared")).join(F.broadcast(n), "a").select("a", "b", "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("share_of_a"))


@r.query("""WITH t AS (SELECT DISTINCT x FROM (SELECT text AS x FROM quality_rows WHERE split = 'test' UNION ALL SELECT mtext FROM quality_rows WHERE split = 'test') WHERE x IS NOT NULL)
SELECT dataset, count(*) AS n_left FROM quality_rows q WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM t WHERE x = q.text) AND NOT EXISTS (SELECT 1 FROM t WHERE x = q.mtext) GROUP BY dataset""")
def dedup_j04_train_without_test(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").select("dataset", "split", "text", "mtext")
    test = rows.filter("split = 'test'")
    keys = test.select(F.col("text").alias("x")).unionAll(test.select("mtext")).filter("x is not null").distinct()
    left = rows.filter("split = 'train'").join(keys, F.col("text") == F.col("x"), "left_anti").join(keys, F.col("mtext") == F.col("x"), "left_anti")
    return left.groupBy("dataset").agg(F.count("*").alias("n_left"))


@r.query("SELECT split, count(*) AS n, count_if(text IN (SELECT text FROM eval_items)) AS n_in_eval FROM quality_rows WHERE text IS NOT NULL GROUP BY split")
def dedup_j06_exact_overlap(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "eval_items").select("text", F.lit(1).alias("hit")).filter("text is not null").distinct()
    rows = table(spark, sf, "quality_rows").filter("text is not null").select("split", "text").join(ev, "text", "left")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count("hit").alias("n_in_eval"))


@r.query(f"""WITH x AS (SELECT ord, sentiment, variety, unnest(few_shot_texts) AS text FROM requests), c AS (SELECT ord, sentiment, variety, trim({_sub(_sub(_sub('text', P.URL, ' URL '), P.HANDLE, ' USER '), ' {2,}', ' ')}, ' ') AS text FROM x WHERE text IS NOT NULL),
g AS (SELECT text, count(DISTINCT sentiment) AS cd, min(ord) AS ord, count(*) AS n, count(DISTINCT variety) AS cv FROM c GROUP BY text) SELECT text, ord, n, cv > 1 AS variety_conflict FROM g WHERE cd <= 1""")
def dedup_a09_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of every array, cleaned, without those of several sentiments; n counts uses."""
    return conflict_free(table(spark, sf, "requests"))


def conflict_free(requests: DataFrame) -> DataFrame:
    """(text, ord, n, variety_conflict) of the cleaned few-shot texts that stand under one sentiment at most."""
    rows = requests.select("ord", "sentiment", "variety", F.explode("few_shot_texts").alias("text")).filter("text is not null").withColumn("text", X.clean_text("text")[0])
    g = rows.groupBy("text").agg(F.count_distinct("sentiment").alias("cd"), F.min("ord").alias("ord"), F.count("*").alias("n"), F.count_distinct("variety").alias("cv"))
    return g.filter("cd <= 1").select("text", "ord", "n", (F.col("cv") > 1).alias("variety_conflict"))


@r.query("SELECT (SELECT count(*) FROM (SELECT text FROM tweets WHERE split = 'train' INTERSECT SELECT text FROM tweets WHERE split <> 'train')) AS n_both, (SELECT count(*) FROM (SELECT text FROM tweets WHERE split <> 'train' EXCEPT SELECT text FROM tweets WHERE split = 'train')) AS n_new")
def dedup_s02_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "tweets").groupBy("text").agg(F.bool_or(F.col("split") == "train").alias("a"), F.bool_or(F.col("split") != "train").alias("b"))
    return rows.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("b") & ~F.coalesce("a", F.lit(False))).alias("n_new"))

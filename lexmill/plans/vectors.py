"""Vectors and retrieval over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import semantic
from lexmill.plans.registry import Registry
from lexmill.plans.text import _tok
from lexmill.sources.tables import table

r = Registry()
_U = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_SUM = "l AS (SELECT label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM u), s AS (SELECT label, d, sum(x) AS s, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT label, any_value(n) AS n, list(s ORDER BY d) AS s FROM s GROUP BY label), cc AS (SELECT label, n, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c FROM c)"


def _vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


@r.query(f"WITH {_U}, {_SUM} SELECT label, n, round(CASE WHEN n > 1 THEN 1 - (list_dot_product(s, s) - n) / (n * (n - 1)) ELSE 0.0 END, 6) AS distance FROM c")
def vectors_m01_cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.mean_cosine_distance(_vecs(spark, sf), ["label"]).withColumn("distance", F.round("distance", 6))


@r.query(f"WITH {_U}, {_SUM} SELECT u.label, count(*) AS n, round(avg(1 - list_dot_product(v, c)), 6) AS distance FROM u JOIN cc ON u.label IS NOT DISTINCT FROM cc.label GROUP BY u.label")
def vectors_m02_centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows, cent = semantic.normalised(_vecs(spark, sf)), semantic.centroids(_vecs(spark, sf), "label")
    both = rows.join(F.broadcast(cent.select(F.col("label").alias("l"), "centre")), rows["label"].eqNullSafe(F.col("l")))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(1 - semantic.dot(F.col("embedding"), F.col("centre"))), 6).alias("distance"))


@r.query(f"WITH {_U}, {_SUM} SELECT vec_id, arg_max(cc.label, round(list_dot_product(v, c), 12)) AS label, round(max(list_dot_product(v, c)), 6) AS similarity FROM u, cc GROUP BY vec_id")
def vectors_j18_nearest_centre(spark: SparkSession, sf: str) -> DataFrame:
    v = _vecs(spark, sf)
    return semantic.nearest_centre(v, semantic.centroids(v, "label"), "vec_id", "label").withColumn("similarity", F.round("similarity", 6))


@r.query(f"WITH {_U}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS score FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p) SELECT query, rank, id, round(score, 6) AS score FROM k WHERE rank <= 10")
def vectors_j19_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the rows whose number is divisible by 20, against all rows."""
    v = _vecs(spark, sf)
    return semantic.nearest(v, v.filter("vec_id % 20 = 0"), "vec_id", 10).withColumn("score", F.round("score", 6))


@r.query(f"""WITH d AS (SELECT doc_id, {_tok('text')} AS w FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, len(w) AS dl, w FROM d WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS t FROM dl) GROUP BY ALL),
df AS (SELECT t, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS i FROM tf, st GROUP BY t, n), m AS (SELECT avg(i) AS m FROM df), w AS (SELECT t, CASE WHEN i < 0 THEN 0.25 * m ELSE i END AS i FROM df, m), q AS (SELECT item_id, unnest(list_distinct({_tok('text')})) AS t FROM eval_items),
s AS (SELECT item_id AS query, doc_id AS doc, round(sum(i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM q JOIN w USING (t) JOIN tf USING (t), st GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, rank, doc, round(score, 6) AS score FROM k WHERE rank <= 5""")
def vectors_j20_bm25(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text is not null").select("doc_id", X.tokenize("text").alias("w"))
    items = table(spark, sf, "eval_items").select("item_id", X.tokenize("text").alias("w"))
    return semantic.bm25(docs, items, "doc_id", "item_id", "w", 5).withColumn("score", F.round("score", 6))


@r.query()
def vectors_m03_vendi(spark: SparkSession, sf: str) -> DataFrame:
    """An eigenvalue problem of the size of the dimensions, tested on orthogonal and equal vectors."""
    return spark.createDataFrame([(semantic.vendi_score(_vecs(spark, sf)),)], "vendi double")


@r.query()
def vectors_m04_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.kmeans(_vecs(spark, sf), "vec_id", 8)[0]


@r.query("WITH l AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL), s AS (SELECT label, d, sum(x) AS s, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT *, sum(s) OVER (PARTITION BY d) AS t, sum(n) OVER (PARTITION BY d) AS m FROM s), f AS (SELECT label, d, s / n - (t - s) / (m - n) AS x FROM a), z AS (SELECT label, sqrt(sum(x * x)) AS z FROM f GROUP BY label) SELECT label, d - 1 AS d, round(x / z, 6) + 0.0 AS x FROM f JOIN z USING (label)")
def vectors_m13_directions(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.class_directions(_vecs(spark, sf), "label").select("label", F.posexplode("direction").alias("d", "x")).select("label", "d", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@r.query(f"WITH {_U}, {_SUM} SELECT a.label AS a, b.label AS b, round(list_dot_product(a.c, b.c), 6) AS similarity FROM cc a JOIN cc b ON a.label < b.label")
def vectors_m06_centroid_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of the few centres."""
    c = semantic.centroids(_vecs(spark, sf), "label").select("label", "centre")
    a, b = c.toDF("a", "ca"), c.toDF("b", "cb")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(semantic.dot(F.col("ca"), F.col("cb")), 6).alias("similarity"))

"""Classifiers and probes over text and vectors, and dimensions that tell classes apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import text as X
from lexmill.operators import select, semantic


def _rates(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """(label, d, rate): how often each dimension is positive, from partial counts."""
    long = df.filter(F.col(label).isNotNull()).select(label, F.posexplode(vec).alias("d", "x"))
    return long.groupBy(label, "d").agg(F.avg((F.col("x") > 0).cast("int")).alias("rate"))


def firing_gaps(df: DataFrame, label: str, k: int, vec: str = "embedding") -> DataFrame:
    """The ``k`` dimensions of each class whose rate most exceeds the mean rate of the other classes."""
    w = Window.partitionBy("d")
    m = _rates(df, label, vec).withColumn("gap", F.col("rate") - (F.sum("rate").over(w) - F.col("rate")) / (F.count("*").over(w) - 1))
    return m.withColumn("rn", F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.round("gap", 9)), "d"))).filter(F.col("rn") <= k)


def selective_dimensions(df: DataFrame, label: str, k: int, vec: str = "embedding") -> DataFrame:
    """The ``k`` dimensions whose rates are least evenly spread over the classes."""
    p = _rates(df, label, vec).withColumn("p", F.col("rate") / F.sum("rate").over(Window.partitionBy("d")))
    e = p.groupBy("d").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"))
    return e.withColumn("rn", F.row_number().over(Window.orderBy(F.round("entropy", 9), "d"))).filter(F.col("rn") <= k)


def _held_out(df: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    rows = select.stratified_split(df.withColumn("_all", F.lit("a")), ["_all"], ident, 0.25, "held").drop("_all")
    return rows.filter("part = 'train'"), rows.filter("part = 'dev'")


def _accuracy(model, test: DataFrame) -> DataFrame:
    return model.transform(test).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))


def tfidf_accuracy(df: DataFrame, ident: str, text: str, label: str) -> DataFrame:
    """(n, accuracy) on a held-out quarter of logistic regression over weighted words and character 3-grams."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer

    key = X.dedup_key(text)
    rows = df.select(ident, label, F.concat(X.lexical_tokens(text), X.shingles(key, 3)).alias("terms"))
    rows = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    train, test = _held_out(rows, ident)
    steps = [HashingTF(inputCol="terms", outputCol="tf", numFeatures=1 << 15), IDF(inputCol="tf", outputCol="features", minDocFreq=2), LogisticRegression(labelCol="y", regParam=0.1, maxIter=30)]
    return _accuracy(Pipeline(stages=steps).fit(train), test)


def pca_probe(df: DataFrame, ident: str, label: str, k: int, vec: str = "embedding") -> DataFrame:
    """(n, accuracy) on a held-out quarter of logistic regression over ``k`` principal components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = semantic.normalised(df.filter(F.col(label).isNotNull()), vec).select(ident, F.col(label).cast("double").alias("y"), array_to_vector(vec).alias("v"))
    train, test = _held_out(rows, ident)
    return _accuracy(Pipeline(stages=[PCA(k=k, inputCol="v", outputCol="features"), LogisticRegression(labelCol="y", maxIter=50)]).fit(train), test)


def split_half(df: DataFrame, ident: str, label: str, vec: str = "embedding") -> DataFrame:
    """(label, cosine) of the directions that two random halves of the rows give."""
    halves = select.folds(df.select(ident, label, vec), ident, 2, "half")
    a, b = (semantic.class_directions(halves.filter(F.col("fold") == k), label, vec) for k in (0, 1))
    both = a.toDF(label, "da").join(b.toDF(label, "db"), label)
    return both.select(label, semantic.dot(F.col("da"), F.col("db")).alias("cosine"))

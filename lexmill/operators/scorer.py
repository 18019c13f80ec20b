"""The boundary to models: a scorer is any callable from a list of texts to rows, run in batches where the data is."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], list[dict]]


def score(df: DataFrame, ident: str, text: str, make: Callable[[], Scorer], schema: str, batch: int = 64) -> DataFrame:
    """(ident, fields of ``schema``) by a scorer that ``make`` builds once a task. Each distinct text is scored once; null texts aren't."""
    texts = df.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        scorer = make()
        for b in batches:
            for i in range(0, len(b), batch):
                part = b["_t"].iloc[i : i + batch].tolist()
                rows = scorer(part)
                if len(rows) != len(part):
                    raise ValueError("a scorer must give a row for each text")
                yield pd.DataFrame({"_t": part, **{n: [r[n] for r in rows] for n in names}})

    scored = texts.mapInPandas(run, f"_t string, {schema}")
    return df.select(ident, F.col(text).alias("_t")).join(scored, "_t").drop("_t")


def ensemble(df: DataFrame, ident: str, probs: str) -> DataFrame:
    """(ident, pred, prob): the class of the highest mean probability over several predictions of a record, the first by name on ties."""
    long = df.select(ident, F.explode(probs).alias("c", "p")).groupBy(ident, "c").agg(F.avg("p").alias("p"))
    best = long.groupBy(ident).agg(F.max(F.struct("p", "c")).alias("m"), F.max("p").alias("p"))
    first = long.join(best, [ident, "p"]).groupBy(ident, "p").agg(F.min("c").alias("pred"))
    return first.select(ident, "pred", F.col("p").alias("prob"))

"""Connectives and mixed scripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import portable as P
from lexmill.functions import text as X


@dataclass(frozen=True)
class Connective:
    """An entry of a lexicon; with ``later``, one of its words has to come after it."""

    id: str
    words: tuple[str, ...]
    script: str
    pattern: str
    position: str
    later: tuple[str, ...] = ()


def lexicon(lines: str = P.CONNECTIVES) -> tuple[Connective, ...]:
    """The entries of lines of fields between bars, further fields being words for ``later``; a name that comes twice is refused."""
    fields = [[f.strip() for f in line.split("|")] for line in lines.strip().splitlines()]
    out = tuple(Connective(f[0], tuple(f[1].lower().split()), *f[2:5], tuple(f[5].lower().split()) if len(f) > 5 else ()) for f in fields)
    if len({e.id for e in out}) < len(out):
        raise ValueError("a name of the lexicon comes twice")
    return out


def lexicon_table(spark: SparkSession, entries: tuple[Connective, ...]) -> DataFrame:
    return spark.createDataFrame([(e.id, list(e.words), e.script, e.pattern, e.position, list(e.later)) for e in entries], "id string, toks array<string>, script string, pattern string, position string, later array<string>")


def find_connectives(df: DataFrame, ident: str = "ord", text: str = "text", entries: tuple[Connective, ...] | None = None, min_side: int = 2) -> DataFrame:
    """(ident, id, script, pattern, start, stop): a row for each lexicon entry and text that holds it at a place its position rule allows, with its first such place.

    Entries meet texts by their first word, so that texts without any are never looked at twice. The lexicon is a parameter and is
    broadcast. Null and empty texts hold none; a text that repeats has a row each.
    """
    table = lexicon_table(df.sparkSession, entries or lexicon())
    words = df.select(ident, X.connective_words(text).alias("_words"))
    rows = words.withColumn("w", F.explode(F.array_distinct("_words"))).join(F.broadcast(table.withColumn("w", F.get("toks", F.lit(0)))), "w")
    n, size = F.size("toks"), F.size("_words")
    starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def fits(i: Column) -> Column:
        same = F.slice("_words", i, n) == F.col("toks")
        medial = (F.col("position") != "medial") | ((i - 1 >= min_side) & (size - i - n + 1 >= min_side))
        later = (F.size("later") == 0) | F.arrays_overlap("later", F.slice("_words", i + n, size))
        return same & medial & later & ((F.col("position") != "any") | (size - n >= 2 * min_side))

    at = F.get(F.filter(starts, fits), F.lit(0))
    return rows.withColumn("start", at - 1).filter("start is not null").withColumn("stop", F.col("start") + n).select(ident, "id", "script", "pattern", "start", "stop")


def connective_hits(found: DataFrame, entries: tuple[Connective, ...], ident: str = "ord") -> DataFrame:
    """(id, words, pattern, n_hits, place): how many texts hold each entry, those that none holds too, with its place by that number."""
    n = found.groupBy("id").agg(F.count("*").alias("n_hits"))
    rows = lexicon_table(found.sparkSession, entries).select("id", F.array_join("toks", " ").alias("words"), "pattern").join(n, "id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_hits"), "id")))  # the lexicon's rows, a parameter


def tag_latin(df: DataFrame, ident: str, text: str, english: DataFrame, franco: DataFrame) -> DataFrame:
    """(ident, at, token, tag): each Latin token is english, franco, unknown or other; a word of both lists takes what the rest of its text has more of."""
    tok = df.select(ident, F.posexplode(F.regexp_extract_all(F.regexp_replace(F.col(text), P.NOISE, " "), F.lit(r"[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*(?:'[A-Za-z]+)*"), F.lit(0))).alias("at", "token"))
    tok = tok.withColumn("w", F.lower("token"))
    tok = tok.join(english.select(F.col("word").alias("w"), F.lit(True).alias("en")).distinct(), "w", "left").join(franco.select(F.col("word").alias("w"), F.lit(True).alias("fr")).distinct(), "w", "left")
    first = F.when(F.col("en") & F.col("fr"), "both").when(F.col("en"), "english").when(F.col("fr") | F.col("w").rlike("[2356789][a-z]|[a-z][2356789]"), "franco").when(F.length("w") < 2, "other").otherwise("unknown")
    tok = tok.withColumn("t", first)
    ctx = tok.groupBy(ident).agg(F.count_if(F.col("t") == "english").alias("ne"), F.count_if(F.col("t") == "franco").alias("nf"))
    tag = F.when(F.col("t") == "both", F.when(F.col("nf") > F.col("ne"), "franco").otherwise("english")).otherwise(F.col("t"))
    return tok.join(ctx, ident).select(ident, "at", "token", tag.alias("tag"))


def group_of(patterns: Column, compositional: tuple[str, ...] = ("contrast", "concession", "expectation_violation", "counterfactual", "reinforcement")) -> Column:
    return F.when(F.arrays_overlap(patterns, F.array(*map(F.lit, compositional))), "five_patterns").when(F.size(patterns) > 0, "other_subordinator").otherwise("neither")


def script_histogram(df: DataFrame, text: str = "text") -> DataFrame:
    """(bin, n) for the eleven bins of the Arabic share, empty ones too."""
    n = df.select(X.arabic_bin(text).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(0, 11).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))

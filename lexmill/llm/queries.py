"""Queries of the ten problems over the test tables, and their SQL where SQL can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import glyphs, languages, leakage, mixing, overlap, packing, pii, proportions, sentences, tokens, truncation
from lexmill.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.row_pairs(*overlap.class_links(table(spark, sf, "tweets")))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.report(*overlap.class_links(table(spark, sf, "tweets")))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with its class and the number of classes across the split border that it links to."""
    members, links = overlap.class_links(table(spark, sf, "tweets"))
    n = links.select(F.col("cls_eval").alias("cls"), F.col("cls_train").alias("other")).union(links.select("cls_train", "cls_eval")).distinct()
    return members.join(n.groupBy("cls").agg(F.count("*").alias("n_links")), "cls", "left").select("ord", "split", "source", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _p2(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "tweets").select(F.lit("tweets").alias("tbl"), "ord", "text", "lang")
    rows = rows.unionByName(table(spark, sf, "quality_rows").select(F.lit("quality_rows").alias("tbl"), "ord", F.col("mtext").alias("text"), "lang"))
    labelled = rows.select("text", "lang").unionByName(table(spark, sf, "documents").select("text", "lang"))
    langs = [r.lang for r in table(spark, sf, "langcodes").filter("lang is not null").select("lang").distinct().collect()]
    return languages.identify(rows, labelled, langs)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    missing = F.coalesce(F.col("stated"), F.lit("")).isin("", "und")
    return _p2(spark, sf).filter((F.col("seg_no") > 0) | missing | (F.col("stated") != F.col("lang"))).select("tbl", "ord", "seg_no", "lang")


def p2_languages(spark: SparkSession, sf: str) -> DataFrame:
    return _p2(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.equal_looking(table(spark, sf, "tweets"))


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.with_form(table(spark, sf, "tweets").select("ord", "text")).select("ord", "form")


def _p4(spark: SparkSession, sf: str, edited: bool) -> DataFrame:
    train = table(spark, sf, "quality_rows").filter("split = 'train'").select(F.lit("quality_rows").alias("tbl"), "ord", "text")
    shots = table(spark, sf, "requests").select(F.lit("requests").alias("tbl"), "ord", F.explode("few_shot_texts").alias("text"))
    return leakage.leaks(train.unionByName(shots), table(spark, sf, "eval_items"), edited=edited)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.verdicts(_p4(spark, sf, edited=False)).filter("kind = 'run'").select("item_id", "tbl", "ord")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.verdicts(_p4(spark, sf, edited=True))


def _p5(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return proportions.proportional_sample(table(spark, sf, "requests"), table(spark, sf, "target_shares"), ["variety", "sentiment"], "request_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p5(spark, sf)[1].filter(~F.col("met")).select("variety", "sentiment")


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _p5(spark, sf)[0]


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return _p5(spark, sf)[1]


def _p6(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "quality_rows").select(F.lit("quality_rows").alias("tbl"), "ord", F.col("dataset").alias("grp"), F.col("text").alias("value"), F.lit(False).alias("capped"))
    made = table(spark, sf, "synthetic").select(
        F.lit("synthetic").alias("tbl"), "ord", F.col("generator").alias("grp"), F.col("raw_output").alias("value"), (F.col("new_tokens") >= F.col("sampling.max_new_tokens")).alias("capped")
    )
    return truncation.judged(rows.unionByName(made))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(spark, sf).filter("sign IS NOT NULL").select("tbl", "ord")


def p6_judged(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(spark, sf)


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(_p6(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "tweets"))


def p7_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.masked(table(spark, sf, "tweets"), key=spark.conf.get("spark.lexmill.pseudonym.key", "key of the tests"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", tokens.n_tokens("text").alias("n_tokens"))


def _p8(spark: SparkSession, sf: str, container: str, targets: DataFrame | None = None) -> DataFrame:
    capacity = table(spark, sf, "containers").filter(F.col("container") == container).first().capacity_tokens
    return packing.pack(_sizes(spark, sf), capacity, targets=targets)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.split_documents(_p8(spark, sf, "train_window"))


def p8_mixed_window(spark: SparkSession, sf: str) -> DataFrame:
    """Windows in the proportions of mix_targets, as far as the scarcest source goes."""
    return _p8(spark, sf, "train_window", table(spark, sf, "mix_targets"))


def p8_train_window(spark: SparkSession, sf: str) -> DataFrame:
    return _p8(spark, sf, "train_window")


def p8_short_window(spark: SparkSession, sf: str) -> DataFrame:
    return _p8(spark, sf, "short_window")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[1].filter(~F.col("met")).select("source")


def p9_uses(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split(table(spark, sf, "documents")).select("doc_id", "sent_start", "sent_end")


def p10_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_classes, p2_found, p2_languages, p3_found, p3_forms, p4_found, p4_report, p5_found, p5_sample, p5_report, p6_found, p6_judged, p6_rates, p7_found, p7_masked, p8_found, p8_train_window, p8_short_window, p8_mixed_window, p9_found, p9_uses, p9_shares, p10_found, p10_sentences)}
_P6 = truncation.sql("""SELECT 'quality_rows' AS tbl, ord, dataset AS grp, text AS value, false AS capped FROM quality_rows
UNION ALL SELECT 'synthetic', ord, generator, raw_output, new_tokens >= sampling.max_new_tokens FROM synthetic""")
_P5 = """
WITH n AS (SELECT count(DISTINCT request_id) / 5 AS n FROM requests),
r AS (SELECT DISTINCT r.variety, r.sentiment, request_id, target_share, min_rows FROM requests r JOIN target_shares USING (variety, sentiment) WHERE request_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY variety, sentiment ORDER BY sha256('1|' || variety || '|' || sentiment || '|' || request_id), request_id) AS rank FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY rank > min_rows, (rank - 0.5::DOUBLE) / target_share, variety, sentiment) AS place FROM k),
s AS (SELECT o.* FROM o, n WHERE place <= floor(n.n)) """
ORACLE: dict[str, str] = {
    "p5_found": """
        WITH n AS (SELECT count(DISTINCT request_id) AS n FROM requests),
             c AS (SELECT variety, sentiment, count(DISTINCT request_id) AS c FROM requests GROUP BY ALL)
        SELECT variety, sentiment FROM target_shares LEFT JOIN c USING (variety, sentiment), n
        WHERE coalesce(c, 0) < greatest(min_rows::DOUBLE, target_share * (n / 5))""",
    "p5_sample": _P5 + "SELECT variety, sentiment, request_id, rank, (rank - 0.5::DOUBLE) / target_share AS priority, rank <= min_rows AS in_floor FROM s",
    "p5_report": _P5 + """, c AS (SELECT variety, sentiment, count(*) AS c FROM k GROUP BY ALL), t AS (SELECT variety, sentiment, count(*) AS t FROM s GROUP BY ALL)
        SELECT variety, sentiment, target_share, min_rows, coalesce(c, 0) AS available, coalesce(t, 0) AS taken, greatest(min_rows::DOUBLE, target_share * n.n) AS wanted,
               coalesce(c, 0) >= greatest(min_rows::DOUBLE, target_share * n.n) AS met
        FROM target_shares LEFT JOIN c USING (variety, sentiment) LEFT JOIN t USING (variety, sentiment), n""",
    "p6_found": _P6 + "SELECT tbl, ord FROM judged WHERE sign IS NOT NULL",
    "p6_judged": _P6 + "SELECT * FROM judged",
    "p6_rates": _P6 + "SELECT tbl, grp, count(*) AS n_values, count(sign) AS n_cut, count(sign) / count(*) AS share FROM judged GROUP BY tbl, grp",
}

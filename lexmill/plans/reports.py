"""Reports over runs, errors, topics and pairs of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import portable as P
from lexmill.functions import text as X
from lexmill.operators import codemix, metrics, semantic
from lexmill.operators import select as S
from lexmill.plans.registry import Registry
from lexmill.plans.text import _CWORDS, _LEXICON, _n, _sub, _tok
from lexmill.plans.vectors import _SUM, _U
from lexmill.sources.tables import table

r = Registry()


@r.query("SELECT template_id, generator, rn FROM (SELECT template_id, generator, row_number() OVER (PARTITION BY generator ORDER BY n DESC, template_id) AS rn FROM (SELECT template_id, generator, count(*) AS n FROM synthetic GROUP BY ALL)) WHERE rn <= 3")
def report_t01_most_common(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the report: the three most frequent templates of each generator."""
    n = table(spark, sf, "synthetic").groupBy("generator", "template_id").agg(F.count("*").alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("generator").orderBy(F.desc("n"), "template_id"))).filter("rn <= 3").select("template_id", "generator", "rn")


@r.query(f"""WITH t AS (SELECT ord, {_CWORDS} AS w FROM tweets WHERE text IS NOT NULL), h AS (SELECT t.ord, c.id, c.pattern, list_filter(range(1, len(w) - len(toks) + 2), lambda i: w[i:i + len(toks) - 1] = toks AND (position <> 'medial' OR (i - 1 >= 2 AND len(w) - i - len(toks) + 1 >= 2)) AND (position <> 'any' OR len(w) - len(toks) >= 4)) AS pos FROM t JOIN {_LEXICON} ON list_contains(t.w, c.toks[1])),
f AS (SELECT ord, list_distinct(list(pattern)) AS pats FROM h WHERE len(pos) > 0 GROUP BY ord)
SELECT CASE WHEN list_has_any(coalesce(pats, []), ['contrast', 'concession', 'expectation_violation', 'counterfactual', 'reinforcement']) THEN 'five_patterns' WHEN len(pats) > 0 THEN 'other_subordinator' ELSE 'neither' END AS grp, CASE WHEN len(w) < 10 THEN '1-9' WHEN len(w) < 20 THEN '10-19' ELSE '20+' END AS band, count(*) AS n, round(avg(len(w)), 6) AS mean_words FROM t LEFT JOIN f USING (ord) GROUP BY ALL""")
def report_a40_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "tweets").filter("text is not null").select("ord", "text")
    found = codemix.find_connectives(rows).groupBy("ord").agg(F.collect_set("pattern").alias("pats"))
    rows = rows.select("ord", F.size(X.connective_words("text")).alias("n_words")).join(found, "ord", "left").withColumn("pats", F.coalesce("pats", F.array().cast("array<string>")))
    return rows.groupBy(codemix.group_of(F.col("pats")).alias("grp"), X.length_band("n_words").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("n_words"), 6).alias("mean_words"))


@r.query(f"""WITH b AS (SELECT {_sub('text', P.NOISE, ' ')} AS t FROM tweets WHERE text IS NOT NULL), c AS (SELECT {_n('t', P.ARABIC)} AS a, {_n('t', P.LATIN)} AS l FROM b), h AS (SELECT CASE WHEN a + l > 0 THEN least(10, (20 * a + a + l) // (2 * (a + l))) END AS bin, count(*) AS n FROM c GROUP BY bin)
SELECT g.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(11)) AS bin) g LEFT JOIN h ON h.bin = g.bin""")
def report_a51_script_bins(spark: SparkSession, sf: str) -> DataFrame:
    return codemix.script_histogram(table(spark, sf, "tweets").filter("text is not null"))


@r.query("SELECT coalesce(split, '(all)') AS split, count(*) AS n, round(max(c) / greatest(1, min(c)), 6) AS imbalance FROM (SELECT split, sentiment, count(*) AS c FROM eval_items GROUP BY split, sentiment UNION ALL SELECT NULL, sentiment, count(*) FROM eval_items GROUP BY sentiment) GROUP BY split".replace("count(*) AS n", "sum(c)::BIGINT AS n"))
def report_a52_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "eval_items").groupBy("split", "sentiment").agg(F.count("*").alias("c"))
    both = c.unionByName(c.groupBy("sentiment").agg(F.sum("c").alias("c")).withColumn("split", F.lit("(all)")))
    return both.groupBy("split").agg(F.sum("c").alias("n"), F.round(F.max("c") / F.greatest(F.lit(1), F.min("c")), 6).alias("imbalance"))


_LANGS = f"list_transform({_tok(_sub('text', P.NOISE, ' '))}, lambda w: CASE WHEN regexp_matches(w, '{P.ARABIC}') AND regexp_matches(w, '{P.LATIN_WORD}') THEN 'mixed' WHEN regexp_matches(w, '{P.ARABIC}') THEN 'ar' WHEN regexp_matches(w, '{P.LATIN_WORD}') THEN 'en' ELSE 'other' END)"


@r.query(f"WITH l AS (SELECT dataset, {_LANGS} AS g FROM quality_rows WHERE text IS NOT NULL), s AS (SELECT dataset, len(list_filter(g, lambda x: x = 'ar')) AS a, len(list_filter(g, lambda x: x = 'en')) AS e, len(list_filter(g, lambda x: x <> 'other')) AS n FROM l), c AS (SELECT dataset, CASE WHEN n > 0 THEN 100 * (1 - greatest(a, e) / n) ELSE 0.0 END AS cmi, a > e AS ar FROM s) SELECT dataset, count(*) AS n, round(avg(cmi), 6) AS mean_cmi, round(median(cmi), 6) AS median_cmi, round(count_if(cmi = 0) / count(*), 6) AS zero_share, round(count_if(ar) / count(*), 6) AS arabic_share FROM c GROUP BY dataset")
def report_a53_code_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.code_mixing(table(spark, sf, "quality_rows").filter("text is not null").select("dataset", "text")).select("dataset", "cmi", "dominant")
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg("cmi"), 6).alias("mean_cmi"), F.round(F.median("cmi"), 6).alias("median_cmi"), share(F.col("cmi") == 0).alias("zero_share"), share(F.col("dominant") == "ar").alias("arabic_share"))


@r.query("WITH m AS (SELECT ord, map_entries(labels) AS e FROM quality_rows WHERE labels IS NOT NULL), x AS (SELECT ord, unnest(e) AS e FROM m), g AS (SELECT ord, CASE WHEN e.key IN ('egypt', 'sudan') THEN 'nile' WHEN e.key IN ('algeria', 'libya', 'morocco', 'tunisia') THEN 'maghreb' WHEN e.key IN ('jordan', 'lebanon', 'palestine', 'syria') THEN 'levant' ELSE 'gulf' END AS region, sum(e.value) AS mass FROM x GROUP BY ALL) SELECT ord, arg_max(region, mass * 1000 - ascii(region)) AS top, max(mass)::BIGINT AS mass FROM g GROUP BY ord")
def report_a54_mass_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """Label mass summed over regions; ties go to the first region by name."""
    x = table(spark, sf, "quality_rows").filter("labels is not null").select("ord", F.explode("labels").alias("d", "p"))
    region = F.when(F.col("d").isin("egypt", "sudan"), "nile").when(F.col("d").isin("algeria", "libya", "morocco", "tunisia"), "maghreb").when(F.col("d").isin("jordan", "lebanon", "palestine", "syria"), "levant").otherwise("gulf")
    g = x.groupBy("ord", region.alias("region")).agg(F.sum("p").alias("mass"))
    return g.groupBy("ord").agg(F.max_by("region", F.struct("mass", -F.ascii("region"))).alias("top"), F.max("mass").alias("mass"))


@r.query(f"SELECT generator, count(*) AS n, count_if(new_tokens >= sampling.max_new_tokens) AS cap_hits, count_if(regexp_matches(raw_output, '{P.FOREIGN_SCRIPT}')) AS is_foreign, count_if(regexp_matches(raw_output, '{P.PRESENTATION}')) AS presentation, round(avg(new_tokens), 6) AS mean_tokens FROM synthetic GROUP BY generator")
def report_a57_generators(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "synthetic")
    return s.groupBy("generator").agg(F.count("*").alias("n"), F.count_if(F.col("new_tokens") >= F.col("sampling.max_new_tokens")).alias("cap_hits"), F.count_if(F.col("raw_output").rlike(P.FOREIGN_SCRIPT)).alias("is_foreign"), F.count_if(F.col("raw_output").rlike(P.PRESENTATION)).alias("presentation"), F.round(F.avg("new_tokens"), 6).alias("mean_tokens"))


@r.query(f"""WITH p AS (SELECT DISTINCT text FROM eval_items WHERE text IS NOT NULL) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN q.text IS NULL THEN 'no text' WHEN len({_tok('q.text')}) < 5 THEN 'short' WHEN q.label IS NULL THEN 'no label' ELSE 'not chosen' END AS reason FROM quality_rows q LEFT JOIN p ON p.text = q.text WHERE p.text IS NULL) GROUP BY reason""")
def report_a58_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    pool = table(spark, sf, "eval_items").select("text").filter("text is not null").distinct()
    rows = table(spark, sf, "quality_rows").select("text", "label").join(pool, "text", "left_anti")
    reason = F.when(F.col("text").isNull(), "no text").when(F.size(X.tokenize("text")) < 5, "short").when(F.col("label").isNull(), "no label").otherwise("not chosen")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@r.query("WITH g AS (SELECT d.dataset, l.label, s.split FROM (SELECT DISTINCT dataset FROM quality_rows) d, (SELECT DISTINCT label FROM quality_rows WHERE label IS NOT NULL) l, (VALUES ('train'), ('dev'), ('test')) s(split)), n AS (SELECT dataset, label, split, count(*) AS n, avg(cardinality) AS c FROM quality_rows GROUP BY ALL) SELECT dataset, label, split, coalesce(n, 0) AS n, round(c, 6) AS mean_cardinality FROM g LEFT JOIN n USING (dataset, label, split)")
def report_a59_split_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Each dataset and label with each split, those without rows too; the grid is one of names, made after the rows are counted."""
    n = table(spark, sf, "quality_rows").groupBy("dataset", "label", "split").agg(F.count("*").alias("n"), F.avg("cardinality").alias("c"))
    labels = n.filter("label is not null").agg(F.collect_set("label").alias("labels"))
    grid = n.select("dataset").distinct().crossJoin(F.broadcast(labels)).select("dataset", F.explode("labels").alias("label"))  # one row with all labels
    grid = grid.withColumn("split", F.explode(F.array(*map(F.lit, ("train", "dev", "test")))))
    return grid.join(n, ["dataset", "label", "split"], "left").select("dataset", "label", "split", F.coalesce("n", F.lit(0)).alias("n"), F.round("c", 6).alias("mean_cardinality"))


@r.query(f"""WITH t AS (SELECT ord, {_CWORDS} AS w FROM tweets WHERE text IS NOT NULL), h AS (SELECT t.ord, c.id, list_filter(range(1, len(w) - len(toks) + 2), lambda i: w[i:i + len(toks) - 1] = toks AND (position <> 'medial' OR (i - 1 >= 2 AND len(w) - i - len(toks) + 1 >= 2)) AND (position <> 'any' OR len(w) - len(toks) >= 4)) AS pos FROM t JOIN {_LEXICON} ON list_contains(t.w, c.toks[1])),
n AS (SELECT id, count(*) AS n FROM h WHERE len(pos) > 0 GROUP BY id) SELECT c.id, array_to_string(toks, ' ') AS words, pattern, coalesce(n, 0) AS n_hits, row_number() OVER (ORDER BY coalesce(n, 0) DESC, c.id) AS place FROM {_LEXICON} LEFT JOIN n ON n.id = c.id""")
def report_a40_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of every entry: the first fifteen places are the report's top, entries with none were never found."""
    return codemix.connective_hits(codemix.find_connectives(table(spark, sf, "tweets").filter("text is not null")), codemix.lexicon())


@r.query("WITH w AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) SELECT b.event_type AS condition, count(*) AS n, count_if(b.m > a.m) AS better, count_if(b.m < a.m) AS worse, round(avg(b.m - a.m), 6) AS delta FROM w a JOIN w b USING (user_id) WHERE a.event_type = (SELECT min(event_type) FROM events) AND b.event_type <> a.event_type GROUP BY b.event_type")
def report_j15_paired(spark: SparkSession, sf: str) -> DataFrame:
    """Each condition against the first one by name, over what both have."""
    w = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    base = w.agg(F.min("event_type").alias("base"))
    w = w.join(F.broadcast(base))  # one row
    a = w.filter("event_type = base").select("user_id", F.col("m").alias("ma"))
    b = w.filter("event_type <> base").join(a, "user_id")
    return b.groupBy(F.col("event_type").alias("condition")).agg(F.count("*").alias("n"), F.count_if(F.col("m") > F.col("ma")).alias("better"), F.count_if(F.col("m") < F.col("ma")).alias("worse"), F.round(F.avg(F.col("m") - F.col("ma")), 6).alias("delta"))


@r.query("WITH c AS (SELECT user_id, event_type, event_id % 4 AS half, avg(value) AS m FROM events GROUP BY ALL), u AS (SELECT event_type, half, avg(m) AS m FROM c GROUP BY ALL) SELECT event_type, round(avg(m), 6) AS mean_of_means, count(*) AS cells FROM u GROUP BY event_type")
def report_a26_mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels of means, kept apart: never a pooled one."""
    c = table(spark, sf, "events").groupBy("user_id", "event_type", (F.col("event_id") % 4).alias("half")).agg(F.avg("value").alias("m"))
    u = c.groupBy("event_type", "half").agg(F.avg("m").alias("m"))
    return u.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count("*").alias("cells"))


_ERR = "e AS (SELECT a.ord, a.generator, a.condition, a.sentiment AS gold, b.sentiment AS pred FROM synthetic a JOIN synthetic b ON b.ord = a.ord + 5 WHERE a.sentiment IS NOT NULL AND b.sentiment IS NOT NULL)"


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "synthetic").filter("sentiment is not null").select("ord", "generator", "condition", "sentiment")
    other = s.select((F.col("ord") - 5).alias("ord"), F.col("sentiment").alias("pred"))
    return s.withColumnRenamed("sentiment", "gold").join(other, "ord")


@r.query(f"WITH {_ERR} SELECT coalesce(generator, '(all)') AS generator, coalesce(gold, '(all)') AS gold, count(*) AS n, count_if(gold <> pred) AS wrong, round(count_if(gold <> pred) / count(*), 6) AS rate FROM (SELECT generator, gold AS g, pred, gold FROM e) GROUP BY GROUPING SETS ((generator, gold), (generator), ())".replace("count_if(gold <> pred)", "count_if(g <> pred)"))
def report_a29_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    e = _errors(spark, sf).groupBy("generator", "gold").agg(F.count("*").alias("n"), F.count_if(F.col("gold") != F.col("pred")).alias("wrong"))
    out = e.rollup("generator", "gold").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"))
    return out.select(F.coalesce("generator", F.lit("(all)")).alias("generator"), F.coalesce("gold", F.lit("(all)")).alias("gold"), "n", "wrong", F.round(F.col("wrong") / F.col("n"), 6).alias("rate"))


@r.query(f"WITH {_ERR}, c AS (SELECT gold, pred, count(*) AS n FROM e GROUP BY ALL) SELECT gold, pred, n, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share FROM c")
def report_a32_destinations(spark: SparkSession, sf: str) -> DataFrame:
    c = _errors(spark, sf).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gold")), 6))


@r.query("WITH w AS (SELECT user_id, count_if(event_type = 'click') AS a, count_if(event_type = 'view') AS b FROM events GROUP BY user_id) SELECT CASE WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'fixed' WHEN b > 0 THEN 'new' ELSE 'neither' END AS kind, count(*) AS n, sum(a - b)::BIGINT AS moved FROM w GROUP BY kind")
def report_a30_two_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    kind = F.when((F.col("a") > 0) & (F.col("b") > 0), "both").when(F.col("a") > 0, "fixed").when(F.col("b") > 0, "new").otherwise("neither")
    return w.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("a") - F.col("b")).alias("moved"))


@r.query("WITH k AS (SELECT ord, dataset, label, sha256(concat_ws('|', 's9', dataset, ord::VARCHAR)) AS h FROM quality_rows WHERE label IS NOT NULL), p AS (SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY dataset ORDER BY h, ord) AS rn FROM k) WHERE rn <= 10), e AS (SELECT ord FROM quality_rows WHERE label <> label2 AND n_label_rows >= 3), u AS (SELECT ord FROM p UNION SELECT ord FROM e) SELECT u.ord, row_number() OVER (ORDER BY sha256(concat_ws('|', 's9', u.ord::VARCHAR)), u.ord) AS item, p.ord IS NOT NULL AS sampled, e.ord IS NOT NULL AS disputed FROM u LEFT JOIN p ON p.ord = u.ord LEFT JOIN e ON e.ord = u.ord")
def report_w17_relabel_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of sampled and disputed rows in blind order, with the key of what each is."""
    q = table(spark, sf, "quality_rows")
    p = S.cap_groups(q.filter("label is not null").select("ord", "dataset"), ["dataset"], "ord", 10, "s9").select("ord", F.lit(True).alias("sampled"))
    e = q.filter("label <> label2 and n_label_rows >= 3").select("ord", F.lit(True).alias("disputed"))
    u = p.join(e, "ord", "full").select("ord", F.coalesce("sampled", F.lit(False)).alias("sampled"), F.coalesce("disputed", F.lit(False)).alias("disputed")).withColumn("_all", F.lit(1))
    return S.ranked(u, ["_all"], S.hash_order("s9", F.col("ord").cast("string")), "ord", "item").select("ord", "item", "sampled", "disputed")


@r.query(f"WITH {_U}, {_SUM}, k AS (SELECT u.vec_id, u.label, row_number() OVER (PARTITION BY u.label ORDER BY round(list_dot_product(v, c), 9) DESC, vec_id) AS rn FROM u JOIN cc ON cc.label = u.label) SELECT vec_id, label, rn FROM k WHERE rn <= 3")
def report_t03_closest_to_centre(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    c = semantic.centroids(v, "label").select(F.col("label").alias("l"), "centre")
    rows = semantic.normalised(v).join(F.broadcast(c), F.col("label") == F.col("l"))
    s = rows.select("vec_id", "label", F.round(semantic.dot(F.col("embedding"), F.col("centre")), 9).alias("s"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))).filter("rn <= 3").select("vec_id", "label", "rn")


@r.query(f"WITH {_U}, {_SUM}, p AS (SELECT a.label AS a, b.label AS b, list_dot_product(a.c, b.c) AS s FROM cc a JOIN cc b ON a.label <> b.label), k AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rank FROM p) SELECT a, b, rank, round(s, 6) AS similarity FROM k WHERE rank <= 3")
def report_w09_nearest_centres(spark: SparkSession, sf: str) -> DataFrame:
    c = semantic.centroids(table(spark, sf, "embeddings"), "label").select("label", "centre")
    p = c.toDF("a", "ca").join(F.broadcast(c.toDF("b", "cb")), F.col("a") != F.col("b")).select("a", "b", semantic.dot(F.col("ca"), F.col("cb")).alias("s"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("s", 9)), "b"))).filter("rank <= 3").select("a", "b", "rank", F.round("s", 6).alias("similarity"))


@r.query(f"WITH {_U}, {_SUM}, n AS (SELECT u.vec_id, arg_max(cc.label, round(list_dot_product(v, c), 12)) AS cl FROM u, cc GROUP BY u.vec_id), sm AS (SELECT seed, vec_id, row_number() OVER (PARTITION BY seed ORDER BY sha256(concat_ws('|', seed::VARCHAR, vec_id::VARCHAR)), vec_id) AS rn FROM u, (SELECT unnest(range(5)) AS seed)), x AS (SELECT seed, cl, count(*) AS k FROM sm JOIN n USING (vec_id) WHERE rn <= 200 GROUP BY ALL), e AS (SELECT seed, exp(-sum(k / 200 * ln(k / 200))) AS eff FROM x GROUP BY seed) SELECT round(avg(eff), 6) AS mean, round(stddev_pop(eff), 6) AS std, count(*) AS n_seeds FROM e")
def report_m05_topic_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Effective number of topics over samples of 200, mean and population deviation over seeds."""
    v = table(spark, sf, "embeddings")
    near = semantic.nearest_centre(v, semantic.centroids(v, "label"), "vec_id", "label").select("vec_id", F.col("label").alias("cl"))
    rows = near.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    s = S.ranked(rows, ["seed"], F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("vec_id").cast("string")), 256), "vec_id").filter("rn <= 200")
    return metrics.effective_number(s, ["seed"], "cl").agg(F.round(F.avg("effective"), 6).alias("mean"), F.round(F.stddev_pop("effective"), 6).alias("std"), F.count("*").alias("n_seeds"))


@r.query(f"WITH {_U}, {_SUM}, n AS (SELECT u.vec_id, arg_max(cc.label, round(list_dot_product(v, c), 12)) AS cl FROM u, cc GROUP BY u.vec_id), sm AS (SELECT seed, vec_id, row_number() OVER (PARTITION BY seed ORDER BY sha256(concat_ws('|', seed::VARCHAR, vec_id::VARCHAR)), vec_id) AS rn FROM u, (SELECT unnest(range(10)) AS seed)), x AS (SELECT seed, cl, count(*) AS k FROM sm JOIN n USING (vec_id) WHERE rn <= 800 GROUP BY ALL), e AS (SELECT seed, exp(-sum(k / t * ln(k / t))) AS eff FROM (SELECT *, sum(k) OVER (PARTITION BY seed) AS t FROM x) GROUP BY seed), m AS (SELECT avg(eff) AS mean, stddev_pop(eff) AS std, count(*) AS n_seeds FROM e), g AS (SELECT cl AS topic, count(*) AS n FROM n GROUP BY cl) SELECT topic, n, round(n / sum(n) OVER (), 6) AS share, round(mean, 6) AS mean, round(std, 6) AS std, n_seeds FROM g, m")
def report_m05_topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each topic and the effective number of topics over ten samples of 800; all topics have a name here."""
    v = table(spark, sf, "embeddings")
    near = semantic.nearest_centre(v, semantic.centroids(v, "label"), "vec_id", "label").select("vec_id", F.col("label").alias("cl"))
    return topic_spread(near)


def topic_spread(near: DataFrame, sample: int = 800, repeats: int = 10) -> DataFrame:
    """(topic, n, share, mean, std, n_seeds) of (vec_id, cl): shares over all rows, effective number over samples of ``sample`` rows or all."""
    rows = near.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    s = S.ranked(rows, ["seed"], F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("vec_id").cast("string")), 256), "vec_id").filter(F.col("rn") <= sample)
    spread = metrics.effective_number(s, ["seed"], "cl").agg(F.round(F.avg("effective"), 6).alias("mean"), F.round(F.stddev_pop("effective"), 6).alias("std"), F.count("*").alias("n_seeds"))
    g = near.groupBy(F.col("cl").alias("topic")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(spread)).select("topic", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "mean", "std", "n_seeds")


@r.query(f"WITH {_U}, f AS (SELECT vec_id, label, v, (row_number() OVER (ORDER BY sha256(concat_ws('|', 's10', vec_id::VARCHAR)), vec_id) - 1) % 3 AS fold FROM u), l AS (SELECT g.fold, f.label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM f JOIN (SELECT unnest(range(3)) AS fold) g ON g.fold <> f.fold), s AS (SELECT fold, label, d, sum(x) AS s FROM l GROUP BY ALL), c AS (SELECT fold, label, list(s ORDER BY d) AS s FROM s GROUP BY ALL), cc AS (SELECT fold, label, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c FROM c), p AS (SELECT f.fold, f.vec_id, any_value(f.label) AS gold, arg_max(cc.label, round(list_dot_product(v, c), 12)) AS pred FROM f JOIN cc ON cc.fold = f.fold GROUP BY f.fold, f.vec_id) SELECT fold, count(*) AS n, round(count_if(gold = pred) / count(*), 6) AS accuracy FROM p GROUP BY fold")
def report_m14_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated: the vectors of a fold go to the nearest class centre of the other folds."""
    v = S.folds(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "vec_id", 3, "s10")
    out = None
    for k in range(3):
        test, train = v.filter(F.col("fold") == k), v.filter(F.col("fold") != k)
        pred = semantic.nearest_centre(test, semantic.centroids(train, "label"), "vec_id", "label").select("vec_id", F.col("label").alias("pred"))
        one = test.select("vec_id", F.col("label").alias("gold")).join(pred, "vec_id").select(F.lit(k).alias("fold"), "gold", "pred")
        out = one if out is None else out.unionAll(one)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("gold") == F.col("pred")) / F.count("*"), 6).alias("accuracy"))


@r.query("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY k), j AS (SELECT c_mktsegment AS segment, coalesce(n, 0) AS n FROM customer LEFT JOIN a ON k = c_custkey) SELECT coalesce(segment, 'unassigned') AS segment, count(*) AS customers, sum(n)::BIGINT AS orders, count_if(n = 0) AS without FROM j GROUP BY segment")
def report_j13_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A left join to a registry with a default, its counts made before the join."""
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    j = table(spark, sf, "customer").select("c_custkey", F.coalesce("c_mktsegment", F.lit("unassigned")).alias("segment")).join(a, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.groupBy("segment").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.count_if(F.col("n") == 0).alias("without"))


@r.query("WITH n AS (SELECT dataset, label, count(*) AS n FROM quality_rows WHERE label IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, label) AS rn FROM n), t AS (SELECT dataset, list(label) AS top FROM k WHERE rn <= 5 GROUP BY dataset) SELECT a.dataset AS a, b.dataset AS b, round(len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top))), 6) AS jaccard FROM t a JOIN t b ON a.dataset < b.dataset")
def report_s06_top_list_overlap(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "quality_rows").filter("label is not null").groupBy("dataset", "label").agg(F.count("*").alias("n"))
    k = n.withColumn("rn", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "label"))).filter("rn <= 5")
    t = k.groupBy("dataset").agg(F.collect_set("label").alias("top"))
    both = t.toDF("a", "ta").join(F.broadcast(t.toDF("b", "tb")), F.col("a") < F.col("b"))
    return both.select("a", "b", F.round(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")), 6).alias("jaccard"))


@r.query("WITH s AS (SELECT event_type, user_id % 7 AS layer, avg((value > 50)::INT) AS share, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT event_type, share AS base FROM s WHERE layer = 0) SELECT event_type, layer, round(share, 6) AS share, round(share - base, 6) AS gain, round(share - base - 1.645::DOUBLE * sqrt(share * (1 - share) / n), 6) AS lower95 FROM s JOIN b USING (event_type) WHERE layer > 0")
def report_a42_layer_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 7).alias("layer")).agg(F.avg((F.col("value") > 50).cast("int")).alias("share"), F.count("*").alias("n"))
    b = s.filter("layer = 0").select("event_type", F.col("share").alias("base"))
    gain = F.col("share") - F.col("base")
    return s.filter("layer > 0").join(F.broadcast(b), "event_type").select("event_type", "layer", F.round("share", 6).alias("share"), F.round(gain, 6).alias("gain"), F.round(gain - 1.645 * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n")), 6).alias("lower95"))

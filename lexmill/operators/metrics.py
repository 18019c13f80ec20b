"""Classification, agreement and distribution measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators import ranks


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_scores(df: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., class, support, predicted, precision, recall, f1), from the confusion counts alone."""
    by = by or []
    n = df.filter(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, gold, pred).agg(F.count("*").alias("n"))
    long = n.select(*by, F.explode(F.array(F.struct(F.col(gold).alias("c"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("x"), F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0).alias("hit"))
    s = long.groupBy(*by, F.col("x.c").alias("class")).agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("tp"))
    p, q = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return s.select(*by, "class", "support", "predicted", p.alias("precision"), q.alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "tp")


def overall_scores(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, accuracy, macro_f1, macro_f1_gold, f1_pn): macro over all classes and over those in gold; F1-PN over POS and NEG."""
    out = per_class.groupBy(*(by or [])).agg(
        F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_gold"),
        (F.sum(F.when(F.col("class").isin("POS", "NEG"), F.col("f1")).otherwise(0.0)) / 2).alias("f1_pn"),
    )
    return out


def cohens_kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, kappa) of two labellers where both labelled; 1 where both always give one and the same label."""
    by = by or []
    n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    same = n.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("k"))
    side = n.select(*by, F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).alias("nb")).unionAll(n.select(*by, F.col("b").alias("c"), F.lit(0), F.col("n")))
    m = side.groupBy(*by, "c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    both = same.join(m, by) if by else same.crossJoin(F.broadcast(m))  # one row each
    po, pe = F.col("k") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return both.select(*by, "n", F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def multilabel_scores(df: DataFrame, gold: dict[str, Column], pred: dict[str, Column]) -> DataFrame:
    """(label, precision, recall, f1, accuracy) of 0/1 labels, in one pass; nulls aren't counted."""
    g = lambda k: [F.sum((gold[k] * pred[k]).cast("long")).alias(f"{k}_tp"), F.sum(gold[k].cast("long")).alias(f"{k}_g"), F.sum(pred[k].cast("long")).alias(f"{k}_p"), F.count_if(gold[k] == pred[k]).alias(f"{k}_ok"), F.count(gold[k] + pred[k]).alias(f"{k}_n")]
    one = df.agg(*[x for k in gold for x in g(k)])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), *[F.coalesce(F.col(f"{k}_{s}"), F.lit(0)).alias(s) for s in ("tp", "g", "p", "ok", "n")]) for k in gold])).alias("x")).select("x.*")
    return rows.select("label", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"), ratio(2 * F.col("tp"), F.col("g") + F.col("p")).alias("f1"), ratio(F.col("ok"), F.col("n")).alias("accuracy"), "tp", "g", "p")


def multilabel_averages(scores: DataFrame) -> DataFrame:
    """One row of ``multilabel_scores``: precision, recall and F1 as means over labels (macro) and of pooled counts (micro)."""
    pooled = {"micro_precision": ratio(F.sum("tp"), F.sum("p")), "micro_recall": ratio(F.sum("tp"), F.sum("g")), "micro_f1": ratio(2 * F.sum("tp"), F.sum("g") + F.sum("p"))}
    return scores.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[c.alias(n) for n, c in pooled.items()])


def mean_of_means(df: DataFrame, by: list[str], levels: list[str], value: Column) -> DataFrame:
    """(by..., n, mean): means of ``value`` in the cells of all levels, then over each level from the last to the first; ``n`` counts the first level's."""
    out = df.groupBy(*by, *levels).agg(F.avg(value).alias("mean"))
    for k in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*by, *levels[:k]).agg(F.avg("mean").alias("mean"))
    return out.groupBy(*by).agg(F.count("*").alias("n"), F.avg("mean").alias("mean"))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """``df`` with ranks that tied values share; ranks come from running counts of the values in many tasks, so a group needs no sorted list of its own."""
    by = by or []
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    n = ranks.running(n, by, [F.col(value)], {"_before": F.col("_n")}).withColumn(rank, F.col("_before") + (F.col("_n") + 1) / 2)
    return df.join(n.select(*by, value, rank), [*by, value])


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., n_pos, n_neg, auc) by Mann-Whitney; null where a side is empty."""
    by = by or []
    r = average_ranks(df.select(*by, score, positive.alias("_pos")), score, by)
    g = r.groupBy(*by).agg(F.count_if("_pos").alias("n_pos"), F.count_if(~F.col("_pos")).alias("n_neg"), F.sum(F.when(F.col("_pos"), F.col("rank"))).alias("s"))
    p, n = F.col("n_pos"), F.col("n_neg")
    return g.select(*by, "n_pos", "n_neg", F.when((p > 0) & (n > 0), (F.col("s") - p * (p + 1) / 2) / (p * n)).alias("auc"))


def stratified_auc(df: DataFrame, score: str, positive: Column, stratum: str) -> DataFrame:
    """One row (n_strata, n, auc): the strata's areas weighted by their sizes; strata without both sides are left out."""
    per = auc(df, score, positive, [stratum]).filter("auc is not null").withColumn("n", F.col("n_pos") + F.col("n_neg"))
    return per.agg(F.count("*").alias("n_strata"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("auc")) / F.sum("n")).alias("auc"))


def average_precision(df: DataFrame, score: str, relevant: Column, ident: str, by: str) -> DataFrame:
    """(by, ap): the mean precision at the relevant rows in falling order of score, ties by ``ident``; null where none is relevant."""
    rows = df.filter(F.col(score).isNotNull()).select(by, score, ident, F.coalesce(relevant, F.lit(False)).alias("_rel"))
    k = ranks.running(rows, [by], [F.desc(score), F.col(ident)], {"rn": F.lit(1), "c": F.col("_rel").cast("int")})
    return k.groupBy(by).agg((F.sum(F.when(F.col("_rel"), (F.col("c") + 1) / (F.col("rn") + 1))) / F.count_if("_rel")).alias("ap"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the Pearson and Spearman correlations of two columns."""
    rows = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_ranks(average_ranks(rows, a, rank="_ra"), b, rank="_rb")
    return r.agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def effective_number(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by..., n_labels, effective): the exponential of the entropy of label counts."""
    n = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.count("*").alias("n_labels"), F.exp(F.ln(F.sum("n").cast("double")) - F.sum(F.col("n") * F.ln(F.col("n").cast("double"))) / F.sum("n")).alias("effective"))


def js_divergence(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """One row: the Jensen-Shannon divergence, in bits, of the label counts of two tables."""
    count = lambda d, n: d.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias(n))
    w = Window.partitionBy()
    both = count(a, "x").join(count(b, "y"), label, "full").na.fill(0)
    both = both.select((F.col("x") / F.sum("x").over(w)).alias("p"), (F.col("y") / F.sum("y").over(w)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.agg((F.sum(part("p") + part("q")) / 2).alias("js"))


def cohens_d(df: DataFrame, value: str, side: Column) -> DataFrame:
    """One row: the difference of two means over their pooled deviation; 0 where that is 0."""
    s = df.agg(*[f(F.when(c, F.col(value))).alias(n) for n, f, c in (("m1", F.avg, side), ("m0", F.avg, ~side), ("v1", F.var_samp, side), ("v0", F.var_samp, ~side), ("n1", F.count, side), ("n0", F.count, ~side))])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select("n1", "n0", ratio(F.col("m1") - F.col("m0"), pooled).alias("d"))


def sign_test(wins: Column, losses: Column) -> Column:
    """The two-sided exact binomial probability of as uneven a result, for any number of comparisons; ties are left out before."""
    n, k = (wins + losses).cast("double"), F.least(wins, losses).cast("int")
    start = F.struct(F.lit(0.0).alias("l"), F.exp(-n * F.ln(F.lit(2.0))).alias("s"))
    ways = lambda a, i: a["l"] + F.ln((n - i + 1) / i)  # noqa: E731 - the logarithm of n over i, from that of n over i - 1
    step = lambda a, i: F.struct(ways(a, i).alias("l"), (a["s"] + F.exp(ways(a, i) - n * F.ln(F.lit(2.0)))).alias("s"))
    below = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).when(n > 0, F.least(F.lit(1.0), 2 * F.aggregate(below, start, step)["s"]))


def best_threshold(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: the score at which calling all from there on positive has the best balanced accuracy; the lowest on ties."""
    n = df.groupBy(F.col(score).alias("t")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    s = ranks.running(n.filter("t is not null"), [], [F.col("t")], {"bp": F.col("p"), "bq": F.col("q")})
    s = s.select("t", (F.col("bp_all") - F.col("bp")).alias("tp"), F.col("bq").alias("tn"), F.col("bp_all").alias("np"), F.col("bq_all").alias("nq"))
    s = s.withColumn("acc", (ratio(F.col("tp"), F.col("np")) + ratio(F.col("tn"), F.col("nq"))) / 2)
    return s.agg(F.max("acc").alias("balanced_accuracy"), F.max(F.struct(F.round("acc", 12).alias("a"), (-F.col("t")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("threshold"), "balanced_accuracy")

"""The operators outside the training-data package on literal fixtures."""

import math
import random
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import session
from lexmill.functions import text as X
from lexmill.operators import codemix, corpus, dedup, lexical, metrics, runs, scorer, select, semantic
from lexmill.sources import readers, sinks
from lexmill.streaming import curation


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ('"""x \\"" y"""', 'x " y'), ('"', '"'), ("plain", "plain"), ('"a ""b"" c"', 'a "b" c'), ('""', ""), (None, None),
])
def test_unescape(spark, raw, want):
    assert one(spark, X.unescape_text("t")[0], raw) == want


@pytest.mark.parametrize("raw, want", [
    ("كذاpic.twitter.com/x", "كذا URL"), ("نص http t", "نص URL"), ("a  b", "a b"), ("@user_1: hi", "USER : hi"), ("", ""), (None, None),
])
def test_clean(spark, raw, want):
    assert one(spark, X.clean_text("t")[0], raw) == want
    assert one(spark, X.clean_text("t", ())[0], "a  b") == "a  b"


def test_white_space(spark):
    assert one(spark, X.tokenize("t"), "a b\u001cc d  e") == list("abcde")
    assert one(spark, X.dedup_key("t"), " A  B ") == "a b"


def test_parsers(spark):
    raw = "Here is the tweet:\n1. «نص أول»\n(translation)\nالتغريدة: نص ثان"
    assert one(spark, X.parse_output("t", 2), raw) == ["نص أول", "نص ثان"]
    assert one(spark, X.parse_output("t", 2, "arabizi"), "ana kwayes\nنص") == ["ana kwayes"]
    pair = "**A:** نص أ\nB) نص ب\nA: آخر"
    assert one(spark, X.parse_pair("t"), pair) == {"A": "نص أ", "B": "نص ب"}
    assert one(spark, X.strip_translation("t")[0], "نص جميل (this is a nice text)") == "نص جميل"
    assert one(spark, X.strip_translation("t")[0], "this is all latin text") == "this is all latin text"


def test_code_mixing(spark):
    got = {r.t: r for r in X.code_mixing(spark.createDataFrame([("123",), ("",), ("نص word نص",), (None,)], "t string"), "t").collect()}
    assert got["123"].cmi == 0.0 and got[""].switch_points == 0
    assert round(got["نص word نص"].cmi, 1) == 33.3 and got["نص word نص"].switch_point_fraction == 1.0 and len(got) == 4
    assert one(spark, X.arabic_bin("t"), "ن" * 19 + "a") == 10 and one(spark, X.arabic_bin("t"), "12") is None


def test_connectives(spark):
    df = spark.createDataFrame([(1, "كتب نص لكن قرأ آخر", "x"), (2, "لكن قرأ آخر", "x"), (3, None, "x")], "ord long, text string, id string")
    assert [(r.ord, r.id, r.start) for r in codemix.find_connectives(df).collect()] == [(1, "lakin_ar", 2)]


def test_lexicon(spark):
    entries = codemix.lexicon("a | not only | english | contrast | any | but\nb | لو كان | arabic | counterfactual | any")
    df = spark.createDataFrame([(1, "not only this one but that one"), (2, "not only this one and that one"), (3, "قال لو كان هنا اليوم معنا")], "ord long, text string")
    found = codemix.find_connectives(df, entries=entries)
    assert sorted((r.ord, r.id, r.script, r.start, r.stop) for r in found.collect()) == [(1, "a", "english", 0, 2), (3, "b", "arabic", 1, 3)]
    assert [(r.id, r.n_hits) for r in codemix.connective_hits(found.filter("ord = 1"), entries).orderBy("place").collect()] == [("a", 1), ("b", 0)]
    with pytest.raises(ValueError, match="twice"):
        codemix.lexicon("a | x | e | p | any\na | y | e | p | any")


@pytest.mark.parametrize("text, want", [("#abc_d x_y", "abc d x_y"), ("ab#", "ab#"), ("# a", "# a"), ("x#a_b#c_d", "xa b#c d"), ("##a", "#a"), ("هههههه", "هه"), (None, None)])
def test_topic_text(spark, text, want):
    assert one(spark, X.clean_for_topics("t"), text) == want


def test_keyword_types(spark):
    data = [("خبر عن غارات URL", "iraq"), ("انا سمعت عن غارة URL", "egypt"), ("يحتفل الفريق URL", "msa"), ("كلام قصير", "gulf"), ("كلام قصير", "iraq"), ("#ام_كلثوم ❤", "msa"), (None, "gulf")]
    got = [r.k for r in spark.createDataFrame(data, "t string, d string").select(X.keyword_types("t", "d").alias("k")).collect()]
    assert got == [["news_bad"], ["other"], ["news_good"], ["short_dialect"], ["other"], ["lyric", "fan_post"], None]


def test_check_counts(spark):
    df = spark.createDataFrame([(True, False, "g"), (False, False, None), (True, True, "g")], "a boolean, b boolean, d string")
    got = {(r.measure, r.name): r.n for r in dedup.check_counts(dedup.run_checks(df, {"a": F.col("a"), "b": F.col("b")}), ["a", "b"], "d").collect()}
    assert got == {("failed", "a"): 1, ("failed", "b"): 2, ("rejected_by", "a"): 1, ("rejected_by", "b"): 1, ("kept_of", "g"): 1, ("rejected_of", "g"): 1, ("rejected_of", ""): 1}
    empty = dedup.check_counts(dedup.run_checks(df.limit(0), {"a": F.col("a")}), ["a"], "d").collect()
    assert [(r.measure, r.n) for r in empty] == [("failed", 0), ("rejected_by", 0)]


def test_one_group_is_ranked_in_many_tasks(spark):
    from lexmill.operators import ranks

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as large groups would be, these are in several parts
    df = spark.range(40_000).select(F.col("id"), F.lit("g").alias("g"), (F.col("id") * 7919 % 40_009).alias("v"))
    out = ranks.running(df, ["g"], [F.col("v"), F.col("id")], {"before": F.lit(1), "total": F.col("v")})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out.inputFiles()) == 4
    rows = sorted((r.v, r.before, r.total, r.before_all) for r in out.collect())
    assert [r[1] for r in rows] == list(range(40_000)) and rows[-1][3] == 40_000
    assert rows[100][2] == sum(r[0] for r in rows[:100])
    few = spark.createDataFrame([(g, i, 2) for g in ("a", None) for i in range(0, 20_000, 3)], "g string, at long, v long")
    got = sorted(((r.g or "", r.at, r.n) for r in ranks.totals_before(few, ["g"], "at", "v", "n").collect()))
    assert [n for _, _, n in got] == [2 * i for i in range(len(got) // 2)] * 2
    place = ranks.ranked(spark.range(5000).select("id", F.lit("x").alias("g")), ["g"], ranks.hash_spread(F.sha2(F.col("id").cast("string"), 256)), [F.col("id")])
    assert sorted(r.rank for r in place.collect()) == list(range(1, 5001))


@pytest.mark.parametrize("wins, losses", [(0, 0), (3, 1), (10, 10), (700, 800), (2000, 2200)])
def test_sign_test_of_any_size(spark, wins, losses):
    n, k = wins + losses, min(wins, losses)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert spark.range(1).select(metrics.sign_test(F.lit(wins), F.lit(losses)).alias("p")).first().p == pytest.approx(want, rel=1e-9)


def test_pairs_by_role(spark):
    data = [("p", "a", "x  y z", True, 1), ("p", "b", "x y  z", False, 2), ("p", "b", "other", True, 3), ("q", "a", "x", False, 4), ("q", None, "x", True, 5), ("r", "a", "one", None, 6), ("r", "b", "two", None, 7), ("s", "a", None, True, 8), ("s", "c", "x", True, 9)]
    df = spark.createDataFrame(data, "pair string, role string, text string, ok boolean, ord long")
    got = {r.pair: (r.n, r.complete, r.confirmed) for r in select.role_pairs(df, "pair", "role", ("a", "b"), F.col("ok")).collect()}
    assert got == {"p": (3, True, 2), "q": (2, False, 0), "r": (2, True, 0), "s": (2, False, 2)}
    assert [tuple(r) for r in select.equal_words(df, "pair", "role", ("a", "b"), "text", "ord").collect()] == [("p", 3)]
    assert select.role_pairs(df.limit(0), "pair", "role", ("a", "b"), F.col("ok")).count() == 0


def test_bag_union_keeps_repeats(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x")], "id long, t string"), spark.createDataFrame([(1, 0.5)], "id long, w double")
    assert sorted((r.origin, r.precedence, r.id, r.t or "", r.w or 0) for r in corpus.bag_union({"a": a, "b": b}).collect()) == [("a", 0, 1, "x", 0), ("a", 0, 1, "x", 0), ("b", 1, 1, "", 0.5)]


def test_direction_ends(spark):
    df = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)], int(i > 7)) for i in range(16)] + [(99, [0.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    d = semantic.direction(df, F.col("label") == 1, F.col("label") == 0)
    ends = semantic.direction_ends(df, d, 2).collect()
    assert [r.vec_id for r in ends if r.side == "bottom"] == [0, 1] and [r.vec_id for r in ends if r.side == "top"] == [15, 14]
    assert semantic.link_check(d, d).first().cosine == pytest.approx(1.0)


@pytest.mark.parametrize("text, want", [
    ("#سوووق الخير abcd1", True), ("#سوووق_الخير", True), ("#سوق_الخير abcd1", False), ("#كلنا_اااالدلماني", True), ("سوووق abcd1", False), ("#سوووق الخير abc", False), ("", False), (None, None),
])
def test_spam_hashtag(spark, text, want):
    from lexmill.functions import portable

    assert one(spark, F.col("t").rlike(portable.SPAM_HASHTAG), text) == want


def jaccard(a, b, n=5):
    s = lambda k: {k} if len(k) <= n else {k[i : i + n] for i in range(len(k) - n + 1)}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def near_brute(rows, threshold=0.8):
    out = {}
    keys = [(i, " ".join(t.split()).lower(), g) for i, t, g in rows if t and t.strip()]
    for p, (i, k, g) in enumerate(keys):
        best = max(((jaccard(k, k2), -j) for j, k2, g2 in keys[:p] if g is None or g != g2), default=(0, 0))
        if best[0] >= threshold:
            out[i] = (-best[1], round(best[0], 6))
    return out


@pytest.mark.parametrize("grouped", [False, True])
def test_near_duplicates(spark, grouped):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(4, 80))) for _ in range(12)]
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        rows.append((i, "".join(t), rng.choice([None, "g1", "g2"]) if grouped else None))
    rows += [(200, None, None), (201, "  ", None), (202, "", "g1")]
    df = spark.createDataFrame(rows, "i long, text string, g string")
    got = {r.i: (r.duplicate_of, round(r.jaccard, 6)) for r in dedup.near_duplicates_within(df, "text", "i", group="g" if grouped else None).collect()}
    assert got == near_brute(rows)
    if not grouped:
        lsh = {r.i for r in dedup.near_duplicates_within(df, "text", "i", mode="lsh").collect()}
        assert lsh <= set(got) and len(lsh) >= 0.9 * len(got)
    assert dedup.near_duplicates_within(df.limit(0), "text", "i").count() == 0


def test_near_duplicates_against(spark):
    a = spark.createDataFrame([(1, "hello wonderful world of texts"), (2, "other"), (3, None), (4, "Hello  wonderful world of texts!")], "i long, text string")
    b = spark.createDataFrame([(7, "hello wonderful world of texts"), (8, "hello wonderful world of texts")], "j long, text string")
    got = {r.i: (r.duplicate_of, round(r.jaccard, 2)) for r in dedup.near_duplicates_against(a, b, "text", "i", "text", "j").collect()}
    assert got[1] == (7, 1.0) and got[4][0] == 7 and set(got) == {1, 4}


def test_checks(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, False), (3, None, True)], "i long, a boolean, b boolean")
    got = {r.i: (r.rejected_by, r.failed_checks) for r in dedup.run_checks(df, {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {1: ("b", ["b"]), 2: ("a", ["a", "b"]), 3: (None, [])}


def test_vote_ties_are_valid(spark):
    from lexmill.functions.portable import DIALECTS

    posts = spark.createDataFrame([(1, "s", "p", "text", "egypt", None), (2, "s", "q", "text", "iraq", None)], "ord long, source string, id string, text string, country string, province string")
    rest = ", ".join(f"{d} int" for d in DIALECTS)
    zero = dict.fromkeys(DIALECTS, 0)
    labels = spark.createDataFrame([("s", "p", 0.2, *{**zero, "egypt": 1}.values()), ("s", "q", None, *zero.values()), ("s", "zz", 1.0, *zero.values())], f"nadi_source string, train_id string, aldi_score double, {rest}")
    r = corpus.build_records(labels, posts).first()
    assert r.labels["egypt"] == 1 and r.label_conflict and r.cardinality == 1 and r.countries == ["egypt", "iraq"] and r.n_label_rows == 2


def test_p95_is_a_floor_index(spark):
    df = spark.createDataFrame([(1, i) for i in range(1, 12)], "g int, v int")
    assert corpus.summarize_by_counts(df, ["g"], "v").first().p95 == 10
    assert df.groupBy("g").agg(*corpus.summarize(F.col("v"))).first().p95 == 10


def test_split_is_the_same_everywhere(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).cast("string").alias("s"))
    a = {r.id for r in select.stratified_split(df, ["s"], "id", 0.1, "x").filter("part = 'dev'").collect()}
    b = {r.id for r in select.stratified_split(df.repartition(7), ["s"], "id", 0.1, "x").filter("part = 'dev'").collect()}
    assert a == b and len(a) == 20 or len(a) == 21
    tiny = spark.range(5).select("id", F.lit("a").alias("s"))
    assert select.stratified_split(tiny, ["s"], "id", 0.1, "x").filter("part = 'dev'").count() == 0


def test_folds_keep_groups(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).alias("g"))
    f = select.folds(df, "id", 3, "s", "g").groupBy("g").agg(F.count_distinct("fold").alias("n"))
    assert f.filter("n > 1").count() == 0


def mtld_literal(tokens, t=0.72):
    def one(seq):
        factors, start = 0.0, 0
        for i in range(len(seq)):
            part = seq[start : i + 1]
            if len(set(part)) / len(part) <= t:
                factors, start = factors + 1, i + 1
        part = seq[start:]
        if part:
            r = len(set(part)) / len(part)
            factors += (1 - r) / (1 - t) if r < 1 else 0
        return len(seq) / factors if factors else len(seq)

    return (one(tokens) + one(tokens[::-1])) / 2 if len(tokens) > 1 else 0.0


def test_mtld():
    rng = random.Random(1)
    for _ in range(40):
        toks = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 60))]
        assert math.isclose(lexical.mtld_of(toks), mtld_literal(toks))
    assert lexical.mtld_of(["a"]) == 0.0 and lexical.mtld_of(list("abc")) == 3.0


def test_self_bleu_of_one_sentence(spark):
    df = spark.createDataFrame([("g", 1, ["a", "b"]), ("h", 1, ["a", "b", "c"]), ("h", 2, ["a", "b", "c"]), ("h", 3, [])], "g string, i long, w array<string>")
    got = {r.g: r.self_bleu for r in lexical.self_bleu(df, "g", "i", "w").collect()}
    assert got["g"] == 0.0 and got["h"] > 0.3


def test_classification(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), (None, "a")], "g string, p string")
    s = {r["class"]: r for r in metrics.class_scores(df, "g", "p").collect()}
    assert s["c"].f1 == 0 and s["b"].precision == 0 and s["a"].support == 2 and round(s["a"].f1, 3) == 0.5
    same = spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string")
    assert metrics.cohens_kappa(same, "a", "b").first().kappa == 1.0


def test_null_auc_is_a_half(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.random(), rng.random() < 0.5) for _ in range(4000)], "s double, p boolean")
    assert abs(metrics.auc(df, "s", F.col("p")).first().auc - 0.5) < 0.04


def test_vendi(spark):
    eye = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 2.0, 0.0],), ([0.0, 0.0, 3.0],)], "embedding array<double>")
    assert math.isclose(semantic.vendi_score(eye), 3.0)
    assert math.isclose(semantic.vendi_score(eye.limit(1)), 1.0) and semantic.vendi_score(eye.limit(0)) == 0.0


def test_nearest_ties_by_number(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, None)], "id long, embedding array<double>")
    got = [r.id for r in semantic.nearest(df, df.filter("id = 3"), "id", 2).orderBy("rank").collect()]
    assert got == [0, 1]


def test_scorer_scores_each_text_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None)], "id long, text string")

    def make():
        return lambda texts: [{"n": len(t)} for t in texts]

    assert sorted((r.id, r.n) for r in scorer.score(df, "id", "text", make, "n int").collect()) == [(1, 1), (2, 1), (3, 2)]
    e = spark.createDataFrame([(1, {"a": 0.6, "b": 0.4}), (1, {"a": 0.2, "b": 0.8})], "id long, probs map<string,double>")
    assert scorer.ensemble(e, "id", "probs").first().pred == "b"


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\ttext\tcountry\tprovince\n1\tsay "hi\tegypt\tp\n', encoding="utf-8")
    (tmp_path / "b.tsv").write_text("id\ttext\tcountry\n2\tx\tiraq\n", encoding="utf-8")
    rows = readers.read_posts(spark, {"a": str(tmp_path / "a.tsv"), "b": str(tmp_path / "b.tsv")}).collect()
    assert sorted((r.id, r.text, r.province, r.source) for r in rows) == [("1", 'say "hi', "p", "a"), ("2", "x", None, "b")]
    (tmp_path / "c.tsv").write_text("id\ttext\tcountry\tprovince\n1\tonly\n", encoding="utf-8")
    with pytest.raises(Exception, match="fewer than three"):
        readers.read_posts(spark, {"c": str(tmp_path / "c.tsv")}).count()
    (tmp_path / "w.tsv").write_text("sentence\tegypt\tiraq\nx\ty\tn\n", encoding="utf-8")
    assert sorted((r.dialect, r.valid) for r in readers.read_wide_labels(spark, str(tmp_path / "w.tsv")).collect()) == [("egypt", 1), ("iraq", 0)]
    (tmp_path / "s.csv").write_text("﻿text,sentiment,c\nhi,Positive,\n", encoding="utf-8")
    r = readers.read_sentiment(spark, str(tmp_path / "s.csv"), {"Positive": "POS"}, "text string, sentiment string, c double").first()
    assert r.sentiment == "POS" and math.isnan(r.c)
    (tmp_path / "bad.csv").write_text("text,sentiment,c\nhi,what,\n", encoding="utf-8")
    with pytest.raises(Exception, match="unknown label"):
        readers.read_sentiment(spark, str(tmp_path / "bad.csv"), {"Positive": "POS"}, "text string, sentiment string, c double").count()
    (tmp_path / "l.txt").write_bytes("NEG\tنص أ\n".encode("cp1256"))
    assert readers.read_lines(spark, str(tmp_path / "l.txt"), "windows-1256").first().text == "نص أ"
    (tmp_path / "x.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert readers.read_xml(spark, str(tmp_path / "x.xml"), "row", "a int").count() == 2


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>one</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    r = readers.read_xlsx(spark, str(tmp_path / "b.xlsx")).first()
    assert r.sheet == "S" and r.cells == ["one", "", "5", "in"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, t string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_jsonl(df, str(tmp_path / "j"))
    assert any('"t":null' in p.read_text() for p in (tmp_path / "j").glob("part*"))
    keep = lambda d: d
    assert sinks.append_missing(df.filter("id = 1"), str(tmp_path / "out"), "id", keep) == 1
    assert sinks.append_missing(df, str(tmp_path / "out"), "id", keep) == 1 and spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.write_decided(dedup.run_checks(df, {"t": F.col("t").isNotNull()}), str(tmp_path / "d"))
    assert Counter(r.status for r in spark.read.parquet(str(tmp_path / "d")).collect()) == {"kept": 1, "rejected": 1}
    assert sinks.markdown(df).startswith("| id | t |")


def test_run_logs(spark, tmp_path):
    for seed, f1 in ((1, 0.5), (2, 0.7)):
        d = tmp_path / f"m_seed{seed}"
        d.mkdir()
        (d / "log.json").write_text('{"seed": %d, "dev": {"macro_f1": %f, "accuracy": 1}, "test": {"macro_f1": 0.1, "accuracy": 1}}' % (seed, f1))
    (tmp_path / "m_limit50").mkdir()
    (tmp_path / "m_limit50" / "log.json").write_text('{"seed": 3}')
    board = runs.leaderboard(runs.read_runs(spark, str(tmp_path / "*" / "log.json")), spark.createDataFrame([], "run string, name string")).collect()
    assert [(r.run, r.n_seeds, round(r.dev, 6), r.name) for r in board] == [("m", 2, 0.6, "unassigned")] and round(board[0].dev_std, 4) == 0.1414
    pred, gold = spark.createDataFrame([(0, "a"), (5, "b")], "row_no long, pred string"), spark.createDataFrame([(0, "a")], "row_no long, gold string")
    with pytest.raises(Exception, match="without a gold row"):
        runs.aligned(pred, gold).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"text {i % 4}", "2024-01-01 00:00:0%d" % (i % 6)) for i in range(12)]
    spark.createDataFrame(rows, "ord long, text string, t string").selectExpr("ord", "text", "timestamp(t) AS loaded_at").repartition(3).write.parquet(str(tmp_path / "in"))
    s = curation.curated(curation.arriving(spark, str(tmp_path / "in"), "ord long, text string, loaded_at timestamp"))
    curation.run_to(s.select("key"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"text {i}" for i in range(4)]


def test_conflicts_at_later_places_count(spark):
    from lexmill.plans.dedup import conflict_free

    data = [(1, "POS", "a", ["x", "y http://a.example/1"]), (2, "NEG", "a", ["z", "x"]), (3, "POS", "b", ["y http://b.example/2"]), (4, "POS", "a", None), (5, None, "a", ["z", None])]
    df = spark.createDataFrame(data, "ord long, sentiment string, variety string, few_shot_texts array<string>")
    assert sorted(map(tuple, conflict_free(df).collect())) == [("y URL", 1, 2, True), ("z", 2, 2, False)]


def test_length_matched_means_equal_a_literal_version(spark):
    from collections import Counter
    from hashlib import sha256

    data = [("a", i, [f"w{(i * j) % 37}" for j in range(i % 9)]) for i in range(60)] + [("b", 1, ["x", "y"])]
    got = {r.dataset: r for r in lexical.length_matched_mean(spark.createDataFrame(data, "dataset string, ord long, w array<string>"), "dataset", "ord", "w", 50, 4).collect()}
    ttr, d2, hapax = [], [], []
    for seed in range(4):
        words, pairs = [], []
        for _, _, w in sorted((sha256(f"{seed}|a|{i}".encode()).hexdigest(), i, w) for g, i, w in data if g == "a"):
            w = w[: 50 - len(words)]
            words, pairs = words + w, pairs + list(zip(w, w[1:]))
        ttr, d2, hapax = [*ttr, len(set(words)) / 50], [*d2, len(set(pairs)) / len(pairs)], [*hapax, sum(c == 1 for c in Counter(words).values()) / 50]
    assert (got["a"].samples, got["b"].samples, got["b"].ttr, got["b"].tokens) == (4, 0, None, 2)
    assert [got["a"][k] for k in ("ttr", "distinct_2", "hapax")] == pytest.approx([sum(x) / 4 for x in (ttr, d2, hapax)])


def test_topic_spread_gives_shares_and_all_seeds(spark):
    from lexmill.plans.reports import topic_spread

    near = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "vec_id long, cl string")
    assert {(r.topic, r.n, r.share, r.std, r.n_seeds) for r in topic_spread(near).collect()} == {("a", 30, 0.75, 0.0, 10), ("b", 10, 0.25, 0.0, 10)}


def test_kmeans_starts_ten_times():
    import inspect

    assert inspect.signature(semantic.kmeans).parameters["tries"].default == 10


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95])
def test_similar_sets_have_an_equal_part(threshold):
    rng = np.random.default_rng(3)
    for size in [1, 2, 5, 17, 40, 120, 500, 3000] * 6:
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        drop = int(rng.integers(0, len(a) * (1 - threshold) + 1))
        add = int(rng.integers(0, max(0, (len(a) - drop) / threshold - len(a)) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(-(2**63), 2**63 - 1, add)]))
        if len(np.intersect1d(a, b)) < threshold * len(np.union1d(a, b)):
            continue
        parts = [{(w, p, s): odd[p // dedup.PARTS] for w, part, sign, odd in dedup.set_signatures(x, threshold) for p, s in zip(part, sign)} for x in (a, b)]
        most = {w: dedup._apart(len(a) + len(b), threshold) / groups for w, groups, _ in dedup.set_windows(len(a), threshold)}
        assert any(bin(int(parts[0][k] ^ parts[1][k])).count("1") <= most[k[0]] for k in parts[0].keys() & parts[1].keys())


def test_near_duplicates_move_no_texts(spark):
    """What is written to disk for texts without duplicates is a small part of what whole sets of shingles take, 8 bytes a character."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(600))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, text string")
    here = Path(session.checkpoint_dir(spark).removeprefix("file:"))
    before = set(here.iterdir())
    assert dedup.near_duplicates_within(df, "text", "i").count() == 0
    new = [p for d in set(here.iterdir()) - before for p in d.rglob("*.parquet")]
    assert new and sum(p.stat().st_size for p in new) < 400 * 600


@pytest.mark.parametrize("splits", [1, 100])
def test_pairs_are_the_same_in_many_tasks(spark, monkeypatch, splits):
    monkeypatch.setattr(dedup, "ROWS_TOGETHER", 90 // splits + 1)
    monkeypatch.setattr(dedup, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(dedup, "FEW", 5)
    rng = random.Random(9)
    rows = [(i, "abcdefgh ijklmnop qrstuvwx"[: 20 + i % 7] + rng.choice("xyz"), None) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, text string, g string")
    assert {r.i: (r.duplicate_of, round(r.jaccard, 6)) for r in dedup.near_duplicates_within(df, "text", "i").collect()} == near_brute(rows)


def test_checks_of_documents_move_no_texts(spark):
    from lexmill import plans

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("flow_a17_check_counts", "flow_n11_checks", "flow_filter_stats", "dedup_n08_measures"):
            plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "text#" not in plan, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_exact_duplicates_meet_by_digest(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, "b"), (5, None), (6, "")], "i long, k string")
    out = dedup.exact_duplicates(df, F.col("k"), "i")
    assert {r.i: r.duplicate_of for r in out.collect()} == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: None}
    assert "hashpartitioning(k#" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["flow_n11_checks", "flow_filter_stats"])
def test_signatures_of_a_million_documents_fit_the_disk(spark, monkeypatch, name):
    """Bytes a document as they are moved where the table has 1,100,000 of them; four times the input are 1,200 and more."""
    from lexmill import plans

    moved, real = [], dedup._signatures

    def at_a_million(rows, n, threshold, splits):
        out = real(rows, n, threshold, 1 + 1_100_000 // dedup.ROWS_TOGETHER)
        moved.append(out.agg(F.sum(sum(F.length(c) for c in ("ids", "sizes", "odd", "counts", "signs")))).first()[0])
        return out

    monkeypatch.setattr(dedup, "_signatures", at_a_million)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    plans.queries()[name](spark, "/root/testdata/sf0.01")
    assert len(moved) == 1 and 0 < moved[0] < 900 * docs


def test_copies_in_one_task_are_named_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.createDataFrame([(i % 7, f"text number {i % 7} that comes again and again") for i in range(90)], "id long, key string").coalesce(1)
        named, once = (Counter(i for r in dedup._signatures(x, 5, 0.8, 1).collect() for i in np.frombuffer(r.ids, dtype=np.int64)) for x in (rows, rows.dropDuplicates().coalesce(1)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert named == once and set(named) == set(range(7))


@pytest.mark.parametrize("at_once", [1, 50])
def test_pairs_are_the_same_in_slices(spark, monkeypatch, at_once):
    monkeypatch.setattr(dedup, "ENTRIES_AT_ONCE", at_once)
    monkeypatch.setattr(dedup, "KNOWN", 3)
    rng = random.Random(19)
    rows = [(i, "abcdefgh ijklmnop qrstuvwx"[: 20 + i % 7] + rng.choice("xyz"), None) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, text string, g string")
    assert {r.i: (r.duplicate_of, round(r.jaccard, 6)) for r in dedup.near_duplicates_within(df, "text", "i").collect()} == near_brute(rows)


def test_checks_shuffle_no_records(spark):
    """Where few keys are repeated, the only thing shuffled for the counts of a source is a row for it and a task."""
    from lexmill import plans

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plans.queries()["flow_filter_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(source#" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_signatures_take_less_than_six_hundred_bytes_a_document(spark, monkeypatch):
    from lexmill import plans

    moved, real = [], dedup._signatures

    def measured(rows, n, threshold, splits):
        out = real(rows, n, threshold, 1 + 1_100_000 // dedup.ROWS_TOGETHER)
        moved.append(out.agg(F.sum(sum(F.length(c) for c in ("ids", "sizes", "odd", "counts", "signs")))).first()[0])
        return out

    monkeypatch.setattr(dedup, "_signatures", measured)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    plans.queries()["flow_filter_stats"](spark, "/root/testdata/sf0.01")
    assert len(moved) == 1 and 0 < moved[0] < 600 * docs


@pytest.mark.parametrize("few", [500_000, 20])
def test_copies_in_many_tasks_are_named_once(spark, monkeypatch, few):
    named, real = Counter(), dedup._signatures

    def counted(rows, n, threshold, splits):
        out = real(rows, n, threshold, splits)
        named.update(r.win << 40 | r.grp for r in out.collect())
        return out

    monkeypatch.setattr(dedup, "_signatures", counted)
    monkeypatch.setattr(dedup, "FEW", few)
    rows = [(i, "one text that comes again and again", None) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, text string, g string").repartition(8)
    assert {r.i: (r.duplicate_of, r.jaccard) for r in dedup.near_duplicates_within(df, "text", "i").collect()} == near_brute(rows)
    assert named and set(named.values()) == {1}


def test_records_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(dedup.F, "shiftright", lambda c, n: F.lit(7), raising=True)
    rng = random.Random(29)
    rows = [(i, "abcdefgh ijklmnop qrstuvwx"[: 20 + i % 7] + rng.choice("xyz"), None) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, text string, g string")
    assert {r.i: (r.duplicate_of, round(r.jaccard, 6)) for r in dedup.near_duplicates_within(df, "text", "i").collect()} == near_brute(rows)


def test_one_number_of_several_records(spark):
    """A copy doesn't take another text of its number with it."""
    rows = [(1, "the first text that is written here"), (2, "the first text that is written here"), (2, "quite another one and not like it"), (3, "quite another one and not like it!")]
    got = {(r.i, r.duplicate_of) for r in dedup.near_duplicates_within(spark.createDataFrame(rows, "i long, text string"), "text", "i").collect()}
    assert {(2, 1), (3, 2)} <= got


def test_repeats(spark):
    a, b = "some words that are written here for a test", "none of these"
    rows = [(1, a, "x"), (2, a, None), (3, a + "!", "y"), (4, None, "z"), (5, None, "z"), (6, " ", "z"), (7, "", "z"), (8, b, "x")]
    got = {r.i: (r.source, r.present, r.duplicate_of, r.near) for r in dedup.repeats(spark.createDataFrame(rows, "i long, text string, source string"), "text", "i", {"source": F.col("source")}).collect()}
    assert got == {
        1: ("x", True, None, False), 2: (None, True, 1, True), 3: ("y", True, None, True), 4: ("z", False, None, False), 5: ("z", False, None, False), 6: ("z", False, None, False),
        7: ("z", False, 6, False), 8: ("x", True, None, False),
    }


def test_durable_frees_what_was_shuffled(spark):
    import time

    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    out = session.durable(spark.range(1000).groupBy(F.col("id") % 10).count(), free=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 10 and spark.conf.get(session.FREE, "false") == "false"


def test_checks_count_characters_and_words_in_runs(spark, tmp_path):
    """The counts of the checks are those of the patterns, and none of them lists its matches."""
    from lexmill import plans
    from lexmill.functions import portable

    odd = ["", " ", "\u00a0a\u2003b ", "نص word نص 12", "İstanbul \U00010400\U0001f600 x", "\u001cنص\u0085\n", "a" * 3, "ﭐ ٣ ـ", None]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    for chars in (portable.ARABIC, r"\p{L}"):
        assert df.filter(~X.count(F.col("text"), chars).eqNullSafe(X.count_chars(F.col("text"), chars))).count() == 0
    kept, real = {}, dedup.repeats
    docs = df.select(F.monotonically_increasing_id().alias("doc_id"), F.lit("s").alias("source"), F.lit("d").alias("dialect"), "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    try:
        dedup.repeats = lambda df, text, ident, keep: kept.update(keep) or real(df, text, ident, keep)
        plans.queries()["flow_filter_stats"](spark, str(tmp_path))
    finally:
        dedup.repeats = real
    assert df.filter(~kept["words"].eqNullSafe(F.size(X.tokenize("text")))).count() == 0
    assert "regexp_extract_all" not in df.select(*[kept[k] for k in ("arabic", "letters", "words")])._jdf.queryExecution().executedPlan().toString()

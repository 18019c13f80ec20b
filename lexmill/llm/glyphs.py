"""Problem 3: one consistent form of texts that look the same.

The words that hold an odd code point are exploded to positioned code points, each different word once; broadcast joins bring the
decomposition and look-alike of each; combining marks are ordered by class, recomposed with their base, and the word is rebuilt, and
from words the text: no code point changes one beyond a blank. Invisible characters go; the width, presentation form
and composition of characters are made one; visible marks, stretching and letters that differ to the eye stay as they are.
The two mapping tables follow from the Unicode data of the standard library and are of fixed size.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.session import durable

# Letters and digits that look the same in every position.
LOOK_ALIKES = dict(zip(
    "аеорсухіѕјһԁԛԝѵАВЕЅІЈКМНОРСТХУԌԚԜοΑΒΕΖΗΙΚΜΝΟΡΤΥΧօսոհՕՍᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃꓮꓐꓚꓓꓰꓝꓖꓧꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ‐‑۰۱۲۳۷۸۹",
    "aeopcyxisjhdqwvABESIJKMHOPCTXYGQWoABEZHIKMNOPTYXounhOUABCDEGHJKLMPRSTVWZABCDEFGHJKLMNOPRSTUVWXYZ--٠١٢٣٧٨٩",
))
WIDTHS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
KEPT_IN_PLACES = {0x200C, 0x200D}
FILLERS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
IN_CONTEXT = "یک"
COMMON = {"ARABIC", "LATIN", "CJK", "HIRAGANA", "KATAKANA", "THAI", "HANGUL"}
DUAL = "بتثجحخسشصضطظعغفقكلمنهيىئپچگکیہھٹڻںڤـ"
ARABIC_NEXT = r"(?=\p{M}*[ء-يـٱ-ۓ&&[^ء]])"


@cache
def _parts(cp: int) -> tuple[int, ...]:
    """The code points that stand for ``cp`` before marks are ordered."""
    ch = chr(cp)
    if cp in FILLERS or (unicodedata.category(ch) == "Cf" and cp not in VISIBLE_FORMATS and cp not in KEPT_IN_PLACES):
        return ()
    if ch in LOOK_ALIKES:
        return (ord(LOOK_ALIKES[ch]),)
    kind, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    kind = f"{kind}>" if kind else ""
    if not rest or 0xAC00 <= cp <= 0xD7A3 or (kind and kind not in WIDTHS and not (unicodedata.category(ch) == "Zs" and rest == "0020")):
        return (cp,)
    return tuple(p for x in rest.split() for p in _parts(int(x, 16)))


@cache
def odd_class() -> str:
    """A character class of every code point that the tables change or that takes part in composition.

    Letters that are composed already and stay so are left out, as texts without marks need nothing done to them.
    """
    odd = []
    for cp in range(0x80, 0x110000):
        if not 0xD800 <= cp < 0xE000:
            ch, parts = chr(cp), _parts(cp)
            if unicodedata.combining(ch) or cp in KEPT_IN_PLACES or (parts != (cp,) and unicodedata.normalize("NFC", "".join(map(chr, parts))) != ch) or ch in IN_CONTEXT:
                odd.append(cp)
    odd += [ord(b) for _, b in _pairs() if not unicodedata.combining(b)]
    ranges: list[list[int]] = []
    for cp in sorted(set(odd)):
        if ranges and cp <= ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    near: list[list[int]] = []
    for lo, hi in ranges:  # few wide ranges match faster than many exact ones; what they hold besides does no harm
        if near and lo - near[-1][1] < 200 and not any(unicodedata.name(chr(c), "").split(" ")[0] in COMMON for c in range(near[-1][1] + 1, lo)):
            near[-1][1] = hi
        else:
            near.append([lo, hi])
    usual = []  # runs of the commonest letters that are never odd: asked first, as a class takes time in proportion to its ranges
    for lo, hi in ((0x20, 0x7E), (0x621, 0x64A), (0x60C, 0x61F), (0x660, 0x669), (0x1F300, 0x1F9FF)):
        for a, b in near:
            if a <= hi and b >= lo:
                if a > lo:
                    usual.append((lo, a - 1))
                lo = b + 1
        if lo <= hi:
            usual.append((lo, hi))
    group = lambda ranges: "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges) + "]"
    return f"(?!{group(usual)}){group(near)}"


@cache
def _pairs() -> dict[tuple[str, str], str]:
    """Two code points, the first a base, and the one they compose to."""
    out = {}
    for cp in range(0xA0, 0x30000):
        d = unicodedata.decomposition(chr(cp)).split()
        if len(d) == 2 and not d[0].startswith("<"):
            a, b = (chr(int(x, 16)) for x in d)
            if unicodedata.normalize("NFC", a + b) == chr(cp):
                out[a, b] = chr(cp)
    for lv in range(0xAC00, 0xD7A4, 28):
        out[unicodedata.normalize("NFD", chr(lv))[0], unicodedata.normalize("NFD", chr(lv))[1]] = chr(lv)
        for t in range(1, 28):
            out[chr(lv), chr(0x11A7 + t)] = chr(lv + t)
    return out


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(ch, parts) of every code point that changes or is a mark, and (base, options) of every base that takes a second part."""
    second = {b for _, b in _pairs() if not unicodedata.combining(b)}
    rows = []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        parts = _parts(cp)
        if parts != (cp,) or unicodedata.combining(chr(cp)) or chr(cp) in second:
            rows.append((chr(cp), [(chr(p), unicodedata.combining(chr(p)), chr(p) in second) for p in parts]))
    by: dict[str, list] = {}
    for (a, b), c in _pairs().items():
        by.setdefault(a, []).append((b, c))
    part = T.StructType([T.StructField("c", T.StringType()), T.StructField("ccc", T.IntegerType()), T.StructField("joins", T.BooleanType())])
    option = T.StructType([T.StructField("m", T.StringType()), T.StructField("r", T.StringType())])
    parts = spark.createDataFrame(rows, T.StructType([T.StructField("ch", T.StringType()), T.StructField("parts", T.ArrayType(part))]))
    options = spark.createDataFrame(list(by.items()), T.StructType([T.StructField("from", T.StringType()), T.StructField("options", T.ArrayType(option))]))
    return parts, options


def _in_context(df: DataFrame, name: str) -> DataFrame:
    """What depends on the neighbours: joiners that show, and yeh and kaf, whose look depends on the next letter."""

    def where(df: DataFrame, sign: str, *changes: tuple[str, str]) -> DataFrame:
        out = F.col(name)
        for pattern, to in changes:
            out = F.regexp_replace(out, pattern, to)
        return df.withColumn(name, F.when(F.contains(F.col(name), F.lit(sign)), out).otherwise(F.col(name)))

    df = where(df, "\u200c", ("\u200c+", "\u200c"), (f"(?<![{DUAL}]\\p{{M}}{{0,8}})\u200c|\u200c(?!\\p{{M}}*[ء-يٱ-ۓ])", ""))
    df = where(df, "\u200d", ("(?<![\\p{So}\\x{1F3FB}-\\x{1F3FF}])\u200d|\u200d(?!\\p{So})", ""))
    df = where(df, "ی", (f"ی{ARABIC_NEXT}", "ي"), ("ی", "ى"))
    return where(df, "ک", (f"ک{ARABIC_NEXT}", "ك")).withColumn(name, F.trim(name))


ROUNDS = 3  # no base takes more than three further parts, one after the other, in Unicode


def forms(words: DataFrame) -> DataFrame:
    """(word, form) of distinct words that hold any code point of ``odd_class``, before what depends on their neighbours."""
    parts, options = (F.broadcast(t) for t in tables(words.sparkSession))
    keyed = words.select("word", F.md5("word").alias("h")).repartition("h")
    cps = keyed.select("h", F.posexplode(F.split("word", "")).alias("pos", "ch"))
    plain = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(False).alias("joins")))
    cps = cps.join(parts, "ch", "left").select("h", "pos", F.posexplode(F.coalesce("parts", plain)).alias("i", "p")).select("h", "pos", "i", "p.*")
    w = Window.partitionBy("h").orderBy("pos", "i").rowsBetween(Window.unboundedPreceding, 0)
    cps = cps.withColumn("run", F.count_if(F.col("ccc") == 0).over(w)).withColumn("seg", F.count_if((F.col("ccc") == 0) & ~F.col("joins")).over(w))
    segs = cps.groupBy("h", "seg").agg(F.array_sort(F.collect_list(F.struct("run", "ccc", "pos", "i", "c"))).alias("a"))
    segs = segs.select("h", "seg", F.col("a")[0]["c"].alias("base"), F.expr("slice(a, 2, size(a))").alias("marks"), F.lit(0).alias("at"))
    for _ in range(ROUNDS):
        segs = segs.join(options, F.when(F.size("marks") > F.col("at"), F.col("base")) == F.col("from"), "left")
        segs = segs.withColumn(
            "hit",
            F.expr("""CASE WHEN options IS NOT NULL AND seg > 0 THEN get(filter(sequence(at, size(marks) - 1), i -> (i = 0 OR (get(marks, i - 1).ccc > 0 AND get(marks, i - 1).ccc < get(marks, i).ccc))
                      AND exists(options, o -> o.m = get(marks, i).c)), 0) END"""),
        )
        segs = segs.select(
            "h", "seg",
            F.expr("CASE WHEN hit IS NULL THEN base ELSE get(filter(options, o -> o.m = get(marks, hit).c), 0).r END").alias("base"),
            F.expr("CASE WHEN hit IS NULL THEN marks ELSE filter(marks, (x, i) -> i <> hit) END").alias("marks"),
            F.coalesce("hit", "at").alias("at"),
        )
    segs = segs.select("h", "seg", F.concat("base", F.array_join(F.expr("transform(marks, m -> m.c)"), "")).alias("s"))
    built = segs.groupBy("h").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(seg, s))), x -> x.s)"), "").alias("form"))
    return keyed.join(built, "h", "left").select("word", F.coalesce("form", F.lit("")).alias("form"))


def with_form(df: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """``df`` with a column of the consistent form of its text, in place of a column of that name.

    Null stays null; a text of invisible characters only becomes empty; a text that holds nothing odd is its own form, without
    white space around it. Rows are neither lost nor added, whatever repeats. A very long word is one group of code points.
    """
    df = df.drop(form) if form != text else df
    found = F.when(F.col(text).rlike(odd_class()), F.array_distinct(F.filter(F.split(text, " "), lambda w: w.rlike(odd_class()))))
    rows = durable(df.withColumn("_odd", found).withColumn("_h", F.when(F.col("_odd").isNotNull(), F.md5(text))))
    held = rows.filter("_odd is not null").select("_h", F.explode("_odd").alias("word")).distinct()
    made = forms(rows.filter("_odd is not null").select(F.explode("_odd").alias("word")).distinct())
    changed = held.join(made, "word").groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("word", "form"))).alias("_changed"))
    odd = rows.filter("_odd is not null").join(changed, "_h")
    built = F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at("_changed", w), w)), " ")
    odd = _in_context(odd.withColumn(form, built), form)
    return rows.filter("_odd is null").withColumn(form, F.trim(text)).unionByName(odd.drop("_changed")).drop("_odd", "_h")


def equal_looking(df: DataFrame, text: str = "text", ident: str = "ord") -> DataFrame:
    """Pairs of rows (ord_a < ord_b) whose texts look the same and aren't the same code points.

    Only forms that several different texts share are compared, one variant with another; rows come in when pairs are written.
    """
    rows = with_form(df.select(F.col(ident).alias("ord"), F.col(text).alias("text")).filter("text is not null")).filter("form <> ''")
    rows = rows.select("ord", F.md5("form").alias("f"), F.md5("text").alias("t"))
    several = rows.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("f")
    rows = rows.join(several, "f", "left_semi")
    rows = durable(rows)
    v = rows.select("f", "t").distinct()
    pairs = v.toDF("f", "ta").join(v.toDF("f", "tb"), "f").filter("ta < tb").select("ta", "tb")
    out = pairs.join(rows.select(F.col("t").alias("ta"), F.col("ord").alias("oa")), "ta").join(rows.select(F.col("t").alias("tb"), F.col("ord").alias("ob")), "tb")
    return out.select(F.least("oa", "ob").alias("ord_a"), F.greatest("oa", "ob").alias("ord_b"))

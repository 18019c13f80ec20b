"""Cleaning, normalising, parsing and describing text, as column expressions inside whole-stage code generation.

Every function takes a string column and gives null for null. Results are those of SQL's code points, not bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import portable as P


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_chars(text: Column, chars: str) -> Column:
    """``count`` of a pattern that is one character long, without a match for each."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))


def tokenize(text: Column | str) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(_c(text), f"{P.WS}+"), lambda w: w != "")


def dedup_key(text: Column | str) -> Column:
    """White space collapsed and trimmed, lower case; letters stay as they are."""
    return F.lower(F.trim(F.regexp_replace(_c(text), f"{P.WS}+", " ")))


def unescape_text(text: Column | str) -> tuple[Column, Column]:
    """(text, changed): quotation marks around a whole value and doubled or escaped ones inside it are undone."""
    t = _c(text)
    wrapped = lambda x: (F.length(x) >= 2) & x.startswith('"') & x.endswith('"')
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    once = F.replace(inner(t), F.lit('""'), F.lit('"'))
    twice = F.replace(F.when(wrapped(once), inner(once)).otherwise(once), F.lit('\\"'), F.lit('"'))
    return F.when(wrapped(t), twice).otherwise(t), wrapped(t)


def clean_text(text: Column | str, steps: tuple[str, ...] = ("urls", "mentions")) -> tuple[Column, dict[str, Column]]:
    """(text, replacements by step): links and handles become placeholders; spaces collapse whenever a step is on."""
    t, counts = _c(text), {}
    for step in steps:
        pattern, name = {"urls": (P.URL, "URL"), "mentions": (P.HANDLE, "USER")}[step]
        counts[step] = count(t, pattern)
        t = F.regexp_replace(t, pattern, f" {name} ")
    return (F.trim(F.regexp_replace(t, " {2,}", " ")) if steps else t), counts


def model_text(text: Column | str) -> Column:
    return clean_text(unescape_text(text)[0])[0]


def lexical_tokens(text: Column | str) -> Column:
    """Arabic and Latin words without links, handles, placeholders and diacritics, with one alef, in lower case."""
    t = F.regexp_replace(_c(text), r"https?://\S+|www\.\S+", " ")
    t = F.regexp_replace(F.regexp_replace(t, P.HANDLE, " "), r"\b(?:USER|URL|EMOJI|NUM)\b", " ")
    t = F.lower(F.translate(F.regexp_replace(t, P.DIACRITICS_TATWEEL, ""), "إأآٱ", "اااا"))
    return F.regexp_extract_all(t, F.lit(P.LEXICAL_WORD), F.lit(0))


def norm(text: Column | str) -> Column:
    return F.array_join(lexical_tokens(text), " ")


def strip_diacritics(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), P.DIACRITICS, "")


def clean_for_topics(text: Column | str) -> Column:
    """Placeholders out, hashtags to words (from the first hash sign that something follows), laughter to two letters, white space collapsed."""
    at = lambda w: F.instr(w, F.lit("#"))
    plain = lambda w: F.when((at(w) > 0) & (at(w) < F.length(w)), F.concat(F.substring(w, F.lit(1), at(w) - 1), F.translate(F.substring(w, at(w) + 1, F.length(w)), "_", " "))).otherwise(w)
    t = F.array_join(F.transform(tokenize(F.regexp_replace(_c(text), P.TOPIC_NOISE, " ")), plain), " ")
    return F.array_join(tokenize(F.regexp_replace(t, "ه{3,}", "هه")), " ")


def clean_line(line: Column | str) -> Column:
    """A line of generated output without list mark, label and surrounding quotation marks."""
    s = F.regexp_replace(F.regexp_replace(F.trim(_c(line)), P.LIST_PREFIX, ""), P.LABEL_PREFIX, "")
    return F.trim(F.btrim(F.trim(s), F.lit(P.QUOTES)))


def parse_output(raw: Column | str, n: int = 1, script: str = "arabic") -> Column:
    """The first ``n`` sentences of a generated output: preambles and lines of the wrong script are left out."""
    lines = F.split(F.replace(_c(raw), F.lit("\r"), F.lit("")), "\n")
    low = lambda x: F.lower(F.trim(x))
    preamble = lambda x: reduce(lambda a, b: a | b, [low(x).startswith(p) for p in P.PREAMBLES])
    lines = F.filter(lines, lambda x: (F.trim(x) != "") & ~low(x).endswith(":") & ~preamble(x))
    wanted = (lambda x: ~x.rlike(P.ARABIC) & x.rlike(P.LATIN)) if script == "arabizi" else (lambda x: x.rlike(P.ARABIC))
    return F.slice(F.filter(F.transform(lines, clean_line), lambda x: (x != "") & wanted(x)), 1, n)


def strip_translation(text: Column | str) -> tuple[Column, Column]:
    """(text, changed): a trailing run of three or more Latin words goes where Arabic stands before it."""
    t = _c(text)
    head = F.substring(t, F.lit(1), F.regexp_instr(t, F.lit(P.TRANSLATION_TAIL)) - 1)
    cut = (F.regexp_instr(t, F.lit(P.TRANSLATION_TAIL)) > 1) & head.rlike(P.ARABIC)
    return F.when(cut, F.trim(F.regexp_replace(head, r"[ \-–—|:(\[]+$", ""))).otherwise(t), cut


def parse_pair(raw: Column | str) -> Column:
    """The first Arabic line of each role, as a map from A and B to the text; roles without one are absent."""
    lines = F.split(F.replace(F.replace(_c(raw), F.lit("\r"), F.lit("")), F.lit("**"), F.lit("")), "\n")
    lines = F.filter(F.transform(lines, F.trim), lambda x: x.rlike(P.PAIR_LINE))
    role = lambda x: F.translate(F.upper(F.regexp_extract(x, P.PAIR_LINE, 1)), "أب", "AB")
    entries = F.filter(F.transform(lines, lambda x: F.struct(role(x).alias("role"), clean_line(F.regexp_extract(x, P.PAIR_LINE, 2)).alias("text"))), lambda e: (e["text"] != "") & e["text"].rlike(P.ARABIC))
    first = lambda r: F.get(F.filter(entries, lambda e: e["role"] == r), F.lit(0))
    return F.map_from_entries(F.filter(F.array(first("A"), first("B")), lambda e: e.isNotNull()))


def script_features(text: Column | str) -> dict[str, Column]:
    """Letters, shares of Arabic and Latin letters, Latin words and their share."""
    t = F.regexp_replace(_c(text), P.NOISE, " ")
    letters, words, latin = count(t, r"\p{L}"), F.size(tokenize(t)), count(t, P.LATIN_WORD)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "letters": letters, "arabic_share": share(count(t, P.ARABIC), letters), "latin_share": share(count(t, P.LATIN), letters), "latin_words": latin, "latin_word_share": share(latin, words),
    }


def observed_script(f: dict[str, Column], least: float = 0.7) -> Column:
    return F.when(f["arabic_share"] >= least, "arabic").when(f["latin_share"] >= least, "arabizi").otherwise("mixed")


def observed_code_switching(f: dict[str, Column], heavy: float = 0.2) -> Column:
    return F.when(f["latin_word_share"] == 0, "none").when(f["latin_word_share"] < heavy, "light").otherwise("heavy")


def is_arabic(text: Column | str) -> Column:
    a, lat = count(_c(text), P.ARABIC_NARROW), count(_c(text), P.LATIN)
    return (a > 0) & (a >= 0.7 * (a + lat))


def text_flags(text: Column | str) -> dict[str, Column]:
    """Boolean properties that profiles count."""
    t = _c(text)
    bare = F.regexp_replace(F.regexp_replace(t, P.ANY_URL, " "), P.PLACEHOLDER, " ")
    letters = count(bare, r"\p{L}")
    return {
        "le_3_words": F.size(tokenize(t)) <= 3, "with_url": t.rlike(P.ANY_URL), "with_raw_url": t.contains("http") | t.contains("pic.twitter.com"), "with_mention": t.rlike(P.ANY_MENTION),
        "with_num": t.rlike(r"\bNUM\b"), "with_hashtag": t.contains("#"), "with_emoji": t.rlike(P.EMOJI), "with_latin_word": bare.rlike(P.LATIN_WORD3),
        "with_persian_urdu": t.rlike(P.PERSIAN_URDU), "mostly_non_arabic": (letters > 0) & (count(bare, P.ARABIC_CHAR) * 2 < letters), "no_letters": letters == 0,
    }


def surface_features(text: Column | str) -> dict[str, Column]:
    t = _c(text)
    return {
        "link": t.contains("URL"), "mention": t.contains("USER"), "hashtag": t.contains("#"), "emoji": t.rlike(P.EMOJI), "question": t.rlike("[?؟]"), "exclamation": t.contains("!"),
        "digit": t.rlike("[0-9٠-٩]"), "religious": t.rlike(P.RELIGIOUS),
    }


def aldi_bin(score: Column | str) -> Column:
    s = _c(score)
    out = reduce(lambda w, b: w.when(s >= b[0], b[1]), P.ALDI_BINS[1:], F.when(s >= P.ALDI_BINS[0][0], P.ALDI_BINS[0][1]))
    return F.when(s.isNotNull(), out.otherwise("[0.00,0.11)"))


def cardinality_bucket(k: Column | str) -> Column:
    k = _c(k)
    return reduce(lambda w, b: w.when(k.between(b[0], b[1]), b[2]), P.CARDINALITY_BUCKETS[1:], F.when(k.between(0, 0), "0"))


def script_counts(text: Column | str, method: str = "char_franco_digits", strict: bool = False) -> tuple[Column, Column]:
    """(Arabic units, Latin units) by letters, by letters of Latin words, or by tokens (ties are Arabic)."""
    t = F.regexp_replace(_c(text), P.NOISE, " ")
    arabic = P.ARABIC_STRICT if strict else P.ARABIC
    in_words = lambda x: F.length(F.array_join(F.regexp_extract_all(x, F.lit(P.LATIN_WORD), F.lit(0)), ""))
    if method == "char_letters":
        return count(t, arabic), count(t, P.LATIN)
    if method == "char_franco_digits":
        return count(t, arabic), in_words(t)
    if method != "token":
        raise ValueError(f"unknown method {method!r}")
    toks = F.transform(tokenize(t), lambda w: F.struct(count(w, arabic).alias("a"), in_words(w).alias("l")))
    return F.size(F.filter(toks, lambda x: (x["a"] >= x["l"]) & (x["a"] + x["l"] > 0))), F.size(F.filter(toks, lambda x: x["l"] > x["a"]))


def latin_bin(arabic: Column, latin: Column) -> Column:
    """0 to 10, in whole numbers; null without letters."""
    total = arabic + latin
    return F.when(total > 0, 10 - F.least(F.lit(10), F.floor((20 * arabic + total) / (2 * total)).cast("int")))


def arabic_bin(text: Column | str) -> Column:
    return 10 - latin_bin(*script_counts(text, "char_letters"))


def token_languages(text: Column | str) -> Column:
    t = F.regexp_replace(_c(text), P.NOISE, " ")
    lang = lambda w: F.when(w.rlike(P.ARABIC) & w.rlike(P.LATIN_WORD), "mixed").when(w.rlike(P.ARABIC), "ar").when(w.rlike(P.LATIN_WORD), "en").otherwise("other")
    return F.transform(tokenize(t), lang)


def keyword_types(text: Column | str, dialect: Column | str) -> Column:
    """The kinds of post that a cleaned text matches, ``other`` where none; a link is its placeholder."""
    t, n = _c(text), F.size(tokenize(text))
    link = t.contains("URL")
    news = link & ~t.rlike(P.FIRST_PERSON)
    kinds = [
        F.when(news & t.rlike(P.BAD_NEWS), "news_bad").when(news & t.rlike(P.GOOD_NEWS), "news_good"), F.when(_c(dialect).isin(*P.SHORT_DIALECTS) & (n <= 10) & ~link, "short_dialect"),
        F.when(t.rlike(P.SINGER), "lyric"), F.when((n <= 14) & t.contains("#") & t.rlike(P.HEART) & ~link, "fan_post"),
    ]
    found = F.filter(F.array(*kinds), lambda x: x.isNotNull())
    return F.when(t.isNotNull(), F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found))


def reparsed(raw: Column | str) -> Column:
    """The text that the parsers make of a stored output: its first sentence without a translation, cleaned; null where there is none."""
    first = F.get(parse_output(raw), F.lit(0))
    bare = strip_translation(first)[0]
    return F.when(bare != "", clean_text(bare)[0])


def code_mixing(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the code-mixing index, switch points and their fraction, Latin share and dominant script of a text.

    The languages of the words are a column of their own, used many times and therefore computed once; null texts have none.
    """
    langs = F.col("_langs")
    n = lambda x: F.size(F.filter(langs, lambda w: w == x))
    out = df.withColumn("_langs", token_languages(text))
    out = out.withColumns({"words": F.size(langs), "arabic_words": n("ar"), "latin_words": n("en"), "_lang": F.size(F.filter(langs, lambda w: w != "other")), "_seq": F.filter(langs, lambda w: w.isin("ar", "en"))})
    m, ar, en, lang = F.size("_seq"), F.col("arabic_words"), F.col("latin_words"), F.col("_lang")
    changes = F.zip_with(F.slice("_seq", F.lit(1), F.greatest(m - 1, F.lit(0))), F.slice("_seq", F.lit(2), F.greatest(m - 1, F.lit(0))), lambda a, b: a != b)
    out = out.withColumn("switch_points", F.when(m > 1, F.size(F.filter(changes, lambda x: x))).otherwise(0))
    return out.withColumns({
        "cmi": F.when(lang > 0, 100 * (1 - F.greatest(ar, en) / lang)).otherwise(F.lit(0.0)), "switch_point_fraction": F.when(m > 1, F.col("switch_points") / (m - 1)).otherwise(F.lit(0.0)),
        "latin_word_share": F.when(F.col("words") > 0, en / F.col("words")).otherwise(F.lit(0.0)), "dominant": F.when(ar > en, "ar").when(en > ar, "en").otherwise("tie"),
    }).drop("_langs", "_lang", "_seq")


def connective_words(text: Column | str) -> Column:
    t = F.regexp_replace(_c(text), P.NOISE, " ")
    words = F.transform(F.regexp_extract_all(t, F.lit(P.CONNECTIVE_WORD), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, r"[\x{640}\x{64b}-\x{652}]", "")))
    return F.filter(words, lambda w: w != "")


def length_band(n: Column | str, edges: tuple[int, ...] = (10, 20)) -> Column:
    n, lo, out = _c(n), 1, None
    for e in edges:
        out = (out.when if out is not None else F.when)(n < e, f"{lo}-{e - 1}")
        lo = e
    return out.otherwise(f"{lo}+")


def text_id(text: Column | str, prefix: str = "t") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.encode(_c(text), "UTF-8")), 1, 16))


def one_hot(target: Column, classes: tuple[str, ...] = P.DIALECTS, rest: int | None = 0) -> Column:
    """A map with 1 at the target and ``rest`` (0, or null for unknown) elsewhere."""
    return F.map_from_entries(F.transform(F.array(*map(F.lit, classes)), lambda d: F.struct(d.alias("k"), F.when(d == target, 1).otherwise(F.lit(rest).cast("int")).alias("v"))))


def shingles(key: Column | str, n: int = 5) -> Column:
    """Distinct character n-grams, or the whole key where it isn't longer than ``n``."""
    k = _c(key)
    return F.when(F.length(k) <= n, F.array(k)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(k) - n + 1, F.lit(1))), lambda i: F.substring(k, i, F.lit(n)))))

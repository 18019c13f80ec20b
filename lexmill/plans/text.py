"""Text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import portable as P
from lexmill.functions import text as X
from lexmill.operators import codemix
from lexmill.plans.registry import Registry
from lexmill.sources.tables import table

r = Registry()


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{P.WS}+'), lambda w: w <> '')"


_KEY = "lower(trim(" + _sub("text", P.WS + "+", " ") + "))"
_LEX = f"regexp_extract_all(lower(translate({_sub(_sub(_sub(_sub('text', 'https?://\\S+|www\\.\\S+', ' '), P.HANDLE, ' '), r'\b(?:USER|URL|EMOJI|NUM)\b', ' '), P.DIACRITICS_TATWEEL, '')}, 'إأآٱ', 'اااا')), '{P.LEXICAL_WORD}')"
_BARE = _sub("text", P.NOISE, " ")


def _cols(spec: dict) -> list:
    return [c.alias(n) for n, c in spec.items()]


@r.query("""SELECT ord, CASE WHEN w THEN replace(CASE WHEN length(o) >= 2 AND o[1] = '"' AND o[-1] = '"' THEN substr(o, 2, length(o) - 2) ELSE o END, '\\"', '"') ELSE raw_output END AS text, w AS changed
FROM (SELECT ord, raw_output, w, replace(substr(raw_output, 2, greatest(length(raw_output) - 2, 0)), '""', '"') AS o FROM (SELECT ord, raw_output, length(raw_output) >= 2 AND raw_output[1] = '"' AND raw_output[-1] = '"' AS w FROM synthetic))""")
def text_p01_unescape(spark: SparkSession, sf: str) -> DataFrame:
    t, changed = X.unescape_text("raw_output")
    return table(spark, sf, "synthetic").select("ord", t.alias("text"), changed.alias("changed"))


@r.query(f"SELECT ord, trim({_sub(_sub(_sub('text', P.URL, ' URL '), P.HANDLE, ' USER '), ' {2,}', ' ')}, ' ') AS cleaned, {_n('text', P.URL)} AS n_urls, {_n(_sub('text', P.URL, ' URL '), P.HANDLE)} AS n_mentions FROM quality_rows")
def text_p02_clean(spark: SparkSession, sf: str) -> DataFrame:
    t, n = X.clean_text("text")
    return table(spark, sf, "quality_rows").select("ord", t.alias("cleaned"), n["urls"].alias("n_urls"), n["mentions"].alias("n_mentions"))


@r.query(f"""WITH c AS (SELECT text, trim({_sub(_sub(_sub('text', P.URL, ' URL '), P.HANDLE, ' USER '), ' {2,}', ' ')}, ' ') AS c, {_n('text', P.URL)} AS u, {_n(_sub('text', P.URL, ' URL '), P.HANDLE)} AS m FROM tweets WHERE text IS NOT NULL),
g AS (SELECT c, count(*) AS n FROM c GROUP BY c)
SELECT (SELECT count(*) FROM c) AS n, sum(u)::BIGINT AS n_urls, sum(m)::BIGINT AS n_mentions, count_if(u > 0) AS rows_urls, count_if(m > 0) AS rows_mentions, (SELECT sum(n)::BIGINT FROM g WHERE n > 1) AS identical, (SELECT count(*) FROM g) AS n_distinct FROM c""")
def text_p03_cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    t, n = X.clean_text("text")
    rows = table(spark, sf, "tweets").filter("text is not null").select(t.alias("c"), n["urls"].alias("u"), n["mentions"].alias("m"))
    per = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("m").alias("m"), F.count_if(F.col("u") > 0).alias("ru"), F.count_if(F.col("m") > 0).alias("rm"))
    return per.agg(
        F.sum("n").alias("n"), F.sum("u").alias("n_urls"), F.sum("m").alias("n_mentions"), F.sum("ru").alias("rows_urls"), F.sum("rm").alias("rows_mentions"),
        F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("identical"), F.count("*").alias("n_distinct"),
    )


@r.query(f"SELECT doc_id, {_KEY} AS key, substr(sha1(text), 1, 16) AS id FROM documents")
def text_p04_key_and_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.dedup_key("text").alias("key"), X.text_id("text", "").alias("id"))


@r.query(f"SELECT ord, array_to_string({_LEX}, ' ') AS norm, len({_LEX}) AS n_tokens, len({_tok('text')}) AS n_words FROM tweets")
def text_p05_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweets").select("ord", X.norm("text").alias("norm"), F.when(F.col("text").isNotNull(), F.size(X.lexical_tokens("text"))).alias("n_tokens"), F.when(F.col("text").isNotNull(), F.size(X.tokenize("text"))).alias("n_words"))


@r.query(f"SELECT ord, {_sub('text', P.DIACRITICS, '')} AS bare FROM tweets")
def text_p09_strip_diacritics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweets").select("ord", X.strip_diacritics("text").alias("bare"))


def topic_sql(x: str) -> str:
    words = f"list_transform({_tok(_sub(x, P.TOPIC_NOISE, ' '))}, lambda w: CASE WHEN strpos(w, '#') > 0 AND strpos(w, '#') < length(w) THEN substr(w, 1, strpos(w, '#') - 1) || replace(substr(w, strpos(w, '#') + 1), '_', ' ') ELSE w END)"
    return f"array_to_string({_tok(_sub(f"array_to_string({words}, ' ')", 'ه{3,}', 'هه'))}, ' ')"


@r.query(f"SELECT ord, {topic_sql('text')} AS topic_text FROM tweets")
def text_p08_topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweets").select("ord", X.clean_for_topics("text").alias("topic_text"))


_FLAGS = f"""SELECT ord, len({_tok('text')}) <= 3 AS le_3_words, regexp_matches(text, '{P.ANY_URL}') AS with_url, contains(text, 'http') OR contains(text, 'pic.twitter.com') AS with_raw_url,
regexp_matches(text, '{P.ANY_MENTION}') AS with_mention, regexp_matches(text, '\\bNUM\\b') AS with_num, contains(text, '#') AS with_hashtag, regexp_matches(text, '{P.EMOJI}') AS with_emoji,
regexp_matches(b, '{P.LATIN_WORD3}') AS with_latin_word, regexp_matches(text, '{P.PERSIAN_URDU}') AS with_persian_urdu, {_n('b', '\\p{L}')} > 0 AND {_n('b', P.ARABIC_CHAR)} * 2 < {_n('b', '\\p{L}')} AS mostly_non_arabic, {_n('b', '\\p{L}')} = 0 AS no_letters
FROM (SELECT ord, text, {_sub(_sub('text', P.ANY_URL, ' '), P.PLACEHOLDER, ' ')} AS b FROM tweets WHERE text IS NOT NULL)"""


@r.query(_FLAGS)
def text_f06_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweets").filter("text is not null").select("ord", *_cols(X.text_flags("text")))


@r.query(f"""WITH b AS (SELECT ord, {_BARE} AS t FROM tweets WHERE text IS NOT NULL), f AS (SELECT ord, {_n('t', '\\p{L}')} AS letters, {_n('t', P.ARABIC)} AS a, {_n('t', P.LATIN)} AS l, {_n('t', P.LATIN_WORD)} AS lw, len({_tok('t')}) AS w FROM b),
s AS (SELECT ord, letters, CASE WHEN letters > 0 THEN a / letters ELSE 0.0 END AS arabic_share, CASE WHEN letters > 0 THEN l / letters ELSE 0.0 END AS latin_share, lw AS latin_words, CASE WHEN w > 0 THEN lw / w ELSE 0.0 END AS ws FROM f)
SELECT ord, letters, round(arabic_share, 6) AS arabic_share, round(latin_share, 6) AS latin_share, latin_words, round(ws, 6) AS latin_word_share,
CASE WHEN arabic_share >= 0.7 THEN 'arabic' WHEN latin_share >= 0.7 THEN 'arabizi' ELSE 'mixed' END AS script, CASE WHEN ws = 0 THEN 'none' WHEN ws < 0.2 THEN 'light' ELSE 'heavy' END AS switching FROM s""")
def text_f02_script(spark: SparkSession, sf: str) -> DataFrame:
    f = X.script_features("text")
    shares = [(F.round(c, 6) if "share" in n else c).alias(n) for n, c in f.items()]
    return table(spark, sf, "tweets").filter("text is not null").select("ord", *shares, X.observed_script(f).alias("script"), X.observed_code_switching(f).alias("switching"))


@r.query(f"""SELECT ord, {_n('text', P.ARABIC_NARROW)} > 0 AND {_n('text', P.ARABIC_NARROW)} >= 0.7::DOUBLE * ({_n('text', P.ARABIC_NARROW)} + {_n('text', P.LATIN)}) AS is_arabic,
regexp_matches(text, '{P.FOREIGN_SCRIPT}') AS is_foreign, regexp_matches(text, '{P.PRESENTATION}') AS presentation, regexp_matches(text, '{P.DISLIKE}') AS dislike, contains(text, 'URL') AS link, contains(text, 'USER') AS mention,
regexp_matches(text, '[?؟]') AS question, contains(text, '!') AS exclamation, regexp_matches(text, '[0-9٠-٩]') AS digit, regexp_matches(text, '{P.RELIGIOUS}') AS religious FROM tweets WHERE text IS NOT NULL""")
def text_f14_surface(spark: SparkSession, sf: str) -> DataFrame:
    s = X.surface_features("text")
    return table(spark, sf, "tweets").filter("text is not null").select(
        "ord", X.is_arabic("text").alias("is_arabic"), F.col("text").rlike(P.FOREIGN_SCRIPT).alias("is_foreign"), F.col("text").rlike(P.PRESENTATION).alias("presentation"), F.col("text").rlike(P.DISLIKE).alias("dislike"),
        *[s[k].alias(k) for k in ("link", "mention", "question", "exclamation", "digit", "religious")],
    )


_BUCKET = "CASE " + " ".join(f"WHEN k BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in P.CARDINALITY_BUCKETS) + " END"


@r.query(f"SELECT ord, CASE WHEN aldi_score >= 0.77 THEN '[0.77,1.00]' WHEN aldi_score >= 0.44 THEN '[0.44,0.77)' WHEN aldi_score >= 0.11 THEN '[0.11,0.44)' WHEN aldi_score IS NOT NULL THEN '[0.00,0.11)' END AS bin, k, {_BUCKET} AS bucket FROM (SELECT ord, aldi_score, {' + '.join(f'coalesce({d}, 0)' for d in P.DIALECTS)} AS k FROM label_rows)")
def text_f07_bins(spark: SparkSession, sf: str) -> DataFrame:
    k = sum((F.coalesce(F.col(d), F.lit(0)) for d in P.DIALECTS), F.lit(0))
    return table(spark, sf, "label_rows").select("ord", X.aldi_bin("aldi_score").alias("bin"), k.alias("k"), X.cardinality_bucket(k).alias("bucket"))


def _lw(x: str) -> str:
    return f"length(array_to_string(regexp_extract_all({x}, '{P.LATIN_WORD}'), ''))"


@r.query(f"""WITH b AS (SELECT ord, {_BARE} AS t FROM tweets WHERE text IS NOT NULL), c AS (SELECT ord, {_n('t', P.ARABIC)} AS a, {_n('t', P.LATIN)} AS l, {_lw('t')} AS lw, {_n('t', P.ARABIC_STRICT)} AS s,
list_transform({_tok('t')}, lambda w: {{'a': {_n('w', P.ARABIC)}, 'l': {_lw('w')}}}) AS toks FROM b)
SELECT ord, a AS letters_ar, l AS letters_lat, lw AS franco_lat, s AS strict_ar, len(list_filter(toks, lambda x: x.a >= x.l AND x.a + x.l > 0)) AS tok_ar, len(list_filter(toks, lambda x: x.l > x.a)) AS tok_lat,
CASE WHEN a + l > 0 THEN least(10, (20 * a + a + l) // (2 * (a + l))) END AS arabic_bin FROM c""")
def text_f09_script_counts(spark: SparkSession, sf: str) -> DataFrame:
    (a, lat), (_, lw), (ta, tl), (s, _) = X.script_counts("text", "char_letters"), X.script_counts("text"), X.script_counts("text", "token"), X.script_counts("text", strict=True)
    return table(spark, sf, "tweets").filter("text is not null").select(
        "ord", a.alias("letters_ar"), lat.alias("letters_lat"), lw.alias("franco_lat"), s.alias("strict_ar"), ta.alias("tok_ar"), tl.alias("tok_lat"), X.arabic_bin("text").alias("arabic_bin")
    )


_LANGS = f"list_transform({_tok(_BARE)}, lambda w: CASE WHEN regexp_matches(w, '{P.ARABIC}') AND regexp_matches(w, '{P.LATIN_WORD}') THEN 'mixed' WHEN regexp_matches(w, '{P.ARABIC}') THEN 'ar' WHEN regexp_matches(w, '{P.LATIN_WORD}') THEN 'en' ELSE 'other' END)"


@r.query(f"""WITH l AS (SELECT ord, {_LANGS} AS g FROM tweets WHERE text IS NOT NULL), s AS (SELECT ord, g, len(list_filter(g, lambda x: x = 'ar')) AS a, len(list_filter(g, lambda x: x = 'en')) AS e, len(list_filter(g, lambda x: x <> 'other')) AS n, list_filter(g, lambda x: x IN ('ar', 'en')) AS q FROM l),
w AS (SELECT *, len(list_filter(range(1, len(q)), lambda i: q[i] <> q[i + 1])) AS sw FROM s)
SELECT ord, len(g) AS words, a AS arabic_words, e AS latin_words, round(CASE WHEN n > 0 THEN 100 * (1 - greatest(a, e) / n) ELSE 0.0 END, 6) AS cmi, sw AS switch_points, round(CASE WHEN len(q) > 1 THEN sw / (len(q) - 1) ELSE 0.0 END, 6) AS switch_point_fraction,
round(CASE WHEN len(g) > 0 THEN e / len(g) ELSE 0.0 END, 6) AS latin_word_share, CASE WHEN a > e THEN 'ar' WHEN e > a THEN 'en' ELSE 'tie' END AS dominant FROM w""")
def text_f10_code_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.code_mixing(table(spark, sf, "tweets").filter("text is not null").select("ord", "text")).drop("text")
    return rows.withColumns({n: F.round(n, 6) for n in ("cmi", "switch_point_fraction", "latin_word_share")})


@r.query(f"SELECT ord, array_to_string(list_concat({', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN ['{n}'] ELSE [] END" for n, p in P.CUES.items())}, CASE WHEN len({_tok('text')}) <= 4 THEN ['very_short'] ELSE [] END), ' ') AS cues FROM tweets WHERE text IS NOT NULL")
def text_f12_cues(spark: SparkSession, sf: str) -> DataFrame:
    tags = [F.when(F.col("text").rlike(p), F.lit(n)) for n, p in P.CUES.items()] + [F.when(F.size(X.tokenize("text")) <= 4, F.lit("very_short"))]
    return table(spark, sf, "tweets").filter("text is not null").select("ord", F.array_join(F.filter(F.array(*tags), lambda x: x.isNotNull()), " ").alias("cues"))


@r.query()
def text_f12_spam_hashtag(spark: SparkSession, sf: str) -> DataFrame:
    """Back-references, which RE2 has none of: no SQL."""
    return table(spark, sf, "tweets").filter(F.col("text").rlike(P.SPAM_HASHTAG)).select("ord")


REGIONS = {"gulf": ("bahrain", "kuwait", "oman", "qatar", "saudi_arabia", "uae"), "levant": ("jordan", "lebanon", "palestine", "syria")}
_CLEAN = f"trim({_sub(_sub(_sub('text', P.URL, ' URL '), P.HANDLE, ' USER '), ' {2,}', ' ')}, ' ')"
_REGION = "CASE " + " ".join(f"WHEN country IN {v} THEN '{k}'" for k, v in REGIONS.items()) + " ELSE country END"


@r.query(f"""WITH c AS (SELECT ord, {_CLEAN} AS text, {_REGION} AS dialect FROM tweets WHERE text IS NOT NULL), k AS (SELECT *, len({_tok('text')}) AS n, contains(text, 'URL') AND NOT regexp_matches(text, '{P.FIRST_PERSON}') AS news FROM c),
t AS (SELECT ord, list_filter([CASE WHEN news AND regexp_matches(text, '{P.BAD_NEWS}') THEN 'news_bad' WHEN news AND regexp_matches(text, '{P.GOOD_NEWS}') THEN 'news_good' END, CASE WHEN dialect IN {P.SHORT_DIALECTS} AND n <= 10 AND NOT contains(text, 'URL') THEN 'short_dialect' END, CASE WHEN regexp_matches(text, '{P.SINGER}') THEN 'lyric' END,
CASE WHEN n <= 14 AND contains(text, '#') AND regexp_matches(text, '{P.HEART}') AND NOT contains(text, 'URL') THEN 'fan_post' END], lambda x: x IS NOT NULL) AS types FROM k)
SELECT ord, unnest(CASE WHEN len(types) = 0 THEN ['other'] ELSE types END) AS kind FROM t""")
def text_f11_keyword_types(spark: SparkSession, sf: str) -> DataFrame:
    region = F.when(F.col("country").isin(*REGIONS["gulf"]), "gulf").when(F.col("country").isin(*REGIONS["levant"]), "levant").otherwise(F.col("country"))
    rows = table(spark, sf, "tweets").filter("text is not null").select("ord", X.clean_text("text")[0].alias("text"), region.alias("dialect"))
    return rows.select("ord", F.explode(X.keyword_types("text", "dialect")).alias("kind"))


_CWORDS = f"list_filter(list_transform(regexp_extract_all({_BARE}, '{P.CONNECTIVE_WORD.replace(chr(39), chr(39) * 2)}'), lambda w: lower(regexp_replace(w, '[\\x{{640}}\\x{{64b}}-\\x{{652}}]', '', 'g'))), lambda w: w <> '')"
_LEXICON = "(VALUES " + ", ".join(f"('{e.id}', {[*e.words]}, '{e.pattern}', '{e.position}')" for e in codemix.lexicon()) + ") c(id, toks, pattern, position)"


@r.query(f"""WITH t AS (SELECT ord, {_CWORDS} AS w FROM tweets WHERE text IS NOT NULL),
h AS (SELECT t.ord, c.id, c.pattern, list_filter(range(1, len(w) - len(toks) + 2), lambda i: w[i:i + len(toks) - 1] = toks AND (position <> 'medial' OR (i - 1 >= 2 AND len(w) - i - len(toks) + 1 >= 2)) AND (position <> 'any' OR len(w) - len(toks) >= 4)) AS pos, len(toks) AS n
FROM t JOIN {_LEXICON} ON list_contains(t.w, c.toks[1]))
SELECT ord, id, pattern, pos[1] - 1 AS "start", pos[1] - 1 + n AS stop FROM h WHERE len(pos) > 0""")
def text_f16_connectives(spark: SparkSession, sf: str) -> DataFrame:
    return codemix.find_connectives(table(spark, sf, "tweets").filter("text is not null"), "ord", "text").select("ord", "id", "pattern", "start", "stop")


@r.query("SELECT ord, k FROM (SELECT ord, list_sum(map_values(labels)) AS k FROM quality_rows WHERE labels IS NOT NULL) WHERE k BETWEEN 1 AND 17")
def text_f01_cardinality_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.aggregate(F.map_values("labels"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return table(spark, sf, "quality_rows").filter("labels is not null").select("ord", k.alias("k")).filter("k between 1 and 17")


@r.query("SELECT ord, CASE WHEN len(v) = 1 THEN v[1] END AS target FROM (SELECT ord, list_filter(map_keys(labels), lambda k: labels[k] = 1) AS v FROM quality_rows WHERE labels IS NOT NULL)")
def text_f21_target(spark: SparkSession, sf: str) -> DataFrame:
    valid = F.map_keys(F.map_filter("labels", lambda k, v: v == 1))
    return table(spark, sf, "quality_rows").filter("labels is not null").select("ord", F.when(F.size(valid) == 1, valid[0]).alias("target"))


def _q(x: str) -> str:
    return x.replace("'", "''")


def line_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace(trim({x}, ' '), '{_q(P.LIST_PREFIX)}', ''), '{_q(P.LABEL_PREFIX)}', '')"
    return f"trim(trim(trim({s}, ' '), '{_q(P.QUOTES)}'), ' ')"


def parse_sql(raw: str, n: int, arabizi: bool = False) -> str:
    low = "lower(trim(x, ' '))"
    kept = f"list_filter(str_split(replace({raw}, chr(13), ''), chr(10)), lambda x: trim(x, ' ') <> '' AND NOT ends_with({low}, ':') AND NOT ({' OR '.join(f"starts_with({low}, '{_q(p)}')" for p in P.PREAMBLES)}))"
    wanted = f"NOT regexp_matches(x, '{P.ARABIC}') AND regexp_matches(x, '{P.LATIN}')" if arabizi else f"regexp_matches(x, '{P.ARABIC}')"
    return f"list_filter(list_transform({kept}, lambda x: {line_sql('x')}), lambda x: x <> '' AND {wanted})[1:{n}]"


def bare_sql(x: str) -> tuple[str, str]:
    head, tail = f"regexp_replace({x}, '{_q(P.TRANSLATION_TAIL)}', '')", "[ \\-–—|:(\\[]+$"
    cut = f"(regexp_matches({x}, '{_q(P.TRANSLATION_TAIL)}') AND {head} <> '' AND regexp_matches({head}, '{P.ARABIC}'))"
    return f"CASE WHEN {cut} THEN trim(regexp_replace({head}, '{tail}', ''), ' ') ELSE {x} END", cut


@r.query(f"SELECT ord, {parse_sql('raw_output', 1)} AS parsed, {parse_sql('raw_output', 3, True)} AS arabizi FROM synthetic")
def text_p11_parse_output(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "synthetic").select("ord", X.parse_output("raw_output").alias("parsed"), X.parse_output("raw_output", 3, "arabizi").alias("arabizi"))


@r.query(f"SELECT ord, {bare_sql('raw_output')[0]} AS text, {bare_sql('raw_output')[1]} AS cut FROM synthetic")
def text_p12_strip_translation(spark: SparkSession, sf: str) -> DataFrame:
    t, cut = X.strip_translation("raw_output")
    return table(spark, sf, "synthetic").select("ord", t.alias("text"), cut.alias("cut"))


@r.query(f"""WITH l AS (SELECT ord, list_filter(list_transform(str_split(replace(replace(raw_output, chr(13), ''), '**', ''), chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '{_q(P.PAIR_LINE)}')) AS lines FROM synthetic),
e AS (SELECT ord, list_filter(list_transform(lines, lambda x: {{'role': translate(upper(regexp_extract(x, '{_q(P.PAIR_LINE)}', 1)), 'أب', 'AB'), 'text': {line_sql(f"regexp_extract(x, '{_q(P.PAIR_LINE)}', 2)")}}}), lambda e: e.text <> '' AND regexp_matches(e.text, '{P.ARABIC}')) AS es FROM l)
SELECT ord, list_filter(es, lambda e: e.role = 'A')[1].text AS a, list_filter(es, lambda e: e.role = 'B')[1].text AS b FROM e""")
def text_p13_parse_pair(spark: SparkSession, sf: str) -> DataFrame:
    pair = table(spark, sf, "synthetic").select("ord", X.parse_pair("raw_output").alias("pair"))
    return pair.select("ord", F.try_element_at("pair", F.lit("A")).alias("a"), F.try_element_at("pair", F.lit("B")).alias("b"))


@r.query(f"""WITH p AS (SELECT text AS old, {parse_sql('raw_output', 1)}[1] AS f FROM synthetic), s AS (SELECT old, {bare_sql('f')[0]} AS text FROM p), c AS (SELECT old, CASE WHEN text <> '' THEN {_CLEAN} END AS new FROM s)
SELECT count(*) AS n, count_if(old IS DISTINCT FROM new) AS n_changed, count_if(new IS NULL) AS n_unparsed FROM c""")
def text_p14_reparse(spark: SparkSession, sf: str) -> DataFrame:
    """The parsers run again over every stored output."""
    new = table(spark, sf, "synthetic").select("text", X.reparsed("raw_output").alias("new"))
    return new.agg(F.count("*").alias("n"), F.count_if(~F.col("text").eqNullSafe(F.col("new"))).alias("n_changed"), F.count_if(F.col("new").isNull()).alias("n_unparsed"))


@r.query(f"SELECT ord, {', '.join(f'(target_dialect IS NOT DISTINCT FROM {d!r})::INT AS {d}' for d in P.DIALECTS)} FROM synthetic")
def text_p15_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    m = X.one_hot(F.coalesce("target_dialect", F.lit("")))
    return table(spark, sf, "synthetic").select("ord", *[m[d].alias(d) for d in P.DIALECTS])


@r.query("SELECT ord, 'Write a ' || coalesce(sentiment, 'any') || ' post in ' || variety || '.' || coalesce(array_to_string(list_transform(few_shot_texts, lambda t: chr(10) || '- ' || t), ''), '') AS prompt FROM requests")
def text_p16_prompts(spark: SparkSession, sf: str) -> DataFrame:
    shots = F.coalesce(F.array_join(F.transform("few_shot_texts", lambda t: F.concat(F.lit("\n- "), t)), ""), F.lit(""))
    return table(spark, sf, "requests").select("ord", F.concat(F.lit("Write a "), F.coalesce("sentiment", F.lit("any")), F.lit(" post in "), "variety", F.lit("."), shots).alias("prompt"))

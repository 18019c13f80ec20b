"""Problem 6: text values cut off by field limits or in transfer, in SQL over counts of word trigrams inside texts and at their ends.

A value is cut if its final words are frequent inside texts but almost never terminal: the terminal rate of the final trigram is
smoothed by that of the final bigram, this by that of the last word, and this by that of words of the same shape; ends that a limit
may have made don't count as ends. Where a final word hardly occurs but as the beginning of longer words, their occurrences inside
texts are its own, as it went on there. A rate below RARELY is enough where something else points to a cut: wrapping (JSON, code fence,
quotation mark) that stays open, a broken character, a mark set by a limit, or a limit reached, a limit being a length, in characters
or bytes, at which values pile up in a source and that few exceed. Only where the rate doesn't tell, these signs decide alone, as do
parts of links, of hashtags and of words too rare for a rate. A complete text that just fits stays complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import durable

# Rates relative to the terminal rate of all words, without and with a limit reached; a part of a word, by how often words go on after it.
NEVER, RARELY = 0.03, 1.0
SEEN = 40  # occurrences of a final word that show it to be never terminal
PART, PART_AT_LIMIT = 60.0, 4.0

HAN = r"\x{0e00}-\x{0e7f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
PATTERNS = {
    "APART": rf"([{HAN}])",
    "WORD": rf"[\p{{L}}\p{{M}}\p{{N}}’{HAN}]+",
    "INVISIBLE": r"[\p{Cf}\x{34f}\x{fe00}-\x{fe0f}\x{640}\x{64b}-\x{65f}\x{670}]",
    "EMOJI": r"[\p{So}\p{Sk}\x{1f3fb}-\x{1f3ff}]$",
    "FINAL": r"[.!?؟。！？۔｡॥।‼⁉][\x{22}”»)\]]?$",
    "LINK": r"(?:^|\s)(h(?:t(?:t(?:p(?:s?(?::(?:/(?:/\S*)?)?)?)?)?)?)?)$",
    "HOST": r"^(https?://[^/]+/(?:[^?]*\?v=)?)",
    "FENCED": r"(?s)^\s*```.*\S\s*```$",
}

_PREPARE = r"""
WITH bare AS (
  SELECT tbl, ord, grp, capped, value RLIKE r'\s$' AS space, length(value) AS n_chars, octet_length(encode(value, 'UTF-8')) AS n_bytes,
         regexp_replace(regexp_replace(value, r'@INVISIBLE@', ''), r'\s+$', '') AS v
  FROM _lexmill_values WHERE value IS NOT NULL AND trim(value) <> ''),
wrapped AS (
  SELECT *,
    CASE WHEN v RLIKE r'^\s*```' THEN IF(v RLIKE r'@FENCED@', 'closed', 'open')
         WHEN v RLIKE r'^\s*[{\[]' THEN IF(v RLIKE r'[}\]]$', 'closed', 'open')
         WHEN v RLIKE r'^\s*[\x{22}“«]' AND v RLIKE r'.[\x{22}”»]$' THEN 'closed'
         WHEN v RLIKE r'^\s*[\x{22}“«]' AND size(regexp_extract_all(v, r'[\x{22}“”«»]', 0)) % 2 = 1 THEN 'open'
         ELSE 'none' END AS wrap
  FROM bare),
ends AS (
  SELECT *, regexp_replace(v, r'(?:\s|…|\.{2,}|\x{fffd})+$', '') AS core, v RLIKE r'(?:…|\.{2,})$' AS dots, v RLIKE r'\x{fffd}\W{0,3}$' AS broken FROM wrapped)
SELECT tbl, ord, grp, capped, space, n_chars, n_bytes, wrap, dots, v RLIKE r'…$' AS mark, core RLIKE r'@\S+$' AS mail, broken, core RLIKE r'@FINAL@' AND NOT dots AS final, core RLIKE r'@EMOJI@' AS emoji,
       nullif(regexp_extract(core, r'@LINK@', 1), '') AS link, nullif(regexp_extract(core, r'#([^\s#]*)$', 1), '') AS tag,
       regexp_extract_all(regexp_replace(lower(core), r'@APART@', ' $1 '), r'@WORD@', 0) AS words
FROM ends"""


def _sql(text: str, tag: str) -> str:
    """The SQL with its patterns, over the views of one call."""
    for name, pattern in PATTERNS.items():
        text = text.replace(f"@{name}@", pattern)
    return text.replace("_lexmill_", f"_lexmill_{tag}_")


_LIMITS = r"""
WITH lengths AS (
  SELECT grp, unit, len, count(*) AS n FROM (SELECT grp, length(value) AS n_chars, octet_length(encode(value, 'UTF-8')) AS n_bytes FROM _lexmill_values WHERE value IS NOT NULL AND trim(value) <> '' AND NOT value RLIKE r'[}\]`\x{22}]\s*$')
  LATERAL VIEW stack(2, 'chars', n_chars, 'bytes', n_bytes) s AS unit, len GROUP BY grp, unit, len),
near AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY grp, unit ORDER BY len RANGE BETWEEN 12 PRECEDING AND 3 PRECEDING), 0) / 10.0 AS before,
         coalesce(sum(n) OVER (PARTITION BY grp, unit ORDER BY len RANGE BETWEEN 4 FOLLOWING AND 13 FOLLOWING), 0) / 10.0 AS after,
         coalesce(sum(n) OVER (PARTITION BY grp, unit ORDER BY len RANGE BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS beyond, sum(n) OVER (PARTITION BY grp, unit) AS total
  FROM lengths),
at AS (SELECT grp, unit, len FROM near WHERE n >= 4 AND n > 4 * before + 2 AND n > 4 * after + 2 AND beyond <= 0.1 * total AND len > 20)
SELECT grp, collect_list(IF(unit = 'chars', len, NULL)) AS chars, collect_list(IF(unit = 'bytes', len, NULL)) AS bytes FROM at GROUP BY grp"""

_MARKED = """
WITH m AS (
  SELECT p.*, coalesce(capped, false) OR coalesce(exists(chars, x -> n_chars BETWEEN x - 1 AND x), false) OR coalesce(exists(bytes, x -> n_bytes BETWEEN x - 3 AND x + 2), false) AS at_limit
  FROM _lexmill_prepared p LEFT JOIN _lexmill_limits g USING (grp)),
t AS (SELECT *, NOT at_limit AND wrap <> 'open' AND NOT broken AND NOT dots AND link IS NULL AND tag IS NULL AND size(words) > 0 AS trusted,
             final OR emoji OR mail OR (dots AND NOT at_limit) AS ended FROM m)
SELECT tbl, ord, grp, at_limit, trusted, link, tag, words,
  wrap = 'closed' OR (NOT broken AND wrap <> 'open' AND link IS NULL AND NOT (at_limit AND mark) AND (ended OR (size(words) = 0 AND NOT (at_limit AND space)))) AS complete,
  CASE WHEN broken THEN 'broken character' WHEN wrap = 'open' THEN 'open wrapping' WHEN link IS NOT NULL THEN NULL WHEN at_limit AND mark THEN 'mark of a cut' WHEN at_limit AND space AND NOT ended THEN 'between words' END AS other
FROM t"""

# Grams of two and three words as hashes, with their counts inside and at ends.
_GRAMS = """
WITH z AS (SELECT trusted, size(words) AS n, posexplode(arrays_zip(words, slice(words, 2, size(words)), slice(words, 3, size(words)))) AS (p, z) FROM _lexmill_marked WHERE size(words) > 1),
g AS (SELECT stack(2, IF(p + 1 < n, xxhash64(2, z.words, z.`1`, ''), NULL), p + 2, IF(p + 2 < n, xxhash64(3, z.words, z.`1`, z.`2`), NULL), p + 3) AS (h, upto), n, trusted FROM z)
SELECT h, count_if(upto < n) AS n_in, count_if(upto = n AND trusted) AS n_end FROM g WHERE h IS NOT NULL GROUP BY h"""

# How often words go on after a final word: its hash among those of the beginnings of words, beginnings longer than any final word left out.
_WORDS = """
WITH t AS (SELECT w, p + 1 < size(words) AS inside, trusted FROM _lexmill_marked LATERAL VIEW posexplode(words) x AS p, w),
c1 AS (SELECT w, count_if(inside) AS n_in, count_if(NOT inside AND trusted) AS n_end FROM t GROUP BY w),
c0 AS (SELECT concat(left(w, 2), '_', right(w, 1)) AS shape, sum(n_in) AS n_in, sum(n_end) AS n_end FROM c1 GROUP BY 1),
f AS (SELECT DISTINCT get(words, size(words) - 1) AS w FROM _lexmill_marked WHERE NOT complete AND link IS NULL AND size(words) > 0),
k AS (SELECT coalesce(max(length(w)), 0) AS most FROM f),
b AS (SELECT explode(transform(sequence(1, least(length(w) - 1, most)), k -> xxhash64(left(w, k)))) AS h, n_in FROM c1, k WHERE length(w) > 1 AND n_in > 0 AND most > 0),
parts AS (SELECT f.w, sum(b.n_in) AS n_on FROM b JOIN f ON b.h = xxhash64(f.w) GROUP BY f.w)
SELECT c1.w, c1.n_in, c1.n_end, coalesce(p.n_on, 0) AS n_on, c0.n_in AS s_in, c0.n_end AS s_end
FROM c1 JOIN c0 ON c0.shape = concat(left(w, 2), '_', right(w, 1)) LEFT JOIN parts p ON p.w = c1.w"""

_LINKED = r"""
WITH l AS (SELECT tbl, ord, grp, at_limit, link, other, complete, regexp_extract(link, r'@HOST@', 1) AS host FROM _lexmill_marked WHERE link IS NOT NULL),
n AS (SELECT host, length(link) AS len, count(*) AS n FROM l WHERE host <> '' GROUP BY host, len),
usual AS (SELECT host, len FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, len) AS place FROM n) WHERE place = 1)
SELECT tbl, ord, grp, at_limit, CASE WHEN complete THEN NULL WHEN other IS NOT NULL THEN other WHEN u.len IS NULL OR length(link) < u.len THEN 'part of a link' END AS sign FROM l LEFT JOIN usual u ON u.host = l.host"""

_JUDGED = f"""
WITH f AS (
  SELECT tbl, ord, grp, at_limit, other, at_limit OR other IS NOT NULL AS doubtful, tag IS NOT NULL AS tagged, int(trusted) AS own, get(words, size(words) - 1) AS w,
         IF(size(words) > 1, xxhash64(2, get(words, size(words) - 2), get(words, size(words) - 1), ''), NULL) AS h2,
         IF(size(words) > 2, xxhash64(3, get(words, size(words) - 3), get(words, size(words) - 2), get(words, size(words) - 1)), NULL) AS h3
  FROM _lexmill_marked WHERE link IS NULL AND NOT complete AND size(words) > 0),
o AS (SELECT sum(n_end) / greatest(1, sum(n_in) + sum(n_end)) AS r FROM _lexmill_words),
a AS (SELECT f.*, c.n_on >= IF(at_limit, {PART_AT_LIMIT}, {PART}) * (c.n_in + 0.1) AS part, c.n_in, c.n_on, greatest(0, c.n_end - own) AS e1, greatest(0, c.n_in + c.n_end - own) AS a0, c.s_in, c.s_end FROM f JOIN _lexmill_words c ON c.w = f.w),
p AS (SELECT a.*, a0 + IF(part, n_on, 0) AS a1 FROM a),
b AS (SELECT a.*, greatest(0, coalesce(g.n_end, 0) - own) AS e2, greatest(0, coalesce(g.n_end + g.n_in, 0) - own) AS a2 FROM p a LEFT JOIN _lexmill_grams g ON g.h = a.h2),
c AS (SELECT b.*, greatest(0, coalesce(g.n_end, 0) - own) AS e3, greatest(0, coalesce(g.n_end + g.n_in, 0) - own) AS a3 FROM b LEFT JOIN _lexmill_grams g ON g.h = b.h3),
s AS (SELECT c.*, (e3 + 20 * (e2 + 20 * (e1 + 10 * ((s_end - own + 20 * r) / (s_in + s_end - own + 20))) / (a1 + 10)) / (a2 + 20)) / (a3 + 20) / greatest(r, 1e-9) AS ratio FROM c, o)
SELECT tbl, ord, grp, at_limit,
  CASE WHEN NOT tagged AND ratio < IF(doubtful, {RARELY}, {NEVER}) AND (doubtful OR a1 >= {SEEN}) THEN 'never terminal'
       WHEN part THEN 'part of a word'
       WHEN other IS NOT NULL THEN other
       WHEN tagged AND at_limit AND n_in = 0 THEN 'part of a hashtag' END AS sign
FROM s"""


def judged(rows: DataFrame) -> DataFrame:
    """(tbl, ord, grp, at_limit, sign) for each (tbl, ord, grp, value, capped) whose value isn't null or blank; ``sign`` says why it is cut, or is null.

    ``capped`` says whether the maker of the value ran into its own limit. Values without words are judged by their wrapping only;
    repeated rows are judged each; empty tables give none; whole values are counted, however long.
    """
    spark, tag = rows.sparkSession, uuid.uuid4().hex

    def view(name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(f"_lexmill_{tag}_{name}")

    view("values", rows)
    view("prepared", spark.sql(_sql(_PREPARE, tag)))
    view("limits", durable(spark.sql(_sql(_LIMITS, tag))))
    view("marked", durable(spark.sql(_sql(_MARKED, tag))))
    view("grams", durable(spark.sql(_sql(_GRAMS, tag))))
    view("words", durable(spark.sql(_sql(_WORDS, tag))))
    decided = spark.sql(_sql("SELECT tbl, ord, grp, at_limit, IF(complete, NULL, other) AS sign FROM _lexmill_marked WHERE link IS NULL AND (complete OR size(words) = 0)", tag))
    return decided.unionByName(spark.sql(_sql(_LINKED, tag))).unionByName(spark.sql(_sql(_JUDGED, tag)))


def sql(values: str) -> str:
    """The same in the SQL of another engine, over a query ``values`` of (tbl, ord, grp, value, capped): CTEs that end in ``judged``."""
    pat = {k: v.replace("'", "''") for k, v in PATTERNS.items()}
    words = "words[-1]"
    return f"""
WITH vals AS ({values}), bare AS (
  SELECT tbl, ord, grp, capped, regexp_matches(value, '\\s$') AS space, length(value) AS n_chars, octet_length(encode(value)) AS n_bytes,
         regexp_replace(regexp_replace(value, '{pat["INVISIBLE"]}', '', 'g'), '\\s+$', '') AS v FROM vals WHERE value IS NOT NULL AND trim(value, ' ') <> ''),
wrapped AS (SELECT *, CASE WHEN regexp_matches(v, '^\\s*```') THEN CASE WHEN regexp_matches(v, '{pat["FENCED"]}') THEN 'closed' ELSE 'open' END
  WHEN regexp_matches(v, '^\\s*[{{\\[]') THEN CASE WHEN regexp_matches(v, '[}}\\]]$') THEN 'closed' ELSE 'open' END
  WHEN regexp_matches(v, '^\\s*[\\x{{22}}“«]') AND regexp_matches(v, '.[\\x{{22}}”»]$') THEN 'closed'
  WHEN regexp_matches(v, '^\\s*[\\x{{22}}“«]') AND len(regexp_extract_all(v, '[\\x{{22}}“”«»]')) % 2 = 1 THEN 'open' ELSE 'none' END AS wrap FROM bare),
ends AS (SELECT *, regexp_replace(v, '(?:\\s|…|\\.{{2,}}|\\x{{fffd}})+$', '') AS core, regexp_matches(v, '(?:…|\\.{{2,}})$') AS dots, regexp_matches(v, '\\x{{fffd}}\\W{{0,3}}$') AS broken FROM wrapped),
prepared AS (SELECT tbl, ord, grp, capped, space, n_chars, n_bytes, wrap, dots, regexp_matches(v, '…$') AS mark, regexp_matches(core, '@\\S+$') AS mail, broken,
  regexp_matches(core, '{pat["FINAL"]}') AND NOT dots AS final, regexp_matches(core, '{pat["EMOJI"]}') AS emoji, nullif(regexp_extract(core, '{pat["LINK"]}', 1), '') AS link,
  nullif(regexp_extract(core, '#([^\\s#]*)$', 1), '') AS tag, regexp_extract_all(regexp_replace(lower(core), '{pat["APART"]}', ' \\1 ', 'g'), '{pat["WORD"]}') AS words FROM ends),
sized AS (SELECT grp, length(value) AS n_chars, octet_length(encode(value)) AS n_bytes FROM vals WHERE value IS NOT NULL AND trim(value, ' ') <> '' AND NOT regexp_matches(value, '[}}\\]`\\x{{22}}]\\s*$')),
lengths AS (SELECT grp, unit, len, count(*) AS n FROM (SELECT grp, 'chars' AS unit, n_chars AS len FROM sized UNION ALL SELECT grp, 'bytes', n_bytes FROM sized) GROUP BY ALL),
near AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp, unit ORDER BY len RANGE BETWEEN 12 PRECEDING AND 3 PRECEDING), 0) / 10.0::DOUBLE AS before,
  coalesce(sum(n) OVER (PARTITION BY grp, unit ORDER BY len RANGE BETWEEN 4 FOLLOWING AND 13 FOLLOWING), 0) / 10.0::DOUBLE AS after,
  coalesce(sum(n) OVER (PARTITION BY grp, unit ORDER BY len RANGE BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS beyond, sum(n) OVER (PARTITION BY grp, unit) AS total FROM lengths),
lim AS (SELECT grp, unit, len FROM near WHERE n >= 4 AND n > 4 * before + 2 AND n > 4 * after + 2 AND beyond <= 0.1::DOUBLE * total AND len > 20),
m AS (SELECT p.*, coalesce(capped, false) OR EXISTS (SELECT 1 FROM lim WHERE lim.grp = p.grp AND ((unit = 'chars' AND n_chars BETWEEN len - 1 AND len) OR (unit = 'bytes' AND n_bytes BETWEEN len - 3 AND len + 2))) AS at_limit FROM prepared p),
t AS (SELECT *, NOT at_limit AND wrap <> 'open' AND NOT broken AND NOT dots AND link IS NULL AND tag IS NULL AND len(words) > 0 AS trusted, final OR emoji OR mail OR (dots AND NOT at_limit) AS ended FROM m),
marked AS (SELECT tbl, ord, grp, at_limit, trusted, link, tag, words, len(words) AS nw,
  wrap = 'closed' OR (NOT broken AND wrap <> 'open' AND link IS NULL AND NOT (at_limit AND mark) AND (ended OR (len(words) = 0 AND NOT (at_limit AND space)))) AS complete,
  CASE WHEN broken THEN 'broken character' WHEN wrap = 'open' THEN 'open wrapping' WHEN link IS NOT NULL THEN NULL WHEN at_limit AND mark THEN 'mark of a cut' WHEN at_limit AND space AND NOT ended THEN 'between words' END AS other FROM t),
each_word AS (SELECT words, nw, trusted, unnest(range(1, nw + 1)) AS p FROM marked),
c1 AS (SELECT words[p] AS w, count_if(p < nw) AS n_in, count_if(p = nw AND trusted) AS n_end FROM each_word GROUP BY w),
g2 AS (SELECT words[p - 1] AS x, words[p] AS w, count_if(p < nw) AS n_in, count_if(p = nw AND trusted) AS n_end FROM each_word WHERE p > 1 GROUP BY ALL),
g3 AS (SELECT words[p - 2] AS y, words[p - 1] AS x, words[p] AS w, count_if(p < nw) AS n_in, count_if(p = nw AND trusted) AS n_end FROM each_word WHERE p > 2 GROUP BY ALL),
c0 AS (SELECT left(w, 2) || '_' || right(w, 1) AS shape, sum(n_in) AS s_in, sum(n_end) AS s_end FROM c1 GROUP BY shape),
fin AS (SELECT DISTINCT {words} AS w FROM marked WHERE NOT complete AND link IS NULL AND nw > 0),
starts AS (SELECT left(w, k) AS b, n_in FROM (SELECT w, n_in, unnest(range(1, length(w))) AS k FROM c1 WHERE n_in > 0)),
onw AS (SELECT fin.w, sum(n_in) AS n_on FROM fin JOIN starts ON b = fin.w GROUP BY fin.w),
hosts AS (SELECT tbl, ord, grp, at_limit, link, other, complete, regexp_extract(link, '{pat["HOST"]}', 1) AS host FROM marked WHERE link IS NOT NULL),
usual AS (SELECT host, len FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, len) AS place FROM (SELECT host, length(link) AS len, count(*) AS n FROM hosts WHERE host <> '' GROUP BY 1, 2)) WHERE place = 1),
o AS (SELECT sum(n_end) / greatest(1, sum(n_in) + sum(n_end)) AS r FROM c1),
f AS (SELECT tbl, ord, grp, at_limit, other, at_limit OR other IS NOT NULL AS doubtful, tag IS NOT NULL AS tagged, trusted::INT AS own, {words} AS w, words[-2] AS x, words[-3] AS y FROM marked WHERE link IS NULL AND NOT complete AND nw > 0),
s AS (SELECT f.*, c1.n_in, coalesce(n_on, 0) AS n_on, greatest(0, c1.n_end - own) AS e1, coalesce(n_on, 0) >= CASE WHEN at_limit THEN {PART_AT_LIMIT} ELSE {PART} END * (c1.n_in + 0.1) AS part, greatest(0, c1.n_in + c1.n_end - own) + CASE WHEN part THEN coalesce(n_on, 0) ELSE 0 END AS a1, s_in, s_end, greatest(0, coalesce(g2.n_end, 0) - own) AS e2, greatest(0, coalesce(g2.n_end + g2.n_in, 0) - own) AS a2,
  greatest(0, coalesce(g3.n_end, 0) - own) AS e3, greatest(0, coalesce(g3.n_end + g3.n_in, 0) - own) AS a3
  FROM f JOIN c1 ON c1.w = f.w JOIN c0 ON shape = left(f.w, 2) || '_' || right(f.w, 1) LEFT JOIN onw ON onw.w = f.w LEFT JOIN g2 ON g2.w = f.w AND g2.x = f.x LEFT JOIN g3 ON g3.w = f.w AND g3.x = f.x AND g3.y = f.y),
q AS (SELECT s.*, (e3 + 20 * (e2 + 20 * (e1 + 10 * ((s_end - own + 20 * r) / (s_in + s_end - own + 20))) / (a1 + 10)) / (a2 + 20)) / (a3 + 20) / greatest(r, 1e-9) AS ratio FROM s, o),
judged AS (SELECT tbl, ord, grp, at_limit, CASE WHEN complete THEN NULL ELSE other END AS sign FROM marked WHERE link IS NULL AND (complete OR nw = 0)
  UNION ALL SELECT tbl, ord, grp, at_limit, CASE WHEN complete THEN NULL WHEN other IS NOT NULL THEN other WHEN len IS NULL OR length(link) < len THEN 'part of a link' END FROM hosts LEFT JOIN usual USING (host)
  UNION ALL SELECT tbl, ord, grp, at_limit, CASE WHEN NOT tagged AND ratio < CASE WHEN doubtful THEN {RARELY} ELSE {NEVER} END AND (doubtful OR a1 >= {SEEN}) THEN 'never terminal'
       WHEN part THEN 'part of a word' WHEN other IS NOT NULL THEN other WHEN tagged AND at_limit AND n_in = 0 THEN 'part of a hashtag' END FROM q)
"""


def rates(found: DataFrame) -> DataFrame:
    """How often each source truncates: (tbl, grp, n_values, n_cut, share)."""
    return found.groupBy("tbl", "grp").agg(F.count("*").alias("n_values"), F.count("sign").alias("n_cut"), (F.count("sign") / F.count("*")).alias("share"))

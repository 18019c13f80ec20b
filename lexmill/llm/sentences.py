"""Problem 10: sentence boundaries across languages and scripts, by semi-Markov dynamic programming over whole sentence spans.

Places where a sentence could end are final marks with what closes them, gaps of scripts without spaces, and line breaks, which
always end it. The best sequence of spans is chosen; a span's score joins its length, its opening word, its closing word with its
mark, and the balance of its quotations. Opening and closing words and abbreviations are learnt from all documents: words at the
borders of lines against words inside them, and words that hardly occur without a dot. Words so rare that their scores can't be sent
to every task are neutral at borders; rare abbreviations come to the documents that hold them by a join.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import reduce
from math import log
from operator import or_

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import durable

KEPT_SHARE = 1 / 100_000  # words with this share of a role's counts or more are kept with their counts in all roles: at most 100,000 a role
USUAL_WORDS = 11.0
ABBREVIATION = 6  # letters at most

CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
OPEN, CLOSE = "«“「『‘（([【《", "»”」』’）)]】》"
PAIRS = dict(zip(CLOSE, OPEN))
_EMOJI = r"(?:[\p{So}\p{Sk}\U0001F3FB-\U0001F3FF]️?‍?)"
_MARK = re.compile(r"[.!?؟…۔。！？｡।⁉‼]+")
_TAIL = regex.compile(rf"(?P<close>(?:[ \t]?[»”」』’）)\]】》\"](?![\p{{L}}\p{{N}}]))*)(?P<emoji>(?:[ \t]*{_EMOJI}+)*)")
_GAP = regex.compile(rf"(?<=[฀-๿]|น\.)[ \t]+(?=[฀-๿])|(?<=[{CJK}])[ \t　]+(?=[{CJK}])")
_SPACELESS = re.compile(f"[฀-๿{CJK}]")
_QUOTE = re.compile("[\"" + re.escape(OPEN.replace("‘", "") + CLOSE.replace("’", "")) + "]")
_ADDRESS = re.compile(r"://|www\.|/|@")
_SPACE = re.compile(r"\s")
_LINE = regex.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_WORD = re.compile(r"[^\W_](?:[\w'’‌̀-ًͯ-ٰٟ]|\.(?=[^\W_]))*")
_ANY_WORD = regex.compile(rf"[{CJK}]{{1,2}}|[฀-๿]{{1,4}}|[[\p{{L}}\p{{M}}\p{{N}}]--[{CJK}฀-๿]](?:[[\p{{L}}\p{{M}}\p{{N}}'’‌]--[{CJK}฀-๿]]|\.(?=[\p{{L}}\p{{N}}]))*", regex.V1)
_TRIM = " \t   　​"
_BLANK = re.compile(f"[{_TRIM}]*")
_AFTER_WORD = frozenset(".!?؟…۔。！？»”\"(«“")


def _tokens(line: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of a line; scripts without spaces give pieces of a few letters."""
    pattern = _ANY_WORD if _SPACELESS.search(line) else _WORD
    return [(m[0], *m.span()) for m in pattern.finditer(line)]


def tally_of(text: str) -> Counter:
    """Counts of (role, word): opening and closing words of lines, words inside, words with a dot and without."""
    found: list[tuple[str, str]] = []
    for line in _LINE.findall(text):
        words = _tokens(line)
        if len(words) < 3:
            continue
        padded = line + "  "
        found.append(("open", words[0][0].lower()))
        found.append(("close", words[-1][0].lower()))
        for (w, _, e), (follows, _, _) in zip(words[1:-1], words[2:]):
            after = padded[e]
            if after == "." and padded[e + 1] in " -":
                found.append(("dot", w.lower()))
                if not w[0].islower() or not follows[0].isupper() or len(follows) == 1:
                    found.append(("inside", w.lower()))  # what follows doesn't look like an opening word
            else:
                w = w.lower()
                found.append(("plain", w))
                if after not in _AFTER_WORD:
                    found.append(("in", w))
    return Counter(found)


class Words:
    """Scores of words in their roles; a word that isn't frequent is neutral.

    ``counts`` holds all counts of each of its words; ``totals`` the sums of roles over all words, those not in ``counts`` too.
    """

    def __init__(self, counts: dict[tuple[str, str], int], totals: dict[str, int] | None = None):
        total = {r: (totals or {}).get(r) or sum(n for (role, _), n in counts.items() if role == r) or 1 for r in ("open", "close", "in")}
        get = lambda r, w: counts.get((r, w), 0)
        words = {w for _, w in counts}
        least = {r: min(total[r], total["in"]) for r in ("open", "close")}
        rate = lambda r, w, least: (get(r, w) + 2.0 * total[r] / least) / total[r]  # noqa: E731 - few counts give nearly equal rates, however unequal the totals
        ratio = lambda r, w: log(rate(r, w, least[r]) / rate("in", w, least[r]))
        self.opens = {w: max(-4.0, min(3.0, ratio("open", w))) for w in words if get("open", w) + get("in", w) >= 4}
        self.closes = {w: max(-4.0, min(3.0, ratio("close", w))) for w in words if get("close", w) + get("in", w) >= 4}
        self.short = {w for w in words if get("dot", w) >= 3 and 2 * get("inside", w) >= get("dot", w) and get("dot", w) >= 0.8 * (get("dot", w) + get("plain", w) + get("close", w)) and len(w) <= ABBREVIATION}


def _ends(line: str) -> list[tuple[int, int, str, str]]:
    """(end, next start, kind of mark, closing quotes) of the places inside a line where a sentence could end."""
    out = []
    upto = 0
    addresses = [(m.start(), m.end()) for m in _ADDRESS.finditer(line)]
    blanks = [m.start() for m in _SPACE.finditer(line)] if addresses else []

    def in_address(end: int) -> bool:
        """Whether a sign of an address stands before ``end`` without white space between."""
        k = bisect_right(addresses, end, key=lambda a: a[1]) - 1
        if k < 0:
            return False
        b = bisect_left(blanks, end) - 1
        return b < 0 or blanks[b] < addresses[k][0]

    for m in _MARK.finditer(line):
        if m.start() < upto:
            continue
        t = _TAIL.match(line, m.end())
        e, mark, close, emoji = t.end(), m[0], t["close"], t["emoji"]
        upto, nxt = e, line[e : e + 1]
        wide = mark[-1] in "。！？｡"
        if nxt and not nxt.isspace() and nxt not in OPEN and nxt != '"' and not wide and not emoji:
            if mark[-1] in ".…" or not nxt.isalpha() or in_address(m.end()):
                continue
        if mark[-1] in ".…" and len(mark.strip(".…")) == 0 and (len(mark) > 1 or mark == "…"):
            kind = "two dots" if mark == ".." else "dots"
        else:
            kind = "strong" if mark[-1] in "!?؟！？⁉‼۔।" or wide else "dot"
        out.append((e, e, kind, close.strip() + ("+" if emoji else "")))
    if _SPACELESS.search(line):
        taken = {p[0] for p in out}
        out += [(m.start(), m.end(), "gap", "") for m in _GAP.finditer(line) if m.start() not in taken and m.end() not in taken]
        out.sort()
    return out


MARKS = {"strong": 3.0, "dot": 2.0, "dots": -0.3, "two dots": -2.0, "gap": 2.0}


def split_line(line: str, words: Words, rare: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """[start, end) of the sentences of a line; ``rare`` has further abbreviations."""
    places = [p for p in _ends(line) if line[p[1] :].strip(_TRIM)]
    n = len(places)
    quotes = []  # (place, opens?, character), straight quotes by turns
    turn = False
    for m in _QUOTE.finditer(line):
        ch = m[0]
        if ch == '"':
            turn = not turn
        quotes.append((m.start(), turn if ch == '"' else ch in OPEN, ch))
    toks = _tokens(line)
    begins, finishes = [t[1] for t in toks], [t[2] for t in toks]
    if not places:
        a = len(line) - len(line.lstrip(_TRIM))
        return [(a, a + len(line.strip(_TRIM)))]
    gain = []
    for e, nxt, kind, close in places:
        s = MARKS[kind]
        k = bisect_right(finishes, e) - 1
        before = toks[k][0] if k >= 0 else ""
        k = bisect_left(begins, nxt)
        after = toks[k][0] if k < len(toks) else ""
        low = before.lower()
        if kind == "gap":
            gain.append(s)
            continue
        emoji = close.endswith("+")
        if kind == "dot" and not emoji and not close and (low in words.short or low in rare or "." in before or (len(before) == 1 and before.isalpha() and not _SPACELESS.match(before))):
            s -= 5.0
            if after[:1].isdigit():
                s -= 4.0
        s += (0.5 if kind in ("strong", "dot") and not s < 0 else 1.0) * words.closes.get(low, 0.0)
        s += (1.0 if kind in ("dots", "two dots") or s < 0 or close.rstrip("+") else 0.5) * words.opens.get(after.lower(), 0.0)
        if after[:1].isupper():
            s += 2.0
        elif after[:1].islower():
            s -= 1.5 if kind in ("strong", "dot") else 3.0
        if emoji:
            s += 1.5
        rest = line[nxt:].lstrip(_TRIM)
        if close.rstrip("+") and rest[:1] == "と":
            s -= 8.0
        gain.append(s)
    starts = [0, *(p[1] for p in places)]
    ends = [*(p[0] for p in places), len(line)]
    at_words = [0, *(bisect_left(begins, b) for b in ends)]
    spans_quotes = [[q for q in quotes if a <= q[0] < b] for a, b in zip(starts, ends)]
    firsts = [line[(e := _BLANK.match(line, a).end()) : e + 1] for a in starts]
    best, back = [0.0] + [-1e18] * (n + 1), [0] * (n + 2)
    most = [0.0] * (n + 2)  # the largest of best so far
    for j in range(1, n + 2):
        free: list = []  # closing quotes that meet no open one, the first one last
        lost = 0  # other quotes without a partner
        for i in range(j - 1, -1, -1):
            k = max(1, at_words[j] - at_words[i])
            length = 0.35 * (log(k / USUAL_WORDS) ** 2)
            if k >= USUAL_WORDS and most[i] - length + (gain[j - 1] if j <= n else 0.0) + 1.0 < best[j] - 1e-9:
                break  # longer spans cost more and begin no better
            for _, opens, ch in reversed(spans_quotes[i]):
                if not opens:
                    free.append(ch)
                    continue
                while free:
                    c = free.pop()
                    if c == '"' or ch == PAIRS.get(c):
                        break
                    lost += 1
                else:
                    lost += 1
            odd = lost + len(free)
            s = best[i] - 8.0 * odd - length
            if j <= n:
                s += gain[j - 1]
                close = places[j - 1][3].rstrip("+")
                if close and not odd:
                    s += 1.0 if firsts[i] and (firsts[i] in OPEN or firsts[i] == "\"") else -6.0
            if s > best[j]:
                best[j], back[j] = s, i
        most[j] = max(most[j - 1], best[j])
    out, j = [], n + 1
    while j > 0:
        i = back[j]
        a, b = starts[i], ends[j - 1]
        a += len(line[a:b]) - len(line[a:b].lstrip(_TRIM))
        b = a + len(line[a:b].rstrip(_TRIM))
        out.append((a, b))
        j = i
    return out[::-1]


def sentences_of(text: str | None, words: Words, rare: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """[start, end) of the sentences of a text; pieces without a letter or digit are none."""
    out = []
    for m in _LINE.finditer(text or ""):
        for a, b in split_line(m[0], words, rare):
            if any(c.isalnum() for c in m[0][a:b]):
                out.append((m.start() + a, m.start() + b))
    return out


def _enough(totals: dict[str, int]):
    return reduce(or_, ((F.col("role") == r) & (F.col("n") >= n * KEPT_SHARE) for r, n in totals.items()))


def kept_counts(counts: DataFrame, totals: dict[str, int]) -> dict[tuple[str, str], int]:
    """{(role, word): n} in all roles of the words that have their share of any role."""
    if not totals:
        return {}
    return {(r.role, r.word): r.n for r in counts.join(counts.filter(_enough(totals)).select("word").distinct(), "word", "left_semi").select("role", "word", "n").collect()}


def rare_abbreviations(counts: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(word) of the abbreviations among the words that have their share of no role."""
    rare = counts.filter(F.length("word") <= ABBREVIATION)
    if totals:
        rare = rare.join(counts.filter(_enough(totals)).select("word").distinct(), "word", "left_anti")
    n = {r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(r) for r in ("dot", "inside", "plain", "close")}
    return rare.groupBy("word").agg(*n.values()).filter("dot >= 3 AND 2 * inside >= dot AND dot >= 0.8 * (dot + plain + close)").select("word")


def split(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, sent_no, sent_start, sent_end, sentence), a row for each sentence; places count code points.

    Null, empty and wordless texts have none; repeated rows have theirs each; whole documents are split, however long.
    """
    rows = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")

    def count(batches):
        for b in batches:
            c: Counter = Counter()
            for t in b["text"]:
                c.update(tally_of(t))
            yield pd.DataFrame([(r, w, n) for (r, w), n in c.items()], columns=["role", "word", "n"])

    counts = durable(rows.mapInPandas(count, "role string, word string, n long").groupBy("role", "word").agg(F.sum("n").alias("n")))
    totals = {r.role: r.n for r in counts.groupBy("role").agg(F.sum("n").alias("n")).collect()}  # a row for each role
    words = df.sparkSession.sparkContext.broadcast((kept_counts(counts, totals), totals))

    rare = durable(rare_abbreviations(counts, totals))
    if not rare.isEmpty():
        dotted = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}_'’])([\p{{L}}\p{{N}}][^\s.]{{0,{ABBREVIATION - 1}}})\.(?=[ -])"), F.lit(1)))
        held = rows.select(F.md5("text").alias("t"), F.explode(dotted).alias("word")).join(rare, "word").groupBy("t").agg(F.collect_set("word").alias("rare"))
        rows = rows.withColumn("t", F.md5("text")).join(held, "t", "left").select("doc_id", "text", "rare")
    else:
        rows = rows.withColumn("rare", F.lit(None).cast("array<string>"))

    def cut(batches):
        known = Words(*words.value)
        for b in batches:
            found = [(d, n, s, e, t[s:e]) for d, t, r in zip(b["doc_id"], b["text"], b["rare"]) for n, (s, e) in enumerate(sentences_of(t, known, frozenset() if r is None else frozenset(r)), 1)]
            yield pd.DataFrame(found, columns=["doc_id", "sent_no", "sent_start", "sent_end", "sentence"])

    return rows.mapInPandas(cut, "doc_id long, sent_no int, sent_start int, sent_end int, sentence string")

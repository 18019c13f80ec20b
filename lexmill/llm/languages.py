"""Problem 2: a language with a confidence for each document and each of its segments.

A multinomial naive Bayes model over hashed character n-grams of words is fitted to a bounded sample of the rows whose language is
stated, and fitted again after each word got the language of its surroundings, so that wrong labels and mixed texts lose their say.
The log-probability matrix is broadcast; words are scored in sparse batches, and a switching penalty along each text turns word
scores into segments. Handles, links, hashtags, emoji and numbers belong to no language.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.pii import _AT_WORD, EMAIL

BUCKETS = 1 << 16
LONGEST = 4  # characters of an n-gram
ROWS_A_LANGUAGE = 1500  # expected size of the sample of labelled rows, for each language
ROUNDS = 2  # of fitting again
SWITCH = 7.0  # log-odds that a change of language costs
WEIGHT = 0.5  # n-grams of a word overlap: their joint evidence counts as this share of their sum
LEAST_WORDS = 4  # of a segment
MARGIN = 1.0  # log-odds over the next language from which a word counts for its own; invented names and the like are as likely in several
CELLS = 100_000  # words of a batch of texts padded to one length

_GONE = regex.compile(r"[[\p{Cf}͏︀-️ـ]--[‌]]", regex.V1)
_NOISE = regex.compile(r"(?:https?://|www\.)\S+|\S+@\S+|(?<![\w.])@\w+:?|#\S+|(?<!\w)RT(?=\s*@)|(?<!\w)(?:USER|URL|EMOJI|NUM)(?!\w)")
_WORD = regex.compile(r"[฀-๿]\p{M}*|[぀-ヿ㐀-鿿豈-﫿]|[[\p{L}\p{M}\p{N}'’‌]--[฀-๿぀-ヿ㐀-鿿豈-﫿]]+", regex.V1)
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x622: 0x627}
_LETTER = regex.compile(r"\p{L}")


def words_with_places(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words that can have a language; places count code points of ``text``."""
    if not text:
        return []
    blank = lambda m: " " * (m.end() - m.start())
    plain = text.translate(_WIDE)
    if "@" in plain or _AT_WORD.search(plain):
        plain = EMAIL.sub(blank, plain)
    plain = _NOISE.sub(blank, plain)
    out = []
    for m in _WORD.finditer(plain):
        w = unicodedata.normalize("NFKC", _GONE.sub("", m[0])).lower().strip("'’‌")
        if _LETTER.search(w):
            out.append((w, m.start(), m.end()))
    return out


def ngrams(word: str) -> list[int]:
    """The hashed n-grams of a word with its borders."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) & (BUCKETS - 1) for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


def fit_counts(words: list[str], langs: list[int], n_langs: int) -> np.ndarray:
    """The log-probability matrix [BUCKETS, languages], with one part in 20 of a language's own average as smoothing."""
    counts = np.zeros((BUCKETS, n_langs))
    tally: dict[tuple[str, int], int] = {}
    for k in zip(words, langs):
        tally[k] = tally.get(k, 0) + 1
    for (w, lang), n in tally.items():
        np.add.at(counts[:, lang], ngrams(w), n)
    total = counts.sum(0, keepdims=True)
    return np.log((counts + 0.05) / (total + 0.05 * BUCKETS)).astype(np.float32)


def score_words(words: list[str], matrix: np.ndarray) -> np.ndarray:
    """[words, languages]: weighted log-likelihoods, one sparse batch."""
    if not words:
        return np.zeros((0, matrix.shape[1]), dtype=np.float32)
    unique, back = np.unique(np.array(words, dtype=object), return_inverse=True)
    ids = [ngrams(w) for w in unique]
    starts = np.cumsum([0] + [len(i) for i in ids[:-1]])
    flat = np.fromiter((x for i in ids for x in i), dtype=np.int64)
    scores = np.add.reduceat(matrix[flat], starts, axis=0) * WEIGHT
    return (scores - scores.max(1, keepdims=True))[back]


def _padded(lengths: list[int], order: np.ndarray) -> Iterator[list[int]]:
    """Texts of some words, shortest first, as many at a time as CELLS words hold when padded."""
    part: list[int] = []
    for i in order:
        if part and lengths[i] * (len(part) + 1) > CELLS:
            yield part
            part = []
        if lengths[i]:
            part.append(i)
    if part:
        yield part


def decode(lengths: list[int], scores: np.ndarray, prior: np.ndarray | float = 0.0) -> np.ndarray:
    """The language index of each word, texts of ``lengths`` words in a row, by the best path with switching penalty; ``prior`` is of a text's first language."""
    out, order = np.zeros(len(scores), dtype=np.int16), np.argsort(lengths)
    ends = np.cumsum(lengths)
    for part in _padded(lengths, order):
        long, k = max(lengths[i] for i in part), scores.shape[1]
        grid = np.zeros((long, len(part), k), dtype=np.float32)  # words beyond a text's end are neutral
        for r, i in enumerate(part):
            grid[: lengths[i], r] = scores[ends[i] - lengths[i] : ends[i]]
        best, from_ = grid[0] + prior, np.zeros((long, len(part), k), dtype=np.int16)
        for t in range(1, long):
            top = best.argmax(1)
            jump = best[np.arange(len(part)), top] - SWITCH
            stay = best >= jump[:, None]
            from_[t] = np.where(stay, np.arange(k), top[:, None])
            best = np.where(stay, best, jump[:, None]) + grid[t]
        state = best.argmax(1)
        path = np.zeros((long, len(part)), dtype=np.int16)
        for t in range(long - 1, -1, -1):
            path[t] = state
            state = from_[t][np.arange(len(part)), state]
        for r, i in enumerate(part):
            out[ends[i] - lengths[i] : ends[i]] = path[: lengths[i], r]
    return out


def margins(scores: np.ndarray, path: np.ndarray) -> np.ndarray:
    """How much more likely each word is in the language given than in the next one."""
    if not len(path) or scores.shape[1] < 2:
        return np.full(len(path), np.inf)
    at, rest = np.arange(len(path)), scores.copy()
    rest[at, path] = -np.inf
    return scores[at, path] - rest.max(1)


def fit(labelled: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The log-probability matrix and the log-probabilities of languages from (text, lang): a hash sample of about ROWS_A_LANGUAGE rows of each language is fitted on the driver, languages are counted over all rows."""
    rows = labelled.filter(F.col("lang").isin(langs) & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    picks = [(F.col("lang") == lang) & (F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(min(1.0, ROWS_A_LANGUAGE / n) * 1_000_000)) for lang, n in counts.items()]
    sample = rows.filter(reduce(lambda a, b: a | b, picks)).select("text", "lang").distinct().collect() if picks else []
    texts = [[w for w, _, _ in words_with_places(r.text)] for r in sorted(sample)]
    words, lengths = [w for t in texts for w in t], [len(t) for t in texts]
    of = [langs.index(r.lang) for r, t in zip(sorted(sample), texts) for _ in t]
    matrix = fit_counts(words, of, len(langs))
    for _ in range(ROUNDS if words else 0):
        path = decode(lengths, score_words(words, matrix))
        matrix = fit_counts(words, list(path), len(langs))
    share = np.array([counts.get(lang, 0) + 1.0 for lang in langs])
    return matrix, np.log(share / share.sum()).astype(np.float32) if len(langs) else np.zeros(0, dtype=np.float32)


def runs_of(path: np.ndarray, counts: list[bool] | None = None) -> list[tuple[int, int, int]]:
    """(language, first word, last word) of the runs of at least LEAST_WORDS words that count; what shorter runs part is one run."""
    runs: list[list[int]] = []
    for i, lang in enumerate(path):
        n = 1 if counts is None else int(counts[i])
        if runs and runs[-1][0] == lang and runs[-1][2] == i - 1:
            runs[-1][2], runs[-1][3] = i, runs[-1][3] + n
        else:
            runs.append([int(lang), i, i, n])
    long: list[list[int]] = []
    for r in runs:  # a language goes on after a short run of another
        if r[3] >= LEAST_WORDS or (long and long[-1][0] == r[0]):
            if long and long[-1][0] == r[0]:
                long[-1][2], long[-1][3] = r[2], long[-1][3] + r[3]
            else:
                long.append(r)
    return [(r[0], r[1], r[2]) for r in long]


def identify(df: DataFrame, labelled: DataFrame, langs: list[str]) -> DataFrame:
    """(tbl, ord, seg_no, lang, stated, confidence, n_words, seg_start, seg_end) of (tbl, ord, text, lang).

    ``seg_no`` 0 is the whole record with the language of most of its words (ties: the earlier code; words as likely in another language,
    such as invented names, count only where there are no others); a record with segments of
    several languages has them as 1, 2, ... in text order. Null texts and texts without a word of any language have no row;
    repeated rows have theirs each; whole texts are scored, however long.
    """
    langs = sorted(langs)
    model = df.sparkSession.sparkContext.broadcast(fit(labelled, langs))

    def tagged(batches):
        for b in batches:
            found = [words_with_places(t) for t in b["text"]]
            words, lengths = [w for f in found for w, _, _ in f], [len(f) for f in found]
            matrix, prior = model.value
            scores = score_words(words, matrix)
            path = decode(lengths, scores, prior)
            certain = margins(scores, path) > MARGIN
            odds = np.exp(scores + prior)
            odds /= odds.sum(1, keepdims=True) if len(odds) else 1
            rows, at = [], 0
            for i, f in enumerate(found):
                if not f:
                    continue
                own, p, counts = path[at : at + len(f)], odds[at : at + len(f)], certain[at : at + len(f)]
                at += len(f)
                votes = np.bincount(own, weights=counts, minlength=len(langs))
                top = int((votes if votes.any() else np.bincount(own, minlength=len(langs))).argmax())
                rows.append((i, 0, langs[top], float(p[own == top, top].sum() / len(f)), len(f), f[0][1], f[-1][2]))
                runs = runs_of(own, counts)
                if len({r[0] for r in runs}) > 1:
                    for n, (lang, first, last) in enumerate(runs, 1):
                        rows.append((i, n, langs[lang], float(p[first : last + 1, lang].mean()), last - first + 1, f[first][1], f[last][2]))
            out = pd.DataFrame(rows, columns=["i", "seg_no", "lang", "confidence", "n_words", "seg_start", "seg_end"])
            whole = b.iloc[out["i"].to_numpy(dtype=int)].reset_index(drop=True)
            yield pd.concat([whole[["tbl", "ord"]], whole["lang"].rename("stated"), out.drop(columns="i")], axis=1)

    source = df.select("tbl", "ord", "text", "lang").filter("text is not null")
    schema = "tbl string, ord long, stated string, seg_no int, lang string, confidence double, n_words int, seg_start int, seg_end int"
    return source.mapInPandas(tagged, schema)

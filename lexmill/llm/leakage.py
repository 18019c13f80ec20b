"""Problem 4: evaluation texts leaking into training text, by rare n-gram seeds and Smith-Waterman alignment.

Of each stretch of RUN words of an item the SEED-gram that is rarest in the corpus is a seed, and those nearly as rare, so that
whatever holds the stretch holds a seed. For edited copies every SEED-gram of an item is a seed, however frequent. Seeds bring items
and passages together; each candidate pair is aligned word by word, many pairs at a time, in windows of the passage around the
grams that both hold: as a match is worth two and what is skipped costs one each, no alignment of an item of n words reaches further
than 3 n words from a gram in it. Passages of one text are aligned once, whatever number of records hold them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm import wording
from lexmill.session import durable

SEED = 4
RUN = 8
NEARLY = 10  # a gram this many times as frequent as the rarest of its stretch is a seed too
EDITED = 0.7  # of an item's words at least stand in an edited copy
MATCH, OTHER, GAP = 2, -1, -1
BROADCAST_GRAMS = 200_000  # rows of 12 bytes and a little more: some MB; with more grams the same joins shuffle
SALTS = 16  # parts of a gram's list where joins shuffle
CELLS = 1 << 20  # of the table of several alignments
_ONE = 1 << 20  # a point of score, beside which matched words are counted


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, matched, run) of pairs of word numbers, [pairs, words] each, filled up with different negative numbers."""
    score = np.zeros((len(a), b.shape[1] + 1), dtype=np.int64)
    run = np.zeros((len(a), b.shape[1] + 1), dtype=np.int32)
    best, longest = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int32)
    along = np.arange(1, b.shape[1] + 1, dtype=np.int64) * (-GAP * _ONE)
    for i in range(a.shape[1]):
        same = a[:, i : i + 1] == b
        s = np.maximum(score[:, :-1] + np.where(same, MATCH * _ONE + 1, OTHER * _ONE), score[:, 1:] + GAP * _ONE)
        s = np.maximum.accumulate(np.maximum(s, 0) + along, axis=1) - along  # words of the passage skipped
        s[s < _ONE] = 0
        score[:, 1:] = s
        run[:, 1:] = (run[:, :-1] + 1) * same
        best, longest = np.maximum(best, s.max(axis=1)), np.maximum(longest, run.max(axis=1))
    return best >> 20, best & (_ONE - 1), longest


def _windows(item: list[str], passage: list[str]) -> list[list[str]]:
    """The parts of a passage that an alignment around a common SEED-gram can reach."""
    n = len(item)
    if len(passage) <= 8 * n:
        return [passage]
    grams = {tuple(item[i : i + SEED]) for i in range(n - SEED + 1)}
    parts: list[list[int]] = []
    for at in (i for i in range(len(passage) - SEED + 1) if tuple(passage[i : i + SEED]) in grams):
        lo, hi = max(0, at - 3 * n), at + SEED + 3 * n
        if parts and lo <= parts[-1][1]:
            parts[-1][1] = hi
        else:
            parts.append([lo, hi])
    return [passage[lo:hi] for lo, hi in parts]


def align_pairs(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """[pairs, 3]: best local alignment score, words matched in it (the most, where several score alike), longest run of equal words in a row."""
    number: dict[str, int] = {}
    of = lambda words: np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    jobs = [(k, of(item), of(part)) for k, (item, passage) in enumerate(pairs) if item for part in _windows(item, passage) if part]
    jobs.sort(key=lambda j: (len(j[2]), len(j[1])))
    out = np.zeros((len(pairs), 3), dtype=np.int64)
    packed = np.zeros(len(pairs), dtype=np.int64)
    while jobs:
        n = 1
        while n < len(jobs) and (n + 1) * len(jobs[n][2]) <= CELLS:
            n += 1
        some, jobs = jobs[:n], jobs[n:]
        a, b = np.full((n, max(len(j[1]) for j in some)), -1, dtype=np.int64), np.full((n, max(len(j[2]) for j in some)), -2, dtype=np.int64)
        for r, (_, x, y) in enumerate(some):
            a[r, : len(x)], b[r, : len(y)] = x, y
        score, matched, run = _aligned(a, b)
        which = np.array([j[0] for j in some])
        np.maximum.at(packed, which, score * _ONE + matched)
        np.maximum.at(out[:, 2], which, run)
    out[:, 0], out[:, 1] = packed >> 20, packed & (_ONE - 1)
    return out


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(best local alignment score, words matched in it, longest run of equal words in a row) of two word lists."""
    return tuple(align_pairs([(a, b)])[0].tolist())


def _grams(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, gram) of every run of SEED words."""
    starts = F.when(F.size("words") >= SEED, F.sequence(F.lit(1), F.size("words") - SEED + 1))
    return df.select(*keys, "words", F.explode(starts).alias("at")).select(*keys, "at", F.xxhash64(F.slice("words", F.col("at"), F.lit(SEED))).alias("gram"))


def leaks(passages: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", edited: bool = True) -> DataFrame:
    """(tbl, ord, item_id, score, matched, run, n_item) of records whose passage shares a seed with an item, the best passage each.

    ``passages`` has (tbl, ord, text), several rows a record where it holds several texts. Null and empty texts, and items and passages
    of fewer than SEED words (RUN without ``edited``), share nothing; repeated rows and items each count; no table is limited in size,
    columns besides are not read. Pairs that share a common gram only are left out where they hold fewer than EDITED of the item's
    words, in any order, as no alignment could match enough then; without ``edited``, all pairs that share a common gram only are.
    """
    least = SEED if edited else RUN
    its = durable(items.select(F.col(item_id).alias("item_id"), wording.words(text).alias("words")).filter(F.size("words") >= least))
    item_grams = durable(_grams(its, "item_id"))
    small = item_grams.count() <= BROADCAST_GRAMS
    rows = passages.filter("text is not null").select("tbl", "ord", F.md5("text").alias("t"), "text")
    texts = rows.groupBy("t").agg(F.first("text").alias("text")).select("t", wording.words("text").alias("words")).filter(F.size("words") >= least)

    def meet(grams: DataFrame, wanted: DataFrame) -> DataFrame:
        """Their join on the gram; a gram that most texts hold is many parts of work."""
        if small:
            return grams.join(F.broadcast(wanted), "gram")
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return grams.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"]).drop("salt")

    hits = durable(meet(_grams(texts, "t").select("t", "gram"), item_grams.select("gram").distinct()).distinct())
    df = hits.groupBy("gram").agg(F.count("*").alias("df"))
    known = item_grams.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    last = F.max("at").over(Window.partitionBy("item_id"))
    stretch = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, RUN - SEED)
    around = Window.partitionBy("item_id").orderBy("at").rowsBetween(SEED - RUN, 0)
    known = known.withColumn("last", last).withColumn("rarest", F.min("df").over(stretch))
    known = known.withColumn("rarest", F.max(F.when(F.col("at") + RUN - SEED <= F.col("last"), F.col("rarest"))).over(around))
    seeds = known.filter(F.col("df") <= NEARLY * F.col("rarest") + NEARLY).select("item_id", "gram").distinct()
    pairs = meet(hits, seeds).select("t", "item_id", F.lit(True).alias("rare")).distinct()
    if edited:
        shared = meet(hits, item_grams.select("item_id", "gram").distinct()).select("t", "item_id", F.lit(False).alias("rare"))
        pairs = shared.unionByName(pairs).groupBy("t", "item_id").agg(F.max("rare").alias("rare"))
    texts_of = rows.select("t", "text").join(pairs.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    both = pairs.join(texts_of.select("t", wording.joined("text").alias("wa")), "t").join(its.select("item_id", F.array_join("words", " ").alias("wi")), "item_id")

    def aligned(batches):
        for b in batches:
            words = [(x.split(" "), y.split(" ")) for x, y in zip(b["wi"], b["wa"])]
            keep = [i for i, (rare, (x, y)) in enumerate(zip(b["rare"], words)) if rare or sum((Counter(x) & Counter(y)).values()) >= EDITED * len(x)]
            found = align_pairs([words[i] for i in keep])
            out = b[["t", "item_id"]].iloc[keep].reset_index(drop=True)
            for k, name in enumerate(("score", "matched", "run")):
                out[name] = found[:, k].astype(np.int32)
            out["n_item"] = np.array([len(words[i][0]) for i in keep], dtype=np.int32)
            yield out

    scored = durable(both.repartition("t", "item_id").mapInPandas(aligned, "t string, item_id long, score int, matched int, run int, n_item int"))
    best = F.max(F.struct("score", "run", "matched", "n_item")).alias("b")
    longest = F.max("run").alias("run")
    out = rows.select("tbl", "ord", "t").join(scored, "t").groupBy("tbl", "ord", "item_id").agg(best, longest)
    return out.select("tbl", "ord", "item_id", "b.score", "b.matched", "run", "b.n_item")


def verdicts(found: DataFrame) -> DataFrame:
    """Leaks with their kind, by the score of their alignment: ``run`` (that of RUN words at least, which stand in a row), ``edited`` (most of the item, changed); others are left out."""
    run = (F.col("score") >= MATCH * RUN) & (F.col("run") >= RUN)
    edited = (F.col("score") >= F.col("n_item")) & (F.col("matched") >= EDITED * F.col("n_item"))
    return found.withColumn("kind", F.when(run, "run").when(edited, "edited")).filter("kind is not null")

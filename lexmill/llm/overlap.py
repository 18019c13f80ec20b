"""Problem 1: same or near-same records across splits, by a weighted cosine join.

A text is a vector of terms, a term being a word and the number of its occurrence in the text, weighted by the word's inverse
document frequency. Two texts belong together if at most one word in ``ONE_IN`` of the longer is added, missing, changed or moved.
So a text of n words lacks at most n / ONE_IN of its terms in its partner, and the dot product is at least its squared norm less
its heaviest n / ONE_IN squared weights: the bound that each text sets. Inverted lists hold only the terms before the point where
the squared norm of the rest plus the largest weights of ``k - 1`` listed ones can no longer reach the bound (residual-norm and
maximum-weight pruning); they are keyed by ``k`` terms together, so that lists stay short where words are common. Nothing is lost:
in the common order of terms, heaviest first, the first ``k`` shared terms of a pair are listed for both of its texts.

Texts of one wording are one class; only classes are compared, and copies are expanded only where pairs of rows are asked for.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wording
from lexmill.session import durable

ONE_IN = 5
FREQUENT_SHARE = 1 / 20_000  # words in this share of all texts or more, a text counting as often as it has words: at most 20,000, whatever the data
KNOWN_WORDS = 500_000  # terms that a worker keeps between texts


def terms_together(length: int) -> int:
    """How many terms key an inverted list, for pairs whose longer text has ``length`` words: as many as keep the keys of a text few."""
    return 3 if length <= 40 else 2 if length <= 100 else 1


def frequent_words(classes: DataFrame) -> tuple[dict[str, float], float]:
    """The weights of the frequent words and that of all others; of proven size, as no more than 1 / FREQUENT_SHARE words can have that share each."""
    n, total = classes.agg(F.count("*"), F.sum("n_words")).first()
    least = max(2.0, (total or 0) * FREQUENT_SHARE)
    counts = classes.select(F.explode(F.array_distinct(F.split("wording", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    idf = lambda df: float(np.log1p(n / df))
    return {r.word: idf(r.n) for r in counts.filter(F.col("n") >= least).collect()}, idf(least) if n else 1.0


class Terms:
    """The terms of texts, heaviest first."""

    def __init__(self, weights: tuple[dict[str, float], float]):
        self.weights, self.rest = weights
        self.known: dict[str, tuple[float, int]] = {}

    def of(self, words: list[str]) -> list[tuple[float, int]]:
        """(-weight, hash) of each term, in the common order."""
        seen: dict[str, int] = {}
        out = []
        for w in words:
            t = self.known.get(w)
            if t is None:
                if len(self.known) > KNOWN_WORDS:
                    self.known.clear()
                t = self.known[w] = (-self.weights.get(w, self.rest), xxhash.xxh3_64_intdigest(w))
            n = seen.get(w, 0)
            seen[w] = n + 1
            out.append((t[0], (t[1] + n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) if n else t)
        out.sort()
        return out


def listed(terms: list[tuple[float, int]], k: int) -> int:
    """How many of the terms an inverted list of ``k`` terms together has to hold."""
    missing = len(terms) // ONE_IN
    rest = sum(w * w for w, _ in terms)
    need = rest - sum(w * w for w, _ in terms[:missing])
    for i, (w, _) in enumerate(terms):
        if rest < need - 1e-9 * rest:  # what is left can't reach the bound; with k - 1 listed ones besides it still could
            return min(len(terms), i + k - 1)
        rest -= w * w
    return len(terms)


@cache
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64)


def keys_of(terms: np.ndarray, k: int) -> np.ndarray:
    """[texts, choices]: a key for each choice of ``k`` of the listed terms, texts having equally many."""
    chosen = np.sort(terms, axis=1)[:, _choices(terms.shape[1], k)]
    key = np.full(chosen.shape[:2], k, dtype=np.uint64)
    for j in range(k):
        key = (key ^ chosen[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def same_wording(a: list[str], b: list[str]) -> bool:
    """Whether at most one word in ONE_IN of the longer list is added, missing, changed or moved."""
    longer = max(len(a), len(b))
    return longer > 0 and (longer - common_words(a, b)) * ONE_IN <= longer


def records(df: DataFrame, text: str = "text", split: str = "split", source: str = "source", ident: str = "ord") -> DataFrame:
    """(ord, is_train, split, source, cls_key, wording) of the rows with a wording, of the splits train, dev and test."""
    rows = df.filter(F.col(split).isin("train", "dev", "test") & F.col(text).isNotNull())
    rows = rows.select(F.col(ident).alias("ord"), (F.col(split) == "train").alias("is_train"), F.col(split).alias("split"), F.col(source).alias("source"), wording.joined(text).alias("wording"))
    return rows.filter("wording <> ''").select("ord", "is_train", "split", "source", F.md5("wording").alias("cls_key"), "wording")


def class_links(df: DataFrame, text: str = "text", split: str = "split", source: str = "source", ident: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Members (ord, is_train, split, source, cls) and links (cls_eval, cls_train, cosine, edits) between classes of equal wording.

    A class that has members in train and elsewhere links to itself. Null, empty and wordless texts and rows of no split belong to
    no class; repeated rows are members like others; columns besides those named are not read.
    """
    rows = durable(records(df, text, split, source, ident))
    members = rows.select("ord", "is_train", "split", "source", "cls_key")
    classes = durable(
        rows.groupBy("cls_key").agg(
            F.min("ord").alias("cls"), F.min("wording").alias("wording"), F.bool_or("is_train").alias("in_train"), F.bool_or(~F.col("is_train")).alias("in_eval")
        ).withColumn("n_words", F.size(F.split("wording", " ")))
    )
    weights = df.sparkSession.sparkContext.broadcast(frequent_words(classes))

    def lists(batches):
        terms = Terms(weights.value)
        for b in batches:
            by: dict[tuple[int, int], list[tuple[int, list[int]]]] = {}
            for i, text in enumerate(b["wording"]):
                own = terms.of(text.split(" "))
                n = len(own)
                if n >= ONE_IN - 1:
                    for k in {terms_together(n), terms_together(n * ONE_IN // (ONE_IN - 1))}:
                        m = listed(own, k)
                        by.setdefault((m, k), []).append((i, [t[1] for t in own[:m]]))
            for (_, k), some in by.items():
                keys = keys_of(np.array([t for _, t in some], dtype=np.uint64), k)
                at = np.repeat(np.array([i for i, _ in some], dtype=np.int64), keys.shape[1])
                yield pd.DataFrame({"key": keys.ravel(), "cls": b["cls"].to_numpy()[at], "n_words": b["n_words"].to_numpy()[at]})

    def postings(side: str, cls: str, n: str) -> DataFrame:
        return classes.filter(side).select("cls", "wording", "n_words").mapInPandas(lists, "key long, cls long, n_words int").toDF("key", cls, n)

    fits = (F.least("na", "nb") * ONE_IN >= F.greatest("na", "nb") * (ONE_IN - 1)) & (F.col("a") != F.col("b"))
    pairs = postings("in_eval", "a", "na").join(postings("in_train", "b", "nb"), "key").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    text_of = classes.select("cls", "wording")
    both = pairs.join(text_of.toDF("a", "wa"), "a").join(text_of.toDF("b", "wb"), "b")

    def exact(batches):
        terms = Terms(weights.value)
        for b in batches:
            keep, cosine, edits = [], [], []
            for i, (x, y) in enumerate(zip(b["wa"], b["wb"])):
                wa, wb = x.split(" "), y.split(" ")
                ta, tb = terms.of(wa), terms.of(wb)
                na, nb = sum(w * w for w, _ in ta), sum(w * w for w, _ in tb)
                in_b = {t for _, t in tb}
                dot = sum(w * w for w, t in ta if t in in_b)
                if dot < max(na - sum(w * w for w, _ in ta[: len(ta) // ONE_IN]), nb - sum(w * w for w, _ in tb[: len(tb) // ONE_IN])) - 1e-6:
                    continue
                longer = max(len(wa), len(wb))
                changed = longer - common_words(wa, wb)
                if changed * ONE_IN <= longer:
                    keep.append(i)
                    cosine.append(dot / (na * nb) ** 0.5)
                    edits.append(changed)
            out = b[["a", "b"]].iloc[keep].reset_index(drop=True)
            out["cosine"], out["edits"] = np.array(cosine, dtype=float), np.array(edits, dtype=np.int32)
            yield out

    linked = durable(both.mapInPandas(exact, "a long, b long, cosine double, edits int"))
    side = classes.select("cls", "in_train", "in_eval")
    linked = linked.join(side.toDF("a", "a_train", "a_eval"), "a").join(side.toDF("b", "b_train", "b_eval"), "b")
    links = (
        linked.filter("a_eval and b_train").select(F.col("a").alias("cls_eval"), F.col("b").alias("cls_train"), "cosine", "edits")
        .unionByName(linked.filter("b_eval and a_train").select(F.col("b").alias("cls_eval"), F.col("a").alias("cls_train"), "cosine", "edits"))
        .unionByName(side.filter("in_train and in_eval").select(F.col("cls").alias("cls_eval"), F.col("cls").alias("cls_train"), F.lit(1.0).alias("cosine"), F.lit(0).alias("edits")))
    )
    members = members.join(classes.select("cls_key", "cls"), "cls_key").drop("cls_key")
    return members, links


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of rows behind the links: (ord_a, ord_b), ord_a < ord_b, each pair once."""
    ev = members.filter(~F.col("is_train")).select(F.col("cls").alias("cls_eval"), F.col("ord").alias("oe"))
    tr = members.filter("is_train").select(F.col("cls").alias("cls_train"), F.col("ord").alias("ot"))
    out = links.join(ev, "cls_eval").join(tr, "cls_train")
    return out.select(F.least("oe", "ot").alias("ord_a"), F.greatest("oe", "ot").alias("ord_b"))


def report(members: DataFrame, links: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, those with the same or nearly the same record in train, and links to train classes."""
    per = links.groupBy(F.col("cls_eval").alias("cls")).agg(F.bool_or(F.col("cls_eval") == F.col("cls_train")).alias("same"), F.count("*").alias("n_links"))
    ev = members.filter(~F.col("is_train")).join(per, "cls", "left")
    return ev.groupBy("split", "source").agg(
        F.count("*").alias("n_records"), F.count("n_links").alias("n_overlapping"), F.count_if(F.coalesce("same", F.lit(False))).alias("n_same_wording"),
        F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_class_links"),
    )

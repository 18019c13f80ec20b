"""Exact and near duplicates.

Near duplicates compare sets of character n-grams. Texts of one key are one class; only classes are compared, through equal parts of
their sets (exact mode; inverted lists of the rarest shingles at low thresholds and against references) or MinHash bands (LSH mode),
and every candidate is verified exactly. A record's match is the most similar earlier record, the earliest on ties; matches aren't
transitive and make no clusters. Texts aren't shuffled: records travel as digests, and only the texts of candidates are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from lexmill.functions import text as X
from lexmill.session import durable


FREQUENT_SHARE = 1 / 1_000_000  # of all shingles, from which one is put behind the others: at most a million, of 16 bytes, are
TOGETHER = 6  # shingles that the first ones of two similar sets share, where the sets are large enough
LEAST_BY_PARTS = 0.7  # threshold under which sets differ in so many parts that empty ones would have to be compared
PARTS = 16  # parts of a set that make a group; a group has a row of 64 parities besides
ROWS_TOGETHER = 2_000_000  # records from which the signatures of a group of parts are split by their value; a split names its records again
ENTRIES_AT_ONCE = 4_000_000  # signatures that a task sorts at once
PAIRS_AT_ONCE = 2_000_000  # pairs that a task holds at once
KNOWN = 1_000_000  # records that a task remembers, to leave out their copies
FEW = 500_000  # records whose numbers are sent to every executor to fetch their texts; more are joined by shuffle


def exact_duplicates(df: DataFrame, key: Column, ident: str) -> DataFrame:
    """``df`` with ``duplicate_of``: the first record with the same key, or null for that record itself and for null keys."""
    long = isinstance(df.select(key.alias("_key")).schema["_key"].dataType, StringType)
    key = F.unhex(F.sha2(key, 256)) if long else key  # texts needn't move to be compared
    first = df.groupBy(key.alias("_key")).agg(F.min(ident).alias("_first"), F.count("*").alias("_n")).filter("_key is not null and _n > 1").drop("_n")
    rows = df.withColumn("_key", key)  # rows without a key meet nothing and don't all go to one task
    out = rows.filter("_key is not null").join(first, "_key", "left").unionByName(rows.filter("_key is null").withColumn("_first", F.lit(None).cast(df.schema[ident].dataType)))
    return out.withColumn("duplicate_of", F.when(F.col("_first") < F.col(ident), F.col("_first"))).drop("_key", "_first")


def _classes(df: DataFrame, text: str, ident: str, group: str | None) -> DataFrame:
    """(cls, key, grp, ords): one row a key and group; cls is its first record."""
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = df.select(F.col(ident).alias("ord"), X.dedup_key(text).alias("key"), g.alias("grp")).filter("key <> ''")
    return rows.groupBy("key", "grp").agg(F.min("ord").alias("cls"))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(key: str, n: int) -> np.ndarray:
    """The distinct 64-bit hashes of the character n-grams of a key, or of the whole key where it isn't longer than ``n``."""
    cps = np.frombuffer(key.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    m = min(n, len(cps))
    h = np.full(len(cps) - m + 1, m, dtype=np.uint64)
    for i in range(m):
        h = (h ^ cps[i : len(cps) - m + 1 + i]) * _STEP
        h ^= h >> np.uint64(29)
    return _distinct(h.view(np.int64))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; ``x`` itself is sorted."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _shingled(classes: DataFrame, n: int) -> DataFrame:
    """(cls, grp, sh, n): the hashes of each class, in numpy batches."""

    @F.pandas_udf("array<long>")
    def hashes(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: shingle_hashes(k, n))

    return classes.select("cls", "grp", hashes("key").alias("sh")).withColumn("n", F.size("sh"))


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the shingles with FREQUENT_SHARE of all or more; of proven size, as no more than 1 / FREQUENT_SHARE can have that share each."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    rows = sets.select(F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("df")).filter(F.col("df") >= max(2.0, total * FREQUENT_SHARE)).toPandas().sort_values("s")
    return rows["s"].to_numpy(np.int64), rows["df"].to_numpy(np.int64)


def _prefixes(sets: DataFrame, threshold: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cls, n, s): the first shingles of each set, rare ones before frequent ones: two sets of Jaccard ``threshold`` share TOGETHER of them, or all their common ones."""
    known = sets.sparkSession.sparkContext.broadcast(frequent)

    def first(batches):
        hashes, counts = known.value
        for b in batches:
            cls, n, keys = [], [], []
            for c, sh in zip(b["cls"], b["sh"]):
                sh = np.asarray(sh, dtype=np.int64)
                at = np.minimum(np.searchsorted(hashes, sh), max(len(hashes) - 1, 0))
                df = np.where(hashes[at] == sh, counts[at], 0) if len(hashes) else np.zeros(len(sh), dtype=np.int64)
                some = sh[np.lexsort((sh, df))[: len(sh) - int(np.ceil(threshold * len(sh) - 1e-9)) + TOGETHER]]
                cls.append(np.full(len(some), c, dtype=np.int64))
                n.append(np.full(len(some), len(sh), dtype=np.int32))
                keys.append(some)
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
            yield pd.DataFrame({"cls": join(cls, np.int64), "n": join(n, np.int32), "s": join(keys, np.int64)})

    return sets.select("cls", "sh").mapInPandas(first, "cls long, n int, s long")


def minhash_bands(sets: DataFrame, bands: int = 16, rows: int = 8, seed: int = 1) -> DataFrame:
    """(cls, n, s): a key for each band of a MinHash signature, computed in numpy batches."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64)

    def sign(batches):
        for x in batches:
            cls, n, keys = [], [], []
            for c, sh in zip(x["cls"], x["sh"]):
                h = np.asarray(sh, dtype=np.int64).view(np.uint64)
                sig = ((h[:, None] * a[None, :] + b[None, :]) >> np.uint64(20)).min(0).reshape(bands, rows)
                key = (sig * (np.arange(rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))).sum(1, dtype=np.uint64) ^ (np.arange(bands, dtype=np.uint64) << np.uint64(56))
                cls += [c] * bands
                n += [len(h)] * bands
                keys.append(key.view(np.int64))
            yield pd.DataFrame({"cls": np.array(cls, dtype=np.int64), "n": np.array(n, dtype=np.int32), "s": np.concatenate(keys) if keys else np.array([], dtype=np.int64)})

    return sets.select("cls", "sh").mapInPandas(sign, "cls long, n int, s long")


def set_windows(n: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(window, groups, kept) of a set of ``n`` for each window of sizes in which it may meet a similar one.

    Window i is for pairs whose larger set has 2**i to 2**(i+1) - 1 shingles. Two sets of Jaccard ``threshold`` differ in at most
    (1 - threshold) / (1 + threshold) of their summed sizes, so in at most that by ``groups`` in some group of PARTS parts. Of the
    ``kept`` first parts of either set in that group, in an order that hangs on the parts alone, one at least is equal in both.
    """
    i = n.bit_length() - 1
    while threshold * 2**i <= n + 1e-9:
        top = 2 ** (i + 1) - 1
        groups = _groups(i, threshold)
        yield i, groups, _apart(n + min(int(n / threshold + 1e-9), top), threshold) // groups + 1
        i += 1


def _apart(both: int, threshold: float) -> int:
    return int((1 - threshold) / (1 + threshold) * both + 1e-9)


def _groups(window: int, threshold: float) -> int:
    """Groups of parts of the sets of a window: fewer than PARTS parts of one may differ between two similar sets."""
    return _apart(2 * (2 ** (window + 1) - 1), threshold) // (PARTS - 1) + 1


@lru_cache(maxsize=64)
def _edges(parts: int) -> np.ndarray:
    return (np.arange(1, parts) / parts * 2.0**64 - 2.0**63).astype(np.int64)


def set_signatures(sh: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, part, signature, parities) of the kept parts of a sorted set, the largest ones of each group; parts are ranges of the hashes.

    The parities of a group are those of the counts of its shingles in 64 classes: two sets have no more different ones than shingles.
    """
    x = sh.view(np.uint64)
    none = np.zeros(1, dtype=np.uint64)
    sums = np.concatenate([none, np.cumsum((x ^ (x >> np.uint64(31))) * _STEP, dtype=np.uint64)])
    odd = np.concatenate([none, np.bitwise_xor.accumulate(np.uint64(1) << (x & np.uint64(63)))])
    for window, groups, kept in set_windows(len(sh), threshold):
        ends = np.concatenate([[0], np.searchsorted(sh, _edges(groups * PARTS)), [len(sh)]])
        first = np.argsort((ends[:-1] - ends[1:]).reshape(groups, PARTS), axis=1, kind="stable")[:, :kept]
        part = (np.sort(first, axis=1) + np.arange(0, groups * PARTS, PARTS)[:, None]).ravel()
        sign = sums[ends[part + 1]] - sums[ends[part]] + part.astype(np.uint64)
        sign = (sign ^ (sign >> np.uint64(29))) * _STEP
        yield window, part, (sign >> np.uint64(32)).astype(np.uint32), odd[ends[PARTS::PARTS]] ^ odd[ends[:-1:PARTS]]


def _signatures(rows: DataFrame, n: int, threshold: float, splits: int) -> DataFrame:
    """(win, grp, ids, sizes, odd, counts, signs): the signatures of a batch of records (id, key) for one group of parts, packed.

    ``sizes`` are the first 8 bits of each size, ``counts`` a bit for each part of the group that has a signature. A signature has 16 bits, 24
    where they are split by their value: others that meet by chance differ in their parities. Copies in one task are left out, where it remembers them.
    """
    kind, width = _kind(rows), 2 if splits == 1 else 3

    def packed(batches):
        known: set[int] = set()
        for batch in batches:
            batch = batch[batch["key"].fillna("") != ""].drop_duplicates(["id", "key"])
            marks = [i << 64 | hash(key) & (1 << 64) - 1 for i, key in zip(batch["id"].tolist(), batch["key"])]
            batch = batch[np.array([m not in known for m in marks], dtype=bool)]
            if len(known) > KNOWN:
                known.clear()
            known.update(marks)
            ids, sizes = batch["id"].to_numpy(kind), np.zeros(len(batch), dtype=np.int64)
            rec, at, bits, signs, odd = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.uint64)]
            for r, key in enumerate(batch["key"]):
                sh = shingle_hashes(key, n)
                sizes[r] = len(sh)
                for window, part, sign, parities in set_signatures(sh, threshold):
                    rec.append(np.full(len(part), r, dtype=np.int32))
                    at.append((window << 48) + part // PARTS * splits + (sign.astype(np.int64) * splits >> 32))
                    bits.append((1 << part % PARTS).astype(np.uint16))
                    signs.append(sign)
                    odd.append(parities[part // PARTS])
            rec, at, bits, signs, odd = map(np.concatenate, (rec, at, bits, signs, odd))
            order = np.argsort(at, kind="stable")
            rec, at, bits, signs, odd = rec[order], at[order], bits[order], signs[order], odd[order]
            cut = np.flatnonzero(np.diff(at)) + 1
            out = []
            for lo, hi in zip([0, *cut], [*cut, len(at)]):
                if lo < hi:
                    first = np.concatenate([[0], np.flatnonzero(np.diff(rec[lo:hi])) + 1])
                    of, window = rec[lo:hi][first], int(at[lo] >> 48)
                    size = (sizes[of] >> _unkept(window)).astype(np.uint8)
                    own = np.bitwise_or.reduceat(bits[lo:hi], first).astype("<u2")
                    out.append((window, int(at[lo] & ((1 << 48) - 1)), ids[of].tobytes(), size.tobytes(), odd[lo:hi][first].tobytes(), own.tobytes(), signs[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()))
            yield pd.DataFrame(out, columns=["win", "grp", "ids", "sizes", "odd", "counts", "signs"])

    return rows.select("id", "key").mapInPandas(packed, "win int, grp long, ids binary, sizes binary, odd binary, counts binary, signs binary")


def _kind(rows: DataFrame) -> type:
    return np.int32 if isinstance(rows.schema["id"].dataType, IntegerType) else np.int64


def _unkept(window: int) -> int:
    """Bits of the sizes in a window besides the first 8."""
    return max(0, window - 7)


def _equal_parts(rows: DataFrame, n: int, threshold: float, total: int) -> DataFrame:
    """(a, b) of the ids of records (id, key) with an equal part in a group that isn't too different by its parities, whose sizes allow the threshold.

    Records of one id are told apart where they differ in the parities of a group, but aren't paired with each other for sure.
    """
    rate, kind, splits = (1 - threshold) / (1 + threshold), _kind(rows), 1 + total // ROWS_TOGETHER
    width = 2 if splits == 1 else 3

    def together(sign: np.ndarray, rec: np.ndarray, least: np.ndarray, most: np.ndarray, odd: np.ndarray, groups: int) -> list[np.ndarray]:
        entry = _distinct(sign.astype(np.uint64) << np.uint64(32) | rec.astype(np.uint64))
        sign, rec = entry >> np.uint64(32), (entry & np.uint64(0xFFFFFFFF)).astype(np.int32)
        place = np.arange(len(entry))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], sign[1:] != sign[:-1]])[: len(entry)], place, 0))
        later = np.flatnonzero(place > start)
        before = (place - start)[later]
        sums, lo, out = np.cumsum(before), 0, []
        apart = (2 * rate * most.max(initial=0) + 1e-9) / groups
        while lo < len(later):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + PAIRS_AT_ONCE)))
            many = before[lo:hi]
            left = rec[np.repeat(start[later[lo:hi]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            right = np.repeat(rec[later[lo:hi]], many)
            differ = np.bitwise_count(odd[left] ^ odd[right])
            some = np.flatnonzero(differ <= apart)
            left, right = left[some].astype(np.int64), right[some].astype(np.int64)
            near = (most[left] >= threshold * least[right] - 1e-9) & (most[right] >= threshold * least[left] - 1e-9) & (differ[some] <= (rate * (most[left] + most[right]) + 1e-9) / groups)
            out.append(_distinct(right[near] << 32 | left[near]))
            lo = hi
        return out

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = lambda c, kind: np.frombuffer(b"".join(pdf[c]), dtype=kind)
        window = int(pdf["win"].iat[0])
        names, size, odd = whole("ids", kind), whole("sizes", np.uint8), whole("odd", np.uint64)
        order = np.lexsort((size, odd, names))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (names, odd, size)])
        rec = np.zeros(len(order), dtype=np.uint32)
        rec[order] = np.cumsum(new) - 1
        names, size, odd = names[order[new]], size[order[new]].astype(np.int64), odd[order[new]]
        least, most = (size << _unkept(window)).astype(float), ((size + 1 << _unkept(window)) - 1).astype(float)
        part = np.flatnonzero(np.unpackbits(whole("counts", np.uint8), bitorder="little"))
        rec = rec[part // PARTS]
        sign = np.zeros((len(rec), 4), dtype=np.uint8)
        sign[:, :width] = whole("signs", np.uint8).reshape(-1, width)
        sign[:, width] = part % PARTS
        sign, bits = sign.view("<u4").ravel(), 8 * width + (PARTS - 1).bit_length()
        slices = 1 + len(sign) // ENTRIES_AT_ONCE
        out = [np.zeros(0, dtype=np.int64)]
        for k in range(slices):
            own = (sign >= (k << bits) // slices) & (sign < (k + 1 << bits) // slices)
            out += together(sign[own], rec[own], least, most, odd, _groups(window, threshold))
        pair = _distinct(np.concatenate(out))
        return pd.DataFrame({"a": names[pair >> 32], "b": names[pair & 0xFFFFFFFF]})

    met = _signatures(rows, n, threshold, splits).groupBy("win", "grp").applyInPandas(meet, "a {0}, b {0}".format("int" if kind is np.int32 else "long"))
    return met.distinct()


def _light(df: DataFrame) -> DataFrame:
    """``df`` for a join, sent to every executor where it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _similar(pairs: DataFrame, rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs at ``threshold`` or more, from the texts of their records among ``rows`` (ord, key)."""
    wanted = durable(pairs.select(F.col("a").alias("ord")).unionAll(pairs.select("b")).distinct())
    texts = durable(rows.join(_light(wanted), "ord", "left_semi").select("ord", "key"))

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        sets = lru_cache(maxsize=1000)(lambda key: shingle_hashes(key, n))
        return pd.Series([(o := len(np.intersect1d(p, q, assume_unique=True))) / (len(p) + len(q) - o) for p, q in zip(map(sets, x), map(sets, y))], dtype=float)

    both = pairs.join(texts.toDF("a", "ka"), "a").join(texts.toDF("b", "kb"), "b")
    return both.select("a", "b", jaccard("ka", "kb").alias("jaccard")).filter(F.col("jaccard") >= threshold)


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(left.select(F.col("cls").alias("a"), F.col("sh").alias("sa"), F.col("grp").alias("ga")), "a").join(right.select(F.col("cls").alias("b"), F.col("sh").alias("sb"), F.col("grp").alias("gb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.withColumn("jaccard", shared / (F.size("sa") + F.size("sb") - shared))
    return both.filter((F.col("jaccard") >= threshold) & F.coalesce(F.col("ga") != F.col("gb"), F.lit(True))).select("a", "b", "jaccard")


def _candidates(a: DataFrame, b: DataFrame, threshold: float, together: int = 1, within: bool = False) -> DataFrame:
    """(a, b) of the sets that share ``together`` keys, or as many as the larger must have in common, and whose sizes allow the threshold."""
    left, right = a.toDF("a", "na", "s"), b.toDF("b", "nb", "s")
    near = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    met = left.join(right, "s").filter(near & ((F.col("a") > F.col("b")) if within else F.lit(True)))
    need = F.least(F.lit(together), F.ceil(F.lit(threshold) * F.greatest(F.max("na"), F.max("nb")) - 1e-9))
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), need.alias("need")).filter("n >= need").select("a", "b")


def _repeated(df: DataFrame, text: str, ident: str, threshold: float, n: int, group: str | None = None, mode: str = "exact", keep: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is found in one scan of ``df`` and one of its signatures, without moving a text that isn't compared.

    ``named`` (ord, grp, some, digest, id, and what to ``keep``): a row a record; some: the key isn't empty. ``marks`` (digest, cls): the classes
    of several records or with a similar one, and their first records. ``links`` (a, b, jaccard): similar classes, b the earlier one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, at most 1")
    by_parts = mode != "lsh" and threshold >= LEAST_BY_PARTS
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    texts = df.select(F.col(ident).alias("ord"), X.dedup_key(text).alias("key"), g.alias("grp"), *[c.alias(k) for k, c in (keep or {}).items()])  # filtered where it is read: a filter here would work out each key twice
    digest, salt = F.unhex(F.sha2("key", 256)), F.coalesce(F.concat(F.lit("g"), "grp"), F.lit(""))
    if group:
        digest = F.unhex(F.sha2(F.concat(digest, salt.cast("binary")), 256))
    ident_of = F.xxhash64("key", salt)
    if by_parts:  # records that share 32 bits are compared by their texts
        ident_of = F.shiftright(ident_of, 32).cast("int")
    named = durable(texts.select("ord", "grp", (F.col("key") != "").alias("some"), F.substring(digest, 1, 16).alias("digest"), ident_of.alias("id"), *(keep or {})))
    full = named.filter("some").select("ord", "grp", "digest", "id")
    total = full.count()
    again = durable(named.filter("digest is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    shared = durable(named.filter("digest is not null").join(_light(again), "id", "left_semi").groupBy("digest").agg(F.min("ord").alias("cls"), F.first("id").alias("id"), F.first("some").alias("some"), F.count("*").alias("n")))
    copied = shared.filter("n > 1")
    twins = shared.filter("some").groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    keyed = texts.select("ord", ident_of.alias("id"), "key", "grp")
    if mode == "lsh":
        keys = durable(minhash_bands(_shingled(keyed.filter("key <> ''").select(F.col("id").alias("cls"), "grp", "key"), n)).distinct(), free=True)
        met = _candidates(keys, keys, threshold, 1, within=True)
    elif by_parts:
        met = _equal_parts(_first_ones(keyed, full, copied, total), n, threshold, total)
    else:
        sets = durable(_shingled(keyed.select("id", "key", "grp").filter("key <> ''").dropDuplicates().select(F.col("id").alias("cls"), "grp", "key"), n))
        keys = durable(_prefixes(sets, threshold, frequent_shingles(sets)))
        met = _candidates(keys, keys, threshold, TOGETHER, within=True)
    met = durable(met.unionByName(twins), free=True)
    wanted = durable(met.select(F.col("a").alias("id")).unionAll(met.select("b")).distinct())
    c = durable(full.join(_light(wanted), "id", "left_semi").groupBy("digest").agg(F.min("ord").alias("cls"), F.first("grp").alias("grp"), F.first("id").alias("id")))
    own = c.select("id", "cls", "grp")
    met = met.join(own.toDF("a", "ca", "ga"), "a").join(own.toDF("b", "cb", "gb"), "b").filter("ca <> cb and coalesce(ga <> gb, true)")
    pairs = durable(met.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), free=True)
    links = durable(_similar(pairs, texts.select("ord", "key"), n, threshold), free=True)
    linked = links.select(F.col("a").alias("cls")).unionAll(links.select("b")).distinct()
    return named, durable(copied.select("digest", "cls").unionByName(c.join(linked, "cls", "left_semi").select("digest", "cls")).distinct(), free=True), links


def _first_ones(keyed: DataFrame, full: DataFrame, copied: DataFrame, total: int) -> DataFrame:
    """``keyed`` without the copies of earlier records, or with the records that begin a class only, where either are few."""
    again = copied.filter("some").select("digest", "cls", "n")
    copies = again.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    if not copies or min(copies, total - copies) > FEW:
        return keyed
    begins = full.join(_light(again), "digest", "left").select("ord", F.coalesce(F.col("cls") == F.col("ord"), F.lit(True)).alias("begins"))
    if copies > FEW:
        return keyed.join(F.broadcast(durable(begins.filter("begins").select("ord"), free=True)), "ord", "left_semi")
    later = durable(begins.filter("not begins").select("ord").distinct(), free=True)
    both = begins.filter("begins").join(F.broadcast(later), "ord", "left_semi").select("ord")  # where one number stands for several records
    return keyed.join(F.broadcast(durable(later.join(both, "ord", "left_anti"), free=True)), "ord", "left_anti")


def near_duplicates_within(df: DataFrame, text: str, ident: str, threshold: float = 0.8, n: int = 5, group: str | None = None, mode: str = "exact") -> DataFrame:
    """(ident, duplicate_of, jaccard) of records with an earlier record of Jaccard ``threshold`` or more.

    Records of one non-null group are never compared. Null and empty texts match nothing. ``mode`` ``lsh`` finds candidates by MinHash
    bands (16 of 8: nearly all at 0.9 and above), ``exact`` finds all.
    """
    named, marks, links = _repeated(df, text, ident, threshold, n, group, mode)
    top = F.max(F.struct("jaccard", (-F.col("b")).alias("b"))).alias("m")
    rows = named.filter("some").join(_light(marks), "digest").select("ord", "grp", "cls")
    if group:  # later members of a group's class may meet classes that began after their own
        both = links.select("a", "b", "jaccard").unionAll(links.select("b", "a", "jaccard"))
        best = rows.join(both, F.col("cls") == F.col("a")).filter("b < ord").groupBy("ord").agg(top)
        rows = rows.join(best, "ord", "left")
    else:
        rows = rows.join(links.groupBy("a").agg(top).withColumnRenamed("a", "cls"), "cls", "left")
    copy, other = (F.col("cls") < F.col("ord")) & F.col("grp").isNull(), -F.col("m.b")
    first = F.when(copy & (F.coalesce(F.col("m.jaccard"), F.lit(0.0)) < 1.0), F.col("cls")).when(copy, F.least("cls", other)).otherwise(other)
    out = rows.select(F.col("ord").alias(ident), first.alias("duplicate_of"), F.when(copy, 1.0).otherwise(F.col("m.jaccard")).alias("jaccard"))
    return out.filter("duplicate_of is not null")


def repeats(df: DataFrame, text: str, ident: str, keep: dict[str, Column], threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(ident, what to ``keep``, present, duplicate_of, near): every record of ``df`` with the first record of its key, as ``exact_duplicates``
    has it, and whether ``near_duplicates_within`` has a row for it. Keys are worked out once for both, and no record is shuffled where few are repeated."""
    named, marks, links = _repeated(df, text, ident, threshold, n, keep=keep)
    marks = durable(marks.join(links.select(F.col("a").alias("cls"), F.lit(True).alias("linked")).distinct(), "cls", "left"), free=True)
    keyed, none = named.filter("digest is not null"), named.filter("digest is null")  # rows without a key meet nothing and don't all go to one task
    rows = keyed.join(_light(marks), "digest", "left").unionByName(none, allowMissingColumns=True)
    later = F.coalesce(F.col("cls") < F.col("ord"), F.lit(False))
    near = F.coalesce("some", F.lit(False)) & (later | F.coalesce("linked", F.lit(False)))
    return rows.select(F.col("ord").alias(ident), *keep, F.coalesce("some", F.lit(False)).alias("present"), F.when(later, F.col("cls")).alias("duplicate_of"), near.alias("near"))


def near_duplicates_against(df: DataFrame, refs: DataFrame, text: str, ident: str, ref_text: str, ref_ident: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(ident, duplicate_of, jaccard): the most similar reference of each record at ``threshold`` or more, the earliest on ties."""
    cls, ref = durable(_classes(df, text, ident, None)), _classes(refs, ref_text, ref_ident, None)
    a, b = durable(_shingled(cls, n)), durable(_shingled(ref, n))
    counts = frequent_shingles(a.unionByName(b))
    left, right = _prefixes(a, threshold, counts), _prefixes(b, threshold, counts)
    links = _verified(_candidates(left, right, threshold, TOGETHER), a, b, threshold)
    best = links.groupBy("a").agg(F.max(F.struct("jaccard", (-F.col("b")).alias("b"))).alias("m"))
    rows = df.select(F.col(ident).alias("ord"), X.dedup_key(text).alias("key")).join(cls.select("key", F.col("cls").alias("a")), "key").join(best, "a")
    return rows.select(F.col("ord").alias(ident), (-F.col("m.b")).alias("duplicate_of"), F.col("m.jaccard").alias("jaccard"))


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with ``failed_checks`` (all that fail, in the order given) and ``rejected_by`` (the first); a null check passes."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("failed_checks", failed).withColumn("rejected_by", F.get("failed_checks", F.lit(0)))


def filter_stats(checked: DataFrame, by: str) -> DataFrame:
    """Kept and rejected of each group, with the share kept."""
    kept = F.count_if(F.col("rejected_by").isNull())
    return checked.groupBy(by).agg(F.count("*").alias("n_in"), kept.alias("n_kept"), (F.count("*") - kept).alias("n_rejected"), (kept / F.count("*")).alias("kept_rate"))


def check_counts(checked: DataFrame, checks: list[str], by: str) -> DataFrame:
    """(measure, name, n): ``failed`` and ``rejected_by`` for every check, and ``kept_of`` and ``rejected_of`` for every group, a null one being ''."""
    rows = checked.groupBy(F.coalesce(F.col(by), F.lit("")).alias("g"), "failed_checks", "rejected_by").agg(F.count("*").alias("n"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    totals = rows.agg(*[some(F.array_contains("failed_checks", k)).alias(f"f_{k}") for k in checks], *[some(F.col("rejected_by") == k).alias(f"r_{k}") for k in checks])
    entries = [F.struct(F.lit(m).alias("measure"), F.lit(k).alias("name"), F.col(f"{c}_{k}").alias("n")) for m, c in (("failed", "f"), ("rejected_by", "r")) for k in checks]
    kept = F.when(F.col("rejected_by").isNull(), "kept_of").otherwise("rejected_of")
    return totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*").unionByName(rows.groupBy(kept.alias("measure"), F.col("g").alias("name")).agg(F.sum("n").alias("n")))


def first_come(df: DataFrame, key: Column, wanted: Column, order: list[str], by: str) -> DataFrame:
    """Counters of each dataset of a pool: empty, unwanted, repeat or kept; only wanted texts can make later ones repeats."""
    kind = F.when(F.coalesce(key, F.lit("")) == "", "empty").when(~wanted, "unwanted")
    rows = df.select(by, *[c for c in order if c != by], key.alias("_key"), kind.alias("_kind"))
    first = rows.filter("_kind is null").groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    rows = rows.join(first, "_key", "left").withColumn("_kind", F.coalesce("_kind", F.when(F.struct(*order) == F.col("_first"), "kept").otherwise("repeat")))
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("_kind") == k).alias(k) for k in ("empty", "unwanted", "repeat", "kept")])

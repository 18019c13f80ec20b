"""Problem 8: filling windows of fixed capacity, by deficit round-robin over source queues.

Every source earns its share of each window as a deficit, and the source with the largest deficit whose queue has an item that fits
places its largest one; so each window holds the sources in their proportions and is filled to the last tokens. Deficits go on from
window to window, and from shard to shard: what a shard starts with follows from the sizes in the shards before it, so that shards
are packed at the same time.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import ranks
from lexmill.session import durable

SHARD_WINDOWS = 2000  # windows a shard fills; its documents' sizes are held by one task


def fill(items: list[tuple[int, object]], sources: list[str], shares: dict[str, float], deficits: dict[str, float], capacity: int) -> list[int]:
    """The window of each item (size, key), its source given beside it; no item is larger than ``capacity``."""
    queues: dict[str, list[tuple[int, int]]] = {}
    for k, ((size, _), s) in enumerate(zip(items, sources)):
        queues.setdefault(s, []).append((size, -k))
    for q in queues.values():
        q.sort()
    owed = {s: deficits.get(s, 0.0) for s in queues}
    window, placed = 0, [0] * len(items)
    while queues:
        for s in queues:
            owed[s] += shares.get(s, 0.0) * capacity
        room, waiting = capacity, sorted(queues, key=lambda s: (-owed[s], s))
        while waiting:
            s = waiting[0]
            q = queues[s]
            at = bisect_right(q, (room, 1)) - 1
            if at < 0:
                waiting.pop(0)
                continue
            size, k = q.pop(at)
            placed[-k] = window
            room -= size
            owed[s] -= size
            if not q:
                del queues[s]
                waiting.pop(0)
            waiting.sort(key=lambda s: (-owed[s], s))
        window += 1
    return placed


def pack(sizes: DataFrame, capacity: int, ident: str = "doc_id", source: str = "source", size: str = "n_tokens", targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, piece, n_pieces, first_token, n_tokens, shard, window, mixed): the window of each document or, where it exceeds the capacity, of each of its pieces.

    Pieces of a too large document are ``capacity`` tokens long but for the last. Windows hold the sources in the proportions of the
    data or, with ``targets`` (source, target_share), in those. With targets, as much of each source as the scarcest one allows goes
    into windows of the target proportions (``mixed``); what is left fills windows of its own, in the proportions of what is left.
    Sources without a target are left over as a whole. Documents without tokens fill no window and have no row; a null source is a
    source; repeated rows are packed each; an empty table gives no rows.
    """
    docs = sizes.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(size).cast("long").alias("size")).filter("size > 0")
    docs = durable(docs)
    n = F.ceil(F.col("size") / capacity).cast("int")
    cap = F.lit(capacity).cast("long")
    items = docs.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    items = items.select("doc_id", "source", "piece", "n_pieces", (F.col("piece") * cap).alias("first_token"), F.least(cap, F.col("size") - F.col("piece") * cap).alias("n_tokens"))
    have = docs.groupBy("source").agg(F.sum("size").alias("have"))
    if targets is None:
        parts = have.select("source", "have", F.lit(1.0).alias("part"))
    else:
        goal = targets.filter("target_share > 0").select(F.coalesce("source", F.lit("")).alias("source"), "target_share")
        both = have.join(goal, "source", "full")
        room = both.filter("target_share is not null").agg(F.min(F.coalesce("have", F.lit(0)) / F.col("target_share"))).first()[0] or 0.0
        parts = both.filter("have is not null").select("source", "have", F.coalesce(F.col("target_share") * F.lit(float(room)) / F.col("have"), F.lit(0.0)).alias("part"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "piece"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    items = items.join(parts, "source").withColumn("mixed", part < F.col("part")).drop("part", "have")
    totals = {r.mixed: r.n for r in items.groupBy("mixed").agg(F.sum("n_tokens").alias("n")).collect()}
    shards = {m: max(1, round(t / (SHARD_WINDOWS * capacity))) for m, t in totals.items()}
    first, all_first, all_rest = shards.get(True, 0), float(max(totals.get(True, 0), 1)), float(max(totals.get(False, 0), 1))
    h = F.xxhash64("doc_id", "piece")
    items = items.withColumn("shard", F.when(F.col("mixed"), F.pmod(h, F.lit(max(1, first)))).otherwise(first + F.pmod(h, F.lit(max(1, shards.get(False, 1))))).cast("int"))
    items = durable(items)
    per = items.groupBy("mixed", "shard", "source").agg(F.sum("n_tokens").alias("n"))
    of_all = per.groupBy("mixed", "source").agg((F.sum("n") / F.when(F.col("mixed"), F.lit(all_first)).otherwise(F.lit(all_rest))).alias("share"))
    earlier = ranks.totals_before(per.groupBy("mixed", "shard").agg(F.sum("n").alias("all")), ["mixed"], "shard", "all", "earlier", sum(shards.values())).select("shard", "earlier")
    owed = ranks.totals_before(per, ["mixed", "source"], "shard", "n", "had", sum(shards.values())).join(of_all, ["mixed", "source"]).join(earlier, "shard")
    owed = owed.select("shard", "source", "share", (F.col("share") * F.col("earlier") - F.col("had")).alias("owed"))

    rows = items.join(owed, ["shard", "source"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "n_tokens", "doc_id", "piece"]).reset_index(drop=True)
        first = rows.drop_duplicates("source")
        where = fill(list(zip(rows["n_tokens"], rows["doc_id"])), list(rows["source"]), dict(zip(first["source"], first["share"])), dict(zip(first["source"], first["owed"])), capacity)
        return rows.drop(columns=["share", "owed"]).assign(window=where)

    cols = "doc_id long, source string, piece int, n_pieces int, first_token long, n_tokens long, shard int, window int, mixed boolean"
    names = [c.split()[0] for c in cols.split(", ")]
    return rows.groupBy("shard").applyInPandas(lambda rows: packed(rows)[names], cols)


def split_documents(packed: DataFrame) -> DataFrame:
    """(doc_id): the documents of which several pieces were placed."""
    return packed.groupBy("doc_id").agg(F.count_distinct("piece").alias("n")).filter("n > 1").select("doc_id")


def waste(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: windows, tokens, and the share of their room that stays empty."""
    per = packed.groupBy("shard", "window").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_tokens"), (1 - F.sum("n") / (F.count("*") * F.lit(float(capacity)))).alias("waste"))

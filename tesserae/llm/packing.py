"""Packing of documents into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import written

CAPACITY = 2048
SHARD_DOCS = 256
SAME = 64
SCHEMA = "shard long, window int, n_words int, segments array<struct<doc_id:long,start_word:int,n_words:int>>"


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Set of each item and sum of each of k sets.

    A partial partition is k set sums in descending order. The two of widest spread merge, largest sum to smallest,
    until one is left. Equal spreads merge in order of arrival, so the result is a function of the input.
    """
    n = len(sizes)
    parent_perm: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    sums: list[np.ndarray | None] = []
    heap = []
    for i in range(n):
        s = np.zeros(k, np.int64)
        s[0] = sizes[i]
        sums.append(s)
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        s = sums[a] + sums[b][::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        s_id = len(sums)
        sums.append(s)
        sums[a] = sums[b] = None
        parent_perm.append((a, b, order, s))
        heapq.heappush(heap, (-int(s[0] - s[-1]), s_id))
    # Undo the merges: slot j of a merged partition is slot order[j] of a and slot k-1-order[j] of b.
    slot: dict[int, np.ndarray] = {n + len(parent_perm) - 1 if parent_perm else 0: np.arange(k)}
    final = sums[-1] if n else np.zeros(k, np.int64)
    of = np.zeros(n, np.int64)
    for m in range(len(parent_perm) - 1, -1, -1):
        a, b, order, _ = parent_perm[m]
        names = slot.pop(n + m)
        back = np.empty(k, np.int64)
        back[order] = names
        for part, mapped in ((a, back), (b, back[::-1])):
            if part < n:
                of[part] = mapped[0]
            else:
                slot[part] = mapped
    return of, final


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item: as few sets as differencing can keep within capacity, counting up from the least that could do."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(-(-int(sizes.sum()) // capacity), int((sizes > capacity // 2).sum()), 1)
    while True:
        of, sums = differencing(sizes, k)
        over = int(np.maximum(sums - capacity, 0).sum())
        if not over:
            return of
        k += max(1, over // capacity)


def shard_windows(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Windows of one shard's documents, rows of (doc_id, n_words, copies). A document longer than capacity fills windows of its own; its rest is packed."""
    pdf = pdf.loc[pdf.index.repeat(pdf["copies"])]
    pdf = pdf.sort_values(["n_words", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    n = pdf["n_words"].to_numpy(np.int64)
    ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
    out: list[list[tuple]] = []
    for i, size in enumerate(n):
        out += [[(ids[i], int(k * capacity), capacity)] for k in range(size // capacity)]
    rest = n % capacity
    at = np.flatnonzero(rest)
    of = fill(rest[at], capacity)
    packed: dict[int, list[tuple]] = {}
    for i, w in zip(at, of):
        packed.setdefault(int(w), []).append((ids[i], int(n[i] - rest[i]), int(rest[i])))
    out += [packed[w] for w in sorted(packed)]
    return pd.DataFrame(
        {
            "shard": pd.Series([int(pdf["shard"].iloc[0])] * len(out), dtype="int64"),
            "window": pd.Series(range(len(out)), dtype="int32"),
            "n_words": pd.Series([sum(s[2] for s in w) for w in out], dtype="int32"),
            "segments": [[{"doc_id": a, "start_word": b, "n_words": c} for a, b, c in w] for w in out],
        }
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Windows of at most `capacity` words that hold every word of every document once.

    One row a window: shard, window, n_words and its segments (doc_id, first word, words). Words are runs without
    white space. Null, empty and blank texts have no words and no segment; a repeated row is packed as often as it
    occurs; a null doc_id is kept as null; other columns are ignored. An empty table gives no windows.

    Documents are dealt to shards by hash, about `shard_docs` to each, so that the shards' number follows the input and
    only (doc_id, n_words) is shuffled. Rows of one doc_id and length are alike to packing; they are counted first and dealt in
    lots of SAME, so that no shard gets them all, however many there are. Equal sizes are packed in order of doc_id, nulls last.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("int").alias("n_words"),
    ).filter("n_words > 0")
    alike = written(sized.groupBy("doc_id", "n_words").agg(F.count("*").alias("copies")), "sized")
    shards = max(1, -(-(alike.agg(F.sum("copies")).first()[0] or 0) // shard_docs))
    lots = alike.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {SAME}"))))
    lots = lots.select("doc_id", "n_words", F.least(F.lit(SAME), F.expr(f"copies - lot * {SAME}")).alias("copies"), F.pmod(F.xxhash64("doc_id", "n_words", "lot"), F.lit(shards)).alias("shard"))
    tasks = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return lots.repartition(tasks, "shard").groupBy("shard").applyInPandas(lambda pdf: shard_windows(pdf, capacity), SCHEMA)

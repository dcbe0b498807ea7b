"""Jaccard join of word n-gram sets: near-duplicate documents, their links and their groups, exactly.

Texts of equal sets form a class, and one of them stands for it. Classes are compared in size-banded tiles, whose bitmaps
bound every overlap from above before sorted arrays are intersected. Two steps say which tiles meet, and lose no pair:

1. Minimal-hash keys join classes that look alike into blocks; all of a block is compared. This only saves work.
2. Pairs across blocks come from a prefix filter: in one order of all n-grams, rare ones first, two sets that reach the
   threshold share several of each one's first n-grams. Blocks that share enough of them are compared, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.components import components
from tesserae.llm.shared import drop, fresh, with_row_id, written
from tesserae.llm.text import U, mix, pieces, shingles, trim, words

N, THRESHOLD, BANDS, ROWS = 3, 0.5, 8, 4
TILE_SIZE = 1 << 19
#: Counters of the sketch that orders n-grams, in pieces of PIECE. Any order gives the same result; a fixed size bounds what is broadcast.
COUNTERS, PIECE = 1 << 20, 1 << 14
FLUSH = 1 << 18
BUCKET = 1 << 20
MOST = np.iinfo(np.uint32).max
SKETCH = "row_id long, doc_id long, size long, c1 long, c2 long, keys array<long>, piece int, counts binary"
POSTING = "bucket long, grams binary, owners binary, reaches binary, blocks binary, leasts binary"


def text_sets(texts, n: int) -> list[np.ndarray]:
    """The sorted n-gram hashes of each text, without repeats."""
    out = []
    for _, _, data, off in pieces(pa.array(texts, pa.string())):
        h, _, _, woff = words(data, off, fold=True)
        x, count = shingles(h, woff, n)
        end = np.cumsum(count)
        out += [np.unique(x[e - c : e]) for e, c in zip(end, count)]
    return out


def _sketch(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Size, hashes and keys of each set; at the end, how many n-grams of the task fell on each counter."""
    seed = mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    total = np.zeros(COUNTERS, np.int32)
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int32(), pa.binary()]
    names = ["row_id", "doc_id", "size", "c1", "c2", "keys", "piece", "counts"]
    for batch in batches:
        ids = np.asarray(batch.column(0))
        docs = batch.column(1)
        for lo, hi, data, off in pieces(batch.column(2)):
            h, _, _, woff = words(data, off, fold=True)
            x, count = shingles(h, woff, n)
            full = np.flatnonzero(count > 0)
            if not len(full):
                continue
            count = count[full]
            start = np.cumsum(count) - count
            sets = [np.unique(x[a : a + c]) for a, c in zip(start, count)]
            size = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            start = np.cumsum(size) - size
            total += np.bincount(_counter(flat), minlength=COUNTERS).astype(np.int32)
            c1 = np.add.reduceat(mix(flat), start)
            c2 = np.add.reduceat(mix(flat ^ U(0x5851F42D4C957F2D)), start)
            keys = np.empty((len(full), bands), U)
            for b in range(bands):
                key = np.full(len(full), b + 1, U)
                for r in range(rows):
                    g = flat * seed[b * rows + r]
                    g ^= g >> U(31)
                    key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(g, start))
                keys[:, b] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            given = [pa.array(ids[lo:hi][full]), docs.slice(lo, hi - lo).take(pa.array(full)), pa.array(size), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays([*given, *(pa.nulls(len(full), k) for k in kinds[6:])], names)
    if total.any():
        parts = total.reshape(-1, PIECE)
        given = [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(parts), k) for k in kinds[:6]), *given], names)
    trim()


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> U(20)).astype(np.int64) & (COUNTERS - 1)


def _levels(sketched: DataFrame) -> np.ndarray:
    """Of each counter, four times the logarithm of its count, in one byte."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(PIECE, np.int64)
        for raw in pdf["counts"]:
            counts += np.frombuffer(raw, np.int32)
        level = np.minimum(np.log2(1 + counts) * 4, 255).astype(np.uint8)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1].to_numpy(), "levels": [level.tobytes()]})

    out = np.zeros(COUNTERS, np.uint8)
    counts = sketched.filter("piece is not null").select("piece", "counts")
    for row in counts.groupBy("piece").applyInPandas(total, "piece int, levels binary").collect():
        out[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.levels, np.uint8)
    return out


def extra(size):
    """By how many n-grams a prefix is longer than needed for one common n-gram; so many more must be common."""
    return size // 32


def prefixes(sets: list[np.ndarray], levels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set's first n-grams in the common order: hash, set, and the largest size of a partner that it can lead to.

    Sets x and y reach threshold t if they share at least a = t / (1 + t) * (|x| + |y|) members, and t * |x| <= a. The first
    1 + e of these are within the first |x| - t * |x| + 1 + e of x, and the one at place p leaves |x| - p + e >= a.
    """
    size = np.array([len(s) for s in sets], np.int64)
    more = extra(size)
    long = np.minimum(size, size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1 + more)
    out = []
    for s, k in zip(sets, long):
        key = (levels[_counter(s)].astype(U) << U(56)) | (s >> U(8))
        out.append(np.sort(np.partition(key, k - 1)[:k] if k < len(key) else key))
    owner = np.repeat(np.arange(len(sets)), long)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(long) - long, long)
    reach = np.floor((size[owner] - place + more[owner]) * ((1 + threshold) / threshold) + 1e-6).astype(np.int64) - size[owner]
    return (np.concatenate(out) if out else np.zeros(0, U)), owner, reach


def _postings(batches: Iterator[pa.RecordBatch], n: int, threshold: float, levels: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The prefixes' n-grams dealt to buckets, each n-gram of a block once for each run of texts: its hash, the block, the block's
    least size and its largest reach."""
    held: list[tuple] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        gram, block, least, reach = (np.concatenate(c) for c in zip(*held))
        held.clear()
        mixed = mix(gram)
        bucket, low = (mixed >> U(32)) % U(buckets), mixed.astype(np.uint32)
        order = np.lexsort((block, low, bucket))
        bucket, low, block, least, reach = bucket[order], low[order], block[order], least[order], reach[order]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1])]))
        reach = np.maximum.reduceat(reach, new)
        bucket, low, block, least = bucket[new], low[new], block[new], least[new]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        rows: list[list] = [[] for _ in range(6)]
        for a, z in zip(edge[:-1], edge[1:]):
            blocks, first, owner = np.unique(block[a:z], return_index=True, return_inverse=True)
            parts = (low[a:z], owner.astype(np.uint32), reach[a:z], blocks, least[a:z][first])
            for column, value in zip(rows, (int(bucket[a]), *(p.tobytes() for p in parts))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], [c.split()[0] for c in POSTING.split(", ")])

    for batch in batches:
        block, least = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for lo, hi, data, off in pieces(batch.column(0)):
            h, _, _, woff = words(data, off, fold=True)
            x, count = shingles(h, woff, n)
            end = np.cumsum(count)
            sets = [np.unique(x[e - c : e]) for e, c in zip(end, count)]
            gram, owner, reach = prefixes(sets, levels, threshold)
            held.append((gram, block[lo:hi][owner], np.minimum(least[lo:hi], MOST).astype(np.uint32)[owner], np.minimum(reach, MOST).astype(np.uint32)))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield from flushed()
    if held:
        yield from flushed()
    trim()


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's postings, the pairs of blocks a < b that share n-grams at places that let them reach the threshold, with the number of these n-grams."""
    parts: list[list[np.ndarray]] = [[] for _ in range(4)]
    for batch in batches:
        for grams, owners, reaches, blocks, leasts in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            owner = np.frombuffer(owners, np.uint32)
            for column, value in zip(parts, (np.frombuffer(grams, np.uint32), np.frombuffer(blocks, np.int64)[owner], np.frombuffer(leasts, np.uint32)[owner], np.frombuffer(reaches, np.uint32))):
                column.append(value)
    if not parts[0]:
        return
    gram, block, least, reach = (np.concatenate(c) for c in parts)
    parts.clear()
    # Most n-grams come once and go before the sort by block.
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = g[1:] == g[:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    gram, block, least, reach = gram[order], block[order], least[order].astype(np.int64), reach[order].astype(np.int64)
    order = np.lexsort((block, gram))
    gram, block, least, reach = gram[order], block[order], least[order], reach[order]
    if not len(gram):
        return
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])]))
    reach = np.maximum.reduceat(reach, new)
    gram, block, least = gram[new], block[new], least[new]
    later = np.searchsorted(gram, gram, "right") - np.arange(len(gram)) - 1
    some = np.flatnonzero(later)
    begin, found = 0, []
    ends = np.cumsum(later[some])
    while begin < len(some):  # in runs of about FLUSH pairs
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + FLUSH, "right")))
        count = later[some[begin:stop]]
        i = np.repeat(some[begin:stop], count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        ok = (least[i] <= reach[j]) & (least[j] <= reach[i])
        i, j = i[ok], j[ok]
        pair = np.stack([block[i], block[j], 1 + np.minimum(extra(least[i]), extra(least[j]))], axis=1)
        found.append(np.unique(pair, axis=0, return_counts=True))
        begin = stop
    pair, count = np.concatenate([p for p, _ in found]) if found else np.zeros((0, 3), np.int64), np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
    if len(pair):
        yield pa.RecordBatch.from_arrays([*(pa.array(pair[:, k]) for k in range(3)), pa.array(count.astype(np.int64))], ["ca", "cb", "needed", "shared"])


def bitmaps(flat: np.ndarray, size: np.ndarray, words64: int) -> np.ndarray:
    """A bitmap of 64 * words64 bits for each set; flat: the sets one after another."""
    out = np.zeros((len(size), words64), U)
    bit = mix(flat ^ U(0x2545F4914F6CDD1D)) % U(64 * words64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(size)), size), (bit >> U(6)).astype(np.int64)), U(1) << (bit & U(63)))
    return out


def tile_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, jaccards): of each i in left the members of right, i aside, with a Jaccard index of at least threshold. If left
    is right, each pair comes once.

    sets: sorted, without repeats. A bit set in one map but not in the other stands for at least one member that the
    other lacks, which bounds the overlap from above; the pairs that the bound leaves are intersected, sorted array by
    sorted array.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    off = np.concatenate([[0], np.cumsum(size)])
    width = int(min(256, max(4, 1 << int(np.ceil(np.log2(max(1, size.max()) / 32 + 1))))))
    maps = bitmaps(flat, size, width)
    ones = np.bitwise_count(maps).sum(1).astype(np.int64)
    same = left is right
    by_size = right[np.argsort(size[right], kind="stable")]
    sorted_sizes = size[by_size]
    for i in left:
        lo, hi = np.searchsorted(sorted_sizes, [np.ceil(size[i] * threshold - 1e-9), np.floor(size[i] / threshold + 1e-9) + 1])
        js = by_size[lo:hi]
        js = js[js > i] if same else js[js != i]
        if not len(js):
            continue
        both = np.bitwise_count(maps[js] & maps[i]).sum(1).astype(np.int64)
        most = np.minimum(size[i] - (ones[i] - both), size[js] - (ones[js] - both))
        js = js[most >= (size[i] + size[js] - most) * threshold - 1e-9]
        if not len(js):
            continue
        begin = np.concatenate([[0], np.cumsum(size[js])])
        other = flat[np.arange(begin[-1]) + np.repeat(off[js] - begin[:-1], size[js])]
        mine = sets[i]
        at = np.searchsorted(mine, other)
        at[at == len(mine)] = 0
        overlap = np.add.reduceat(mine[at] == other, begin[:-1], dtype=np.int64)
        jaccard = overlap / (size[i] + size[js] - overlap)
        near = jaccard >= threshold - 1e-12
        if near.any():
            yield int(i), js[near], jaccard[near]


def _band(size: Column) -> Column:
    """Four bands of sizes to an octave. A tile is a run of bands of one block, or a part of one that is too large."""
    return F.floor(F.log2(size) * 4 + 1e-9).cast("int")


def _in_tiles(docs: DataFrame, n: int, threshold: float, bands: int, rows: int, tile_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of the tiles that meet, the classes, and the class of each row_id."""
    if not 0.1 <= threshold <= 1:
        raise ValueError("threshold must be between 0.1 and 1")
    source = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).filter("doc_id is not null and text is not null")
    sketched = written(source.select("row_id", "doc_id", "text").mapInArrow(lambda it: _sketch(it, n, bands, rows), SKETCH), "sketch")
    single = sketched.filter("piece is null").groupBy("c1", "c2", "row_id").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    single = written(single, "single")
    kept = single.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row_id")).alias("rep"), F.count("*").alias("members"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = written(kept.select("c1", "c2", F.col("rep.row_id").alias("class"), F.col("rep.doc_id").alias("doc_id"), "members", "size", "keys"), "classes")
    belongs = single.select("row_id", "doc_id", "c1", "c2").join(classes.select("c1", "c2", "class"), ["c1", "c2"]).select("class", "row_id", "doc_id")

    keyed = classes.select(F.col("class").alias("row_id"), F.explode("keys").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("row_id").alias("b"), F.max("row_id").alias("top")).filter("b <> top")
    roots = components(keyed.join(firsts, "key").filter("row_id <> b").select(F.col("row_id").alias("a"), "b"))
    blocked = classes.join(roots.withColumnRenamed("a", "class").withColumnRenamed("root", "up"), "class", "left").select("class", F.coalesce("up", "class").alias("block"), "members", "doc_id", "size")
    blocked = written(blocked, "blocked")
    leasts = blocked.groupBy("block").agg(F.min("size").alias("least"), F.count("*").alias("n"))
    placed = written(blocked.join(leasts, "block"), "placed")
    drop(blocked)

    levels, total = _levels(sketched), classes.agg(F.sum("size")).first()[0] or 0
    drop(sketched)
    buckets = max(1, -(-total // (2 * BUCKET)))
    texts = source.select("row_id", "text").join(placed.select(F.col("class").alias("row_id"), "block", "least").hint("shuffle_hash"), "row_id").select("text", "block", "least")
    postings = texts.mapInArrow(lambda it: _postings(it, n, threshold, levels, buckets), POSTING)

    def met(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _meetings(batches)

    shares = postings.groupBy("bucket").applyInArrow(met, "ca long, cb long, needed long, shared long")
    meets = written(shares.groupBy("ca", "cb").agg(F.max("needed").alias("needed"), F.sum("shared").alias("shared")).filter("shared >= needed").select("ca", "cb"), "meets")

    banded = placed.withColumn("band", _band(F.col("size")))
    volumes = banded.groupBy("block", "band").agg(F.sum("size").alias("volume"), F.min("size").alias("low"), F.max("size").alias("high"), F.first("n").alias("n"))
    before = F.sum("volume").over(Window.partitionBy("block").orderBy("band")) - F.col("volume")  # a block has few bands
    run = volumes.withColumn("run", F.floor(before / tile_size))
    cut = written(run.groupBy("block", "run").agg(F.ceil(F.sum("volume") / tile_size).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("n").alias("n"), F.sum("volume").alias("volume"), F.min("band").alias("from"), F.max("band").alias("to")), "tiles")
    tiles = cut.select("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct("run", p.alias("part")))).alias("tile"), "low", "high", "n", (F.col("volume") / F.col("parts")).alias("volume"))
    side = lambda x: tiles.select(*[F.col(c).alias(f"{c}_{x}") for c in tiles.columns])
    reach = (F.col("low_b") * threshold <= F.col("high_a")) & (F.col("low_a") * threshold <= F.col("high_b"))
    # A job compares one tile with itself, with another of its block, or with the tiles of other blocks that it meets, as many as make a tile.
    inner = side("a").filter("n_a > 1").join(side("b"), F.col("block_a") == F.col("block_b")).filter(reach & (F.col("tile_a") <= F.col("tile_b")))
    inner = inner.select(F.struct(F.col("block_a").alias("block"), F.col("tile_a").alias("tile"), F.lit(False).alias("across"), F.col("tile_b").alias("other")).alias("job"), "block_a", "tile_a", "block_b", "tile_b")
    one, two = (F.struct(*[F.col(f"{c}_{x}").alias(c) for c in ("volume", "block", "tile")]) for x in ("a", "b"))
    met_tiles = meets.join(side("a"), F.col("ca") == F.col("block_a")).join(side("b"), F.col("cb") == F.col("block_b")).filter(reach).select(F.greatest(one, two).alias("x"), F.least(one, two).alias("y"))
    met_tiles = written(met_tiles.select(*[F.col(f"{v}.{c}").alias(f"{c}_{n}") for v, n in (("x", "a"), ("y", "b")) for c in ("volume", "block", "tile")]), "met_tiles")
    batches = met_tiles.groupBy("block_a", "tile_a").agg(F.ceil(F.sum("volume_b") / tile_size).alias("batches"))
    batch = F.struct(F.lit(0).cast("long").alias("run"), F.pmod(F.xxhash64("block_b", "tile_b"), "batches").alias("part"))
    across = met_tiles.join(batches, ["block_a", "tile_a"]).select(F.struct(F.col("block_a").alias("block"), F.col("tile_a").alias("tile"), F.lit(True).alias("across"), batch.alias("other")).alias("job"), "block_a", "tile_a", "block_b", "tile_b")
    jobs = inner.unionByName(across)
    alone = (~F.col("job.across") & (F.col("tile_a") == F.col("tile_b"))).alias("alone")
    left = jobs.select("job", alone, F.lit(True).alias("on_left"), F.col("block_a").alias("block"), F.col("tile_a").alias("tile"))
    right = jobs.filter("job.across or tile_a <> tile_b").select("job", alone, F.lit(False).alias("on_left"), F.col("block_b").alias("block"), F.col("tile_b").alias("tile"))
    of = cut.select("block", "run", "parts", F.explode(F.sequence("from", "to")).alias("band"))
    dealt = banded.join(of, ["block", "band"]).select("class", "block", "members", "doc_id", F.struct("run", F.pmod(F.xxhash64("class"), "parts").alias("part")).alias("tile"))
    sent = written(dealt.join(left.distinct().unionByName(right), ["block", "tile"]).select(F.col("class").alias("row_id"), "members", "doc_id", "alone", "on_left", "job"), "sent")
    payload = source.select("row_id", "text").join(sent.hint("shuffle_hash"), "row_id").dropDuplicates(["row_id", "job"])
    return payload, classes, belongs


def _compared(pdf: pd.DataFrame, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    pdf = pdf.sort_values("row_id", kind="stable")
    on_left = pdf["on_left"].to_numpy(bool)
    left = np.flatnonzero(on_left)
    found = tile_pairs(text_sets(pdf["text"], n), left, left if pdf["alone"].iloc[0] else np.flatnonzero(~on_left), threshold)
    return pdf["row_id"].to_numpy(np.int64), pdf["doc_id"].to_numpy(np.int64), pdf["members"].to_numpy(np.int64), found


def linked(pdf: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """Of two tiles: each class with partners, how many documents these stand for, the nearest of them, and a class of its group in these tiles."""
    ids, docs, members, found = _compared(pdf, n, threshold)
    links, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
    best, whose = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, js, jaccard in found:
        links[i] += members[js].sum()
        links[js] += members[i]
        k = np.lexsort((docs[js], -jaccard))[0]
        if (-jaccard[k], docs[js[k]]) < (-best[i], whose[i]):
            best[i], whose[i] = jaccard[k], docs[js[k]]
        nearer = (jaccard > best[js]) | ((jaccard == best[js]) & (docs[i] < whose[js]))
        best[js[nearer]], whose[js[nearer]] = jaccard[nearer], docs[i]
        a = top(i)
        for j in js.tolist():
            b = top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                a = min(a, b)
    at = np.flatnonzero(links)
    return pd.DataFrame({"class": ids[at], "links": links[at], "nearest_id": whose[at], "jaccard": best[at], "up": np.array([ids[top(i)] for i in at.tolist()], np.int64)})


LINKED = "class long, links long, nearest_id long, jaccard double, up long"


def _by_row(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tile_size: int = TILE_SIZE) -> DataFrame:
    """near_duplicates() with the row_id of each row."""
    payload, classes, belongs = _in_tiles(docs, n, threshold, bands, rows, tile_size)
    found = written(payload.groupBy("job").applyInPandas(lambda pdf: linked(pdf, n, threshold), LINKED), "linked")
    total = found.groupBy("class").agg(F.sum("links").alias("links"), F.max_by(F.struct("nearest_id", "jaccard"), F.struct("jaccard", -F.col("nearest_id"))).alias("near"))
    roots = components(found.select(F.col("class").alias("a"), F.col("up").alias("b")))
    each = classes.select("class", "doc_id", "members").join(total, "class", "left").filter("members > 1 or links > 0").join(roots.withColumnRenamed("a", "class"), "class", "left")
    each = written(each.withColumn("root", F.coalesce("root", "class")), "each")
    lowest = each.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    about = each.join(lowest, "root").select(
        "class", "class_id", F.col("doc_id").alias("copy_of"), F.col("members").alias("copies"),
        (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("near.nearest_id").alias("nearest_id"), F.col("near.jaccard").alias("jaccard"),
    )
    return belongs.join(about, "class").select("row_id", "doc_id", "class_id", "copy_of", "copies", "links", "nearest_id", "jaccard")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each document that has near duplicates: n-gram sets with a Jaccard index of at least threshold.

    doc_id; class_id, the smallest doc_id of its connected group; copy_of, the smallest doc_id of the documents of its very
    set, and copies, their number, itself among them; links, how many other documents reach the threshold with it, copies
    too; nearest_id and jaccard, of the nearest one that has another set (the smallest doc_id of ties; null if there is none).

    n-grams (of n = 3 words) are of words without regard to case and punctuation, told apart by 64-bit hashes; a text of
    fewer words has one, of all its words. Every link is found, and the rows grow with the documents, not with their pairs.

    Null, empty or wordless texts and null doc_ids have no links. Equal rows count once. Rows of one doc_id and different
    texts are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    return _by_row(docs, **options).drop("row_id")


def class_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tile_size: int = TILE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(left_id, right_id, jaccard) of all pairs of different sets, each named by the smallest doc_id that has it, and (copy_of,
    doc_id), the documents of each set. Their join gives every pair of documents; rows of the first grow with the square of a group."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        _, ids, _, found = _compared(pdf, n, threshold)
        found = list(found)
        left, right = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in ([np.full(len(js), ids[i]) for i, js, _ in found], [ids[js] for _, js, _ in found]))
        return pd.DataFrame({"left_id": np.minimum(left, right), "right_id": np.maximum(left, right), "jaccard": np.concatenate([v for *_, v in found]) if found else np.zeros(0)})

    payload, classes, belongs = _in_tiles(docs, n, threshold, bands, rows, tile_size)
    members = belongs.join(classes.select("class", F.col("doc_id").alias("copy_of")), "class").select("copy_of", "doc_id")
    return payload.groupBy("job").applyInPandas(each, "left_id long, right_id long, jaccard double"), members


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with only the smallest doc_id of each connected group of near_duplicates(), and with all rows of no group.

    Rows of null doc_id, of null, empty and wordless texts stay, and so do rows that equal one that stays. Rows of one doc_id
    and different texts are judged each for itself. All columns stay as they are, whatever their names.
    """
    row = fresh(docs, "row_id")
    gone = _by_row(docs, **options).filter("doc_id <> class_id").select(F.col("row_id").alias(row)).distinct()
    tagged = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return tagged.join(gone, row, "left_anti").drop(row)

"""Quality rules: an isolation forest over rule statistics of each document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.labelled import cut_rows, largest
from tesserae.llm.shared import drop, written
from tesserae.llm.text import U, mix, ngrams, pieces, within, words
from tesserae.llm.toxicity import cut

TREES, SUBSAMPLE = 100, 256
RULES = ("word_bytes", "upper", "symbol", "bar", "word_repeat", "trigram_repeat", "short_words")
_DOUBLES = ", ".join(f"{r} double" for r in RULES)
SCHEMA = f"doc_id long, anomaly double, keep boolean, {_DOUBLES}"
#: Ratios of a short text vary by chance alone; they are drawn to an ordinary value as if by so many more words or bytes.
PRIOR_WORDS, PRIOR_BYTES = 30, 200
_UPPER, _SYMBOL = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_UPPER[65:91] = 1
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _SYMBOL[_c] = 1


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return cum[off[1:]] - cum[off[:-1]]


def _distinct(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    end = np.cumsum(count)
    return np.array([len(np.unique(h[e - c : e])) for e, c in zip(end, count)], np.int64)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, rules). A row without words has zeros."""
    h, s, e, woff = words(data, off)
    n = np.diff(woff)
    size = np.diff(off)
    at, tri = within(woff, 3, len(h))
    grams = ngrams(h, 3)[at] if len(at) else np.zeros(0, U)
    out = np.stack(
        [
            (_sums(e - s, woff) + 5.5 * PRIOR_WORDS) / (n + PRIOR_WORDS),
            (_sums(_UPPER[data], off) + 0.02 * PRIOR_BYTES) / (size + PRIOR_BYTES),
            _sums(_SYMBOL[data], off) / (size + PRIOR_BYTES),
            _sums(data == 124, off) / (n + PRIOR_WORDS),
            1 - np.log1p(_distinct(h, n)) / np.maximum(np.log1p(n), 1e-9),
            1 - (_distinct(grams, tri) + PRIOR_WORDS) / (tri + PRIOR_WORDS),
            (_sums((e - s) <= 3, woff) + 0.4 * PRIOR_WORDS) / (n + PRIOR_WORDS),
        ],
        axis=1,
    )
    out[n == 0] = 0
    return out


@dataclass
class Forest:
    feature: np.ndarray  # (trees, nodes), -1 at a leaf
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # of a leaf: depth, and the mean path that its rows would still take
    subsample: int
    threshold: float = 0.5


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 0) -> Forest:
    rng = np.random.default_rng(seed)
    psi = min(subsample, len(x))
    return plant((x[rng.choice(len(x), psi, replace=False)] for _ in range(trees)), trees, psi, rng)


def plant(drawn: Iterable[np.ndarray], trees: int, psi: int, rng: np.random.Generator) -> Forest:
    """The forest of trees that are each grown on psi rows drawn for it."""
    deep = max(1, int(np.ceil(np.log2(max(psi, 2)))))
    most = 1 << (deep + 1)
    arrays = [np.full((trees, most), -1, np.int64), np.zeros((trees, most)), np.zeros((trees, most), np.int64), np.zeros((trees, most), np.int64), np.zeros((trees, most))]
    feature, split, left, right, length = arrays
    for t, x in enumerate(drawn):
        todo, used = [(0, np.arange(psi), 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            wide = np.flatnonzero(high > low)
            if depth == deep or len(rows) <= 1 or not len(wide):
                length[t, node] = depth + mean_path(len(rows))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            goes = x[rows, f] < at
            feature[t, node], split[t, node], left[t, node], right[t, node] = f, at, used, used + 1
            todo += [(used, rows[goes], depth + 1), (used + 1, rows[~goes], depth + 1)]
            used += 2
    return Forest(*arrays, psi)


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** (- mean path / mean path of the subsample): near 1 for what few splits part from the rest."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in range(len(forest.feature)):
        node = np.zeros(len(x), np.int64)
        while True:
            f = forest.feature[t, node]
            inner = f >= 0
            if not inner.any():
                break
            less = x[rows, np.maximum(f, 0)] < forest.split[t, node]
            node = np.where(inner, np.where(less, forest.left[t, node], forest.right[t, node]), node)
        total += forest.length[t, node]
    return np.exp2(-total / len(forest.feature) / max(float(mean_path(forest.subsample)), 1e-9))


def fit(texts: list[str], good: np.ndarray, seed: int = 0) -> Forest:
    """The forest is grown on all of these documents; the threshold is the anomaly that best parts good from poor ones."""
    x = np.concatenate([statistics(d, o) for _, _, d, o in pieces(pa.array(texts, pa.string()))]) if len(texts) else np.zeros((1, len(RULES)))
    forest = grow(x, seed=seed)
    poor = 1 - np.asarray(good).astype(int)
    forest.threshold = cut(anomaly(forest, x), poor) if len(texts) and 0 < poor.sum() < len(poor) else (2.0 if not poor.sum() else -1.0)
    return forest


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, key and the rule statistics) of each row; the key is null where the text is. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(2)):
                columns = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(c)) for c in statistics(data, off).T]], ["doc_id", "key", *RULES])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.selectExpr("doc_id", "if(text is null, null, xxhash64(doc_id, text)) key", "text").mapInArrow(run, f"doc_id long, key long, {_DOUBLES}")


def _rules(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(r).to_numpy() for r in RULES], axis=1)


def ranks(key: np.ndarray, trees: int, seed: int = 0) -> np.ndarray:
    """(rows, trees): numbers that put the rows into another order for each tree; equal keys, equal numbers."""
    return mix(key.view(U)[:, None] ^ mix(np.arange(1, trees + 1, dtype=U) + U(seed << 32))).view(np.int64)


def smallest(tree: np.ndarray, rank: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each tree the rows of its `most` smallest ranks, equal ranks once, in order of tree and rank."""
    order = np.lexsort((rank, tree))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(tree[order]) != 0) | (np.diff(rank[order]) != 0)
    order = order[new]
    of = tree[order]
    order = order[np.arange(len(of)) - np.searchsorted(of, of) < most]
    return tree[order], rank[order], x[order]


def draw(stats: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 0) -> list[np.ndarray]:
    """For each tree, the statistics of `subsample` rows drawn from all of measured(), or all if they are fewer.

    Each tree ranks all rows in an order of its own and takes the first; rows of equal doc_id and text are one, and null texts
    none. The draws don't depend on partitions. The driver gets trees * subsample rows, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rank, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(RULES)))
        bound = np.full(trees, np.iinfo(np.int64).max)
        for batch in batches:
            key, rules = batch.column("key").to_numpy(), _rules(batch)
            for lo in range(0, len(key), 2048):
                r = ranks(key[lo : lo + 2048], trees, seed)
                row, of = np.nonzero(r <= bound)
                tree, rank, x = smallest(np.concatenate([tree, of]), np.concatenate([rank, r[row, of]]), np.concatenate([x, rules[lo + row]]), subsample)
                count = np.bincount(tree, minlength=trees)
                bound[count == subsample] = rank[np.cumsum(count) - 1][count == subsample]
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(rank), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], ["tree", "rank", *RULES])

    firsts = stats.filter("key is not null").select("key", *RULES).mapInArrow(run, f"tree int, rank long, {_DOUBLES}")
    place = F.dense_rank().over(Window.partitionBy("tree").orderBy("rank"))
    rows = firsts.withColumn("place", place).filter(F.col("place") <= subsample).dropDuplicates(["tree", "rank"]).toPandas()
    tree, _, x = smallest(rows["tree"].to_numpy(np.int64), rows["rank"].to_numpy(np.int64), rows[list(RULES)].to_numpy(float), subsample)
    return np.split(x, np.searchsorted(tree, np.arange(1, trees))) if len(x) else [np.zeros((1, len(RULES)))] * trees


def fit_measured(stats: DataFrame, labels: DataFrame, seed: int = 0) -> Forest:
    """The forest is grown on draws from all rows of measured(); the threshold is the anomaly that best parts all labelled rows.

    Every row whose doc_id has a label counts, rows of equal doc_id and text once; null doc_ids, texts and labels don't.
    """
    drawn = draw(stats, seed=seed)
    forest = plant(drawn, len(drawn), len(drawn[0]), np.random.default_rng(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(anomaly(forest, _rules(batch))), batch.column("poor")], ["score", "y"])

    known = stats.filter("key is not null").join(largest(labels, "quality"), "doc_id").dropDuplicates(["doc_id", "key"])
    forest.threshold = cut_rows(known.selectExpr("1 - y poor", *RULES).mapInArrow(run, "score double, y int"), none=2.0, every=-1.0)
    return forest


def fit_tables(docs: DataFrame, labels: DataFrame) -> Forest:
    stats = written(measured(docs), "statistics")
    forest = fit_measured(stats, labels)
    drop(stats)
    return forest


def judge_measured(stats: DataFrame, forest: Forest) -> DataFrame:
    """judge(), from the rows of measured()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rules(batch)
            score = np.where(x[:, 0] > 0, anomaly(forest, x), 1.0)
            keep = (score < forest.threshold) & (x[:, 0] > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(keep), *[batch.column(r) for r in RULES]], ["doc_id", "anomaly", "keep", *RULES])

    return stats.mapInArrow(run, SCHEMA)


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, anomaly, keep and the rule statistics) of each row; keep where anomaly is below the calibrated threshold.

    A text that is null, empty or without words has statistics 0, anomaly 1 and isn't kept. A null doc_id stays null;
    repeated rows are answered alike; other columns are ignored. No shuffle. Without labels of both classes, all or none
    is kept, as the labels have it; without labels at all, all.
    """
    return judge_measured(measured(docs), forest)


def fit_judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge(docs, fit_tables(docs, labels)), with the statistics of each text computed once."""
    stats = written(measured(docs), "statistics")
    return judge_measured(stats, fit_measured(stats, labels))

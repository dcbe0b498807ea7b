"""Toxicity: character n-gram embeddings averaged into a linear softmax, trained together, read window by window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.labelled import sample
from tesserae.llm.text import _SPACE_PUNCT, U, folded, mix, pieces, powers, trim

BUCKETS, DIM, SIZES, WINDOW, PER_CLASS = 1 << 18, 16, (3, 4, 5, 6), 2, 2000
SCHEMA = "doc_id long, score double, toxic boolean"


@dataclass
class Model:
    scalar: np.ndarray  # of each bucket: its embedding's part in the difference of the two logits
    bias: float
    threshold: float = 0.5
    window: int = WINDOW


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with one blank before, between and after rows, words' starts and ends in them, first word of each row."""
    plain = folded(data)
    plain[_SPACE_PUNCT[data]] = 32
    out = np.full(len(data) + len(off), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(off)), np.diff(off))] = plain
    inside = out != 32
    s = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    e = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return out, s, e, np.searchsorted(s, off + np.arange(len(off)))


def grams(out: np.ndarray) -> dict[int, np.ndarray]:
    """Bucket of the n bytes from each position, for each n of SIZES."""
    a = out.astype(np.uint32)
    h = a * np.uint32(0x01000193)
    found = {}
    for n in range(2, max(SIZES) + 1):
        h = (h[:-1] ^ a[n - 1 :]) * np.uint32(0x01000193)
        if n in SIZES:
            x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            found[n] = (x >> np.uint32(14)).view(np.int32)
    return found


def whole(out: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Bucket of each whole word."""
    size = e - s
    at = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(at, size)
    value = out[np.repeat(s, size) + rel].astype(U) * powers(int(size.max()) if len(size) else 1)[rel]
    return (mix(np.add.reduceat(value, at)) & U(BUCKETS - 1)).astype(np.int32) if len(size) else np.zeros(0, np.int32)


def word_sums(out: np.ndarray, s: np.ndarray, e: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the scalars of each word and its n-grams, edges of the word included, and their number."""
    total, number = scalar[whole(out, s, e)].astype(float), np.ones(len(s), np.int64)
    for n, g in grams(out).items():
        cum = np.zeros(len(g) + 1)
        np.cumsum(scalar[g], dtype=float, out=cum[1:])
        to = np.minimum(np.maximum(e - n + 2, s - 1), len(g))
        total += cum[to] - cum[np.minimum(s - 1, len(g))]
        number += np.maximum(to - (s - 1), 0)
    return total, number


def window_logits(total: np.ndarray, number: np.ndarray, woff: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean scalar of the `width` words from each word on, not past the row's end."""
    row_end = np.repeat(woff[1:], np.diff(woff))
    to = np.minimum(np.arange(len(total)) + width, row_end)
    a, b = np.concatenate([[0.0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(number)])
    at = np.arange(len(total))
    return (a[to] - a[at]) / np.maximum(b[to] - b[at], 1), to


def scores(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each row, the largest probability of its windows; 0 where it has no word."""
    out, s, e, woff = padded(data, off)
    best = np.zeros(len(off) - 1)
    if len(s):
        total, number = word_sums(out, s, e, model.scalar)
        # Single words and windows of `width` words are both read: a phrase counts by its window, a word by itself.
        logit = np.maximum(window_logits(total, number, woff, 1)[0], window_logits(total, number, woff, model.window)[0])
        full = np.flatnonzero(np.diff(woff))
        best[full] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logit, woff[full]) + model.bias, -50, 50)))
    return best


def _bags(out: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    g, word = grams(out), whole(out, s, e)
    bags = []
    for a, b in zip(first, last):
        ids = [g[n][s[w] - 1 : max(e[w] - n + 2, s[w] - 1)] for w in range(a, b) for n in SIZES]
        bags.append(np.concatenate([word[a:b], *ids]))
    return bags


def fit(texts: list[str], y: np.ndarray, rounds: int = 3, epochs: int = 4, seed: int = 0, draws: tuple[int, int, int] = (2, 6, 10)) -> Model:
    """The model, from whole documents and their labels.

    A toxic document has some toxic windows, a clean one none. Windows are chosen by document frequencies of their n-grams
    at first and by the model of the round before after that: the likeliest of each toxic document are taken as toxic,
    the likeliest and some others of each clean one as clean (draws: how many of each of these). Embeddings and softmax are then trained together by Adagrad.
    A fifth of the documents is held out of training; the threshold is the middle of the best cut on all of them.
    """
    y = np.asarray(y).astype(int)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(BUCKETS, np.float32), 0.0)
    if not len(texts) or y.min() == y.max():
        model.threshold = 1.1 if not len(texts) or y.max() == 0 else -0.1
        return model
    rows = []
    df = np.zeros((2, BUCKETS), np.float32)
    for lo, hi, data, off in pieces(pa.array(texts, pa.string())):
        out, s, e, woff = padded(data, off)
        rows.append((lo, hi, out, s, e, woff))
        g, word = grams(out), whole(out, s, e)
        for r in range(lo, hi):
            a, b = off[r - lo] + r - lo, off[r - lo + 1] + r - lo + 1
            df[y[r], np.unique(np.concatenate([word[woff[r - lo] : woff[r - lo + 1]], *[v[a:b] for v in g.values()]]))] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    guide = np.log((df[1] + 0.1) / (n1 + 0.2)) - np.log((df[0] + 0.5) / (n0 + 1))
    guide = (np.maximum(guide, 0) * np.sqrt(df[1] / n1)).astype(np.float32)
    hold = rng.random(len(y)) < 0.2
    weights = guide
    for _ in range(rounds):
        bags, target = [], []
        for lo, hi, out, s, e, woff in rows:
            total, number = word_sums(out, s, e, weights)
            for width in (1, WINDOW):
                logit, to = window_logits(total, number, woff, width)
                first, cls = [], []
                for r in range(lo, hi):
                    a, b = woff[r - lo], woff[r - lo + 1]
                    if a == b or hold[r]:
                        continue
                    top = a + np.argsort(-logit[a:b], kind="stable")[: draws[0] if y[r] else draws[1]]
                    if not y[r]:
                        top = np.concatenate([top, rng.integers(a, b, draws[2])])
                    first.append(top)
                    cls.append(np.full(len(top), y[r]))
                if first:
                    first = np.concatenate(first)
                    bags += _bags(out, s, e, first, to[first])
                    target += np.concatenate(cls).tolist()
        embed, bias, soft = _train(bags, np.array(target), epochs, rng)
        weights = (embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        model = Model(weights, float(bias[1] - bias[0]))
    got = np.concatenate([scores(model, data, off) for _, _, data, off in pieces(pa.array(texts, pa.string()))])
    model.threshold = cut(got, y)
    return model


def _train(bags: list[np.ndarray], y: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.3, decay: float = 1e-4):
    used, local = np.unique(np.concatenate(bags), return_inverse=True)
    size = np.array([len(b) for b in bags])
    begin = np.cumsum(size) - size
    embed = (rng.random((len(used), DIM)) - 0.5) / DIM
    soft = (rng.random((DIM, 2)) - 0.5) / DIM * 4
    bias = np.zeros(2)
    ge, gs, gb = np.full((len(used), 1), 1e-4), 1e-4, 1e-4
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 256):
            pick = order[k : k + 256]
            n = size[pick]
            start = np.cumsum(n) - n
            ids = local[np.arange(n.sum()) + np.repeat(begin[pick] - start, n)]
            mean = np.add.reduceat(embed[ids], start) / n[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None]
            d_mean = (p @ soft.T) / n[:, None]
            uniq, inv = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(uniq), DIM))
            np.add.at(grad, inv, np.repeat(d_mean, n, axis=0))
            grad += decay * embed[uniq]
            ge[uniq] += (grad**2).mean(1, keepdims=True)
            embed[uniq] -= rate * grad / np.sqrt(ge[uniq])
            d_soft, d_bias = mean.T @ p / len(pick) + decay * soft, p.mean(0)
            gs += (d_soft**2).mean()
            gb += (d_bias**2).mean()
            soft -= rate * d_soft / np.sqrt(gs)
            bias -= rate * d_bias / np.sqrt(gb)
    full = np.zeros((BUCKETS, DIM))
    full[used] = embed
    return full, bias, soft


def cut(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the gap that it falls into."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    last = np.append(s[1:] < s[:-1], True)
    best = np.flatnonzero(last & (f1 >= f1[last].max() - 1e-12))[0]
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0)) / 2)


def fit_tables(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = sample(docs, labels, "toxic", per_class)
    return fit(rows["text"].tolist(), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) of each row; score is the largest probability among the windows of the whole text.

    Null, empty or wordless texts score 0 and aren't toxic. A null doc_id stays null; repeated rows are answered alike;
    other columns are ignored. No shuffle. A model from labels of one class only says that class of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.concatenate([scores(model, data, off) for _, _, data, off in pieces(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= model.threshold) & (got > 0))], ["doc_id", "score", "toxic"])
        trim()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose text is toxic, all columns as they are, whatever their names; decided row by row, so that no
    doc_id is needed. Null, empty and wordless texts stay; repeated rows go or stay together; long texts are read whole; an
    empty table stays empty. No shuffle."""
    columns = docs.columns
    ordered = docs.select("text", *[c for c in columns if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.concatenate([scores(model, data, off) for _, _, data, off in pieces(batch.column(0))])
            yield batch.filter(pa.array(~((got >= model.threshold) & (got > 0))))
        trim()

    return ordered.mapInArrow(run, ordered.schema).select(*[F.col(f"`{c}`") for c in columns])

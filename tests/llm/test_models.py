"""The trained operators against enumeration, finite differences, plain loops and held-out rows."""

import random
from itertools import combinations, product
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tesserae.llm import packing, pii, quality, token_binary
from tesserae.llm.text import pieces

SF = Path("/root/testdata/sf0.1")


# --- personal data ---


def segmentations(spans):
    """All sets of spans that don't overlap, as index tuples."""
    order = sorted(range(len(spans)), key=lambda k: spans[k][0])

    def grow(k, end):
        if k == len(order):
            yield ()
            return
        yield from grow(k + 1, end)
        i, j, _, _ = spans[order[k]]
        if i >= end:
            for rest in grow(k + 1, j):
                yield (order[k], *rest)

    return grow(0, 0)


SHORT = ["id 12-34 or 5", "a@b.co 77", "x=1 y=2", "key: ab 3.1", "+1 22 33"]


@pytest.mark.parametrize("text", SHORT)
def test_decoding_equals_enumeration(text):
    rng = np.random.default_rng(len(text))
    n, spans = pii.candidates(text, 0, len(text))
    assert 0 < len(spans) <= 60
    x = np.stack([pii.features(text, a, e) for _, _, a, e in spans])
    for _ in range(5):
        model = pii.Model(rng.normal(size=(len(pii.TYPES), len(pii.FEATURES))))
        best = (x @ model.weights.T).max(1)
        want = max(sum(best[k] for k in s) for s in segmentations(spans))
        at = {(a, e): k for k, (_, _, a, e) in enumerate(spans)}
        got = pii.decode(model, text, 0, len(text))
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        assert sum((x[at[a, e]] @ model.weights.T)[pii.TYPES.index(kind)] for kind, a, e in got) == pytest.approx(want)


@pytest.mark.parametrize("text", SHORT[:3])
def test_likelihood_equals_enumeration_and_gradient_equals_differences(text):
    rng = np.random.default_rng(2)
    n, spans = pii.candidates(text, 0, len(text))
    x = np.stack([pii.features(text, a, e) for _, _, a, e in spans])
    w = rng.normal(size=(len(pii.TYPES), len(pii.FEATURES))) * 0.3
    gold = [(0, 2)]
    value, gain = pii.loglik(w, n, spans, x, gold)
    total = np.logaddexp.reduce(x @ w.T, axis=1)
    z = np.logaddexp.reduce([sum(total[k] for k in s) for s in segmentations(spans)])
    assert value == pytest.approx((x @ w.T)[0, 2] - z)
    for _ in range(20):
        i, j = rng.integers(len(pii.TYPES)), rng.integers(len(pii.FEATURES))
        step = np.zeros_like(w)
        step[i, j] = 1e-5
        slope = (pii.loglik(w + step, n, spans, x, gold)[0] - pii.loglik(w - step, n, spans, x, gold)[0]) / 2e-5
        assert gain[i, j] == pytest.approx(slope, abs=1e-5)


def test_personal_data_held_out():
    """On sentences made with another seed: of the entities, and of what is found, the share that is exactly right."""
    rng, model = random.Random(991), pii.trained()
    right = wanted = found = 0
    for _ in range(400):
        text, entities = pii._example(rng)
        got = pii.find(model, text)
        right, wanted, found = right + len(set(got) & set(entities)), wanted + len(entities), found + len(got)
    assert right / wanted >= 0.95 and right / found >= 0.95


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a.b@c.example.org now", 26, "p", "q"), (1, "mail a.b@c.example.org now", 26, "p", "q"), (None, None, None, None, None), (2, "", 0, "p", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, new_text string, entities string")
    got = pii.redact(docs).collect()
    assert [tuple(r) for r in got] == [(1, "mail [EMAIL] now", 16, "p", "q")] * 2 + rows[2:]
    assert pii.redact(docs.limit(0)).count() == 0


# --- quality ---


def test_statistics_equal_plain_counts():
    texts = ["Alpha beta | beta GAMMA! the the the", "", " \n ", "one", "a b c a b c a b c"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), off)
    for t, row in zip(texts, got):
        w = t.split()
        if not w:
            assert not row.any()
            continue
        tri = list(zip(w, w[1:], w[2:]))
        want = [
            (sum(map(len, w)) + 5.5 * 30) / (len(w) + 30),
            (sum(c.isupper() for c in t) + 0.02 * 200) / (len(t) + 200),
            sum(c in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~" for c in t) / (len(t) + 200),
            t.count("|") / (len(w) + 30),
            1 - np.log1p(len(set(w))) / np.log1p(len(w)),
            1 - (len(set(tri)) + 30) / (len(tri) + 30),
            (sum(len(x) <= 3 for x in w) + 0.4 * 30) / (len(w) + 30),
        ]
        assert row == pytest.approx(want)


def test_anomaly_equals_walks_down_the_trees():
    x = np.random.default_rng(3).normal(size=(200, 4))
    forest = quality.grow(x, trees=10, subsample=64)
    got = quality.anomaly(forest, x)
    for row, score in zip(x[:40], got):
        total = 0.0
        for t in range(10):
            node = 0
            while forest.feature[t, node] >= 0:
                node = forest.left[t, node] if row[forest.feature[t, node]] < forest.split[t, node] else forest.right[t, node]
            total += forest.length[t, node]
        harmonic = np.log(63) + 0.5772156649015329
        assert score == pytest.approx(2 ** (-(total / 10) / (2 * harmonic - 2 * 63 / 64)))


def test_quality_held_out():
    docs, labels = (pd.read_parquet(SF / f"{n}.parquet") for n in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id").dropna(subset=["text"])
    train = rows["doc_id"] % 3 > 0
    forest = quality.fit(rows.loc[train, "text"].tolist(), rows.loc[train, "quality"].to_numpy())
    held = rows[~train]
    x = np.concatenate([quality.statistics(data, off) for _, _, data, off in pieces(pa.array(held["text"].tolist(), pa.string()))])
    poor = quality.anomaly(forest, x) >= forest.threshold
    y = held["quality"].to_numpy() == 0
    assert poor[y].mean() >= 0.95 and poor[~y].mean() <= 0.01


# --- Huffman ---


def test_code_lengths_are_optimal():
    """Against all codes that fit: no length-limited prefix code has fewer bits."""
    rng = np.random.default_rng(4)
    for n, longest in product((2, 3, 4, 5), (3, 4)):
        counts = rng.integers(1, 50, n) ** 2
        got = token_binary.code_lengths(counts, longest)
        best = min(int(counts @ np.array(code)) for code in product(range(1, longest + 1), repeat=n) if sum(2.0**-k for k in code) <= 1)
        assert int(counts @ got) == best and got.max() <= longest


def test_too_long_codes_are_refused(spark):
    with pytest.raises(ValueError):
        token_binary.write_binary(spark.createDataFrame([], "doc_id long, text string"), longest=18)


# --- packing ---


def test_equal_rows_are_spread_over_shards(spark):
    """Without ids and of one length, a third of all rows; every word once, and no shard has many more than its share."""
    docs = spark.createDataFrame([(None, "w " * 7)] * 3000 + [(k, "w " * (1 + k % 50)) for k in range(6000)], "doc_id long, text string")
    windows = packing.pack(docs, capacity=100, shard_docs=256).collect()
    segments = [s for w in windows for s in w.segments]
    assert all(w.n_words == sum(s.n_words for s in w.segments) <= 100 for w in windows)
    assert len(segments) == 9000 and sum(s.doc_id is None and s.n_words == 7 for s in segments) == 3000
    per_shard = {}
    for w in windows:
        per_shard[w.shard] = per_shard.get(w.shard, 0) + len(w.segments)
    assert len(per_shard) >= 30 and max(per_shard.values()) <= 1024


def test_differencing_equals_best_split_of_few():
    """Of two sets, differencing is close to the best split and never worse than the largest item demands; ties don't matter."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        sizes = rng.integers(1, 20, 8)
        _, sums = packing.differencing(sizes, 2)
        best = min(abs(int(sizes.sum()) - 2 * int(sizes[list(c)].sum())) for k in range(9) for c in combinations(range(8), k))
        assert best <= abs(int(sums[0] - sums[1])) <= best + sizes.max()
    of, sums = packing.differencing(np.full(9, 5), 3)
    assert sums.tolist() == [15, 15, 15] and np.bincount(of).tolist() == [3, 3, 3]

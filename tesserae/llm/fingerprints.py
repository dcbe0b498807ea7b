"""Order MinHash fingerprints: alike for documents that are close in edit distance, order included."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.text import U, mix, pieces, shingles, words

K, ELL, SIGNATURES = 3, 2, 16
SCHEMA = "doc_id long, signature array<long>"


def seeds(m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def numbered(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each row's k-mers hashed with their occurrence number in the row: 0 for the first of its kind, then 1 and so on."""
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((x, row))
    xs, rs = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (xs[1:] != xs[:-1]) | (rs[1:] != rs[:-1])
    start = np.flatnonzero(new)
    number = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    out = np.empty(len(x), U)
    out[order] = mix(xs + number.astype(U) * U(0xA0761D6478BD642F))
    return out


def signatures(x: np.ndarray, count: np.ndarray, m: int, ell: int) -> np.ndarray:
    """(rows with k-mers, m) signatures. x: numbered k-mers, row after row; count: of each row, none 0."""
    start = np.cumsum(count) - count
    out = np.empty((len(count), m), U)
    big = U(0xFFFFFFFFFFFFFFFF)
    index = np.arange(len(x))
    for j, seed in enumerate(seeds(m)):
        h = mix(x ^ seed)
        chosen = np.empty((len(count), ell), np.int64)
        for r in range(ell):
            low = np.minimum.reduceat(h, start)
            hit = np.flatnonzero(h == np.repeat(low, count))
            rows = np.searchsorted(start, hit, "right") - 1
            first = np.ones(len(hit), bool)
            first[1:] = rows[1:] != rows[:-1]
            chosen[:, r] = index[hit[first]]
            h[chosen[:, r]] = big
        chosen.sort(axis=1)  # text order
        value = np.full(len(count), seed, U)
        for r in range(ell):
            # A row of fewer than ell k-mers repeats one of them; the first of such a pair counts alone.
            again = r > 0 and chosen[:, r] == chosen[:, r - 1]
            value = np.where(again, value, mix(value * U(0x9E3779B97F4A7C15) + x[chosen[:, r]]))
        out[:, j] = value
    return out


def fingerprint(docs: DataFrame, k: int = K, ell: int = ELL, m: int = SIGNATURES) -> DataFrame:
    """doc_id and a signature of m hashes for each row.

    Two documents agree in a component about as often as their weighted, ordered k-mer sets are alike: for each of m hash
    functions the ell smallest occurrence-numbered k-mers, taken in text order, are hashed as a tuple. k-mers are of k
    words without regard to case and punctuation; a text of fewer words has one k-mer, of all its words.

    Each row is answered by itself, repeated rows alike. Null, empty or wordless text: signature null. A null doc_id
    stays null. Other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(1)):
                h, _, _, woff = words(data, off, fold=True)
                x, count = shingles(h, woff, k)
                full = count > 0
                flat = signatures(numbered(x, count[full]), count[full], m, ell).view(np.int64).ravel() if full.any() else np.zeros(0, np.int64)
                offsets = np.zeros(hi - lo + 1, np.int32)
                offsets[1:] = np.cumsum(full * m)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~full))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "signature"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)

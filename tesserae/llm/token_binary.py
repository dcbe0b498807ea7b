"""Token ids as binary: canonical Huffman codes of bounded length from global counts, in blocks that decode by themselves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.bpe import PIECE, RANKS, TOKENIZERS, compile_lexicon, encode, load, load_ranks
from tesserae.llm.shared import put_file, written
from tesserae.llm.text import U, buffers, pieces

LONGEST, STEP = 16, 256
SCHEMA = "kind string, doc_id long, n_ids int, payload binary, checkpoints array<int>"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `longest` bits, by package-merge; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n, now = len(leaves), leaves
    levels = [np.ones(n, bool)]
    for _ in range(longest - 1):
        m = len(now) // 2
        both = np.concatenate([leaves, now[0 : 2 * m : 2] + now[1 : 2 * m : 2]])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        now = both[at]
    need = 2 * n - 2
    length = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        a = int(is_leaf[:need].sum())
        length[:a] += 1
        need = 2 * (need - a)
    out[order] = length
    return out


@dataclass
class Code:
    length: np.ndarray
    code: np.ndarray
    symbols: np.ndarray  # of every value of the next `longest` bits
    longest: int


def canonical(length: np.ndarray) -> Code:
    """The code that these lengths alone determine: shorter codes first, equal ones in order of id."""
    longest = max(1, int(length.max(initial=0)))
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    n = length[order].astype(np.int64)
    span = np.int64(1) << (longest - n)
    begin = np.cumsum(span) - span
    code = np.zeros(len(length), np.int64)
    code[order] = begin >> (longest - n)
    symbols = np.zeros(1 << longest, np.int64)
    filled = np.repeat(order, span)
    symbols[: len(filled)] = filled
    return Code(length.astype(np.int64), code, symbols, longest)


def encode_blocks(code: Code, ids: np.ndarray, count: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all blocks, byte offsets of the blocks, checkpoints (bit in the block of every step-th id) and their offsets."""
    n = code.length[ids]
    if (n == 0).any():
        raise ValueError("an id without a code")
    total = np.concatenate([[0], np.cumsum(n)])
    row = np.concatenate([[0], np.cumsum(count)])
    bits = total[row[1:]] - total[row[:-1]]
    size = -(-bits // 8)
    off = np.concatenate([[0], np.cumsum(size)])
    at = total[:-1] + np.repeat(8 * off[:-1] - total[row[:-1]], count)
    out = np.zeros(int(off[-1]) // 8 + 2, U)
    if len(ids):
        word, end = at >> 6, (at & 63) + n
        value = code.code[ids].astype(U)
        fits = end <= 64
        part = np.where(fits, value << np.maximum(64 - end, 0).astype(U), value >> np.maximum(end - 64, 0).astype(U))
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[begin]] = np.add.reduceat(part, begin)
        over = np.flatnonzero(~fits)
        out[word[over] + 1] += value[over] << (128 - end[over]).astype(U)
    marks = -(-count // step)
    moff = np.concatenate([[0], np.cumsum(marks)])
    pick = np.repeat(row[:-1], marks) + step * (np.arange(int(moff[-1])) - np.repeat(moff[:-1], marks))
    points = at[pick] - np.repeat(8 * off[:-1], marks) if len(ids) else np.zeros(0, np.int64)
    return out.astype(">u8").view(np.uint8)[: off[-1]], off, points.astype(np.int32), moff.astype(np.int32)


def decode_blocks(code: Code, raw: np.ndarray, off: np.ndarray, count: np.ndarray, points: np.ndarray, step: int = STEP) -> np.ndarray:
    """Ids of all blocks. Every checkpoint is a place to start from; all of them go on together, an id a round, by table."""
    marks = -(-count // step)
    row = np.repeat(np.arange(len(count)), marks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(marks) - marks, marks)
    at = points.astype(np.int64) + 8 * off[:-1][row]
    left = np.minimum(step, count[row] - nth * step)
    target = np.concatenate([[0], np.cumsum(count)])[:-1][row] + nth * step
    out = np.zeros(int(count.sum()), np.int32)
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    order = np.argsort(-left, kind="stable")
    at, left, target = at[order], left[order], target[order]
    for k in range(step):
        n = int(np.searchsorted(-left, -k, "left"))
        if not n:
            break
        p = at[:n]
        b = p >> 3
        seen = (padded[b] << 16 | padded[b + 1] << 8 | padded[b + 2]) >> (24 - code.longest - (p & 7)) & ((1 << code.longest) - 1)
        s = code.symbols[seen]
        out[target[:n] + k] = s
        at[:n] += code.length[s]
    return out


def masked(values: pa.Array, null: np.ndarray) -> pa.Array:
    return pa.array([None if z else v for z, v in zip(null, values.to_pylist())], values.type) if null.any() else values


def token_table(docs: DataFrame, tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> tuple[DataFrame, int]:
    """(doc_id, ids) of each row, ids little-endian 16-bit numbers, or 32-bit if the vocabulary needs them; and its size."""
    known = load_ranks(f"{tokenizers}/{ranks}")
    vocabulary = max(known.values()) + 1
    name = put_file(docs.sparkSession, "vocabulary", compile_lexicon(list(known), known))
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = load(SparkFiles.get(name))
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(1), PIECE):
                ids, count = encode(lex, data, off)
                raw = ids.astype(kind)
                ends = np.concatenate([[0], np.cumsum(count)]) * raw.itemsize
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                blob = masked(blob, np.asarray(batch.column(1).slice(lo, hi - lo).is_null()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), blob], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids binary"), vocabulary


def _unpacked(col: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    data, off = buffers(col)
    ids = np.frombuffer(data.tobytes(), kind)
    return ids.astype(np.int64), np.diff(off) // ids.itemsize


def write_binary(docs: DataFrame, longest: int = LONGEST, step: int = STEP, **options) -> DataFrame:
    """Token ids of every document as Huffman-coded blocks.

    The row of kind 'code' has the code lengths of all ids of the vocabulary as its payload, one byte each; canonical()
    makes the code of them. Every document has a row of kind 'block': n_ids, the packed bits, and the bit at which each
    step-th id starts, from any of which decoding can go on. Codes come from the counts over all documents; none is longer
    than `longest` bits, 17 at most, which is what the decoder's table reads at once.

    Null text: n_ids, payload and checkpoints are null; empty text: a block of no ids. A null doc_id stays null; repeated
    rows have a block each; other columns are ignored. Texts are tokenized once, into a table in the shared folder.
    """
    if not 1 <= longest <= 17:
        raise ValueError("longest must be between 1 and 17")
    tokens, vocabulary = token_table(docs, **options)
    tokens = written(tokens, "tokens")
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0), kind)[0], minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    found = tokens.select("ids").mapInArrow(tally, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts, longest)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = canonical(lengths)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, count = _unpacked(part.column(1), kind)
                raw, off, points, moff = encode_blocks(code, ids, count, step)
                m = part.num_rows
                null = np.asarray(part.column(1).is_null())
                payload = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                columns = [pa.array(["block"] * m), part.column(0), pa.array(count.astype(np.int32), mask=null), masked(payload, null), pa.ListArray.from_arrays(pa.array(moff), pa.array(points), mask=pa.array(null))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "n_ids", "payload", "checkpoints"])

    head = docs.sparkSession.createDataFrame([("code", None, None, bytearray(lengths.tobytes()), None)], SCHEMA)
    return head.unionByName(tokens.mapInArrow(pack, SCHEMA))

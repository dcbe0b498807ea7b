"""Byte-level BPE: frequent words by a minimal acyclic transducer in a memory-mapped file, all others by exact merges."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.shared import put_file
from tesserae.llm.text import U, mix, pieces, powers

TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
LEXICON, LONG, PIECE = 65536, 256, 1 << 22
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_LETTER, _NUMBER, _BLANK, _OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(text[m.start()]), ord(text[m.end() - 1])
            out[a : b + 1] = np.where((np.arange(a, b + 1) < 0xD800) | (np.arange(a, b + 1) > 0xDFFF), kind, out[a : b + 1])
    return out


_split = regex.compile(PATTERN)


def pretokens(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First byte of every piece that PATTERN parts the rows into; a row's pieces cover it without gaps."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    cp = lead.copy()
    for size, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        pick = np.flatnonzero((lead >= low) & (lead < high))
        if len(pick):
            value = lead[pick] & mask
            for k in range(1, size):
                value = (value << 6) | (data[at[pick] + k] & 0x3F)
            cp[pick] = value
    kind = _classes()[cp]
    m = len(at)
    row_first = np.searchsorted(at, off[:-1][np.diff(off) > 0])
    first = np.zeros(m + 1, bool)
    first[row_first] = True
    first[m] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run & (kind != _BLANK)
    a = np.flatnonzero(run & (kind == _BLANK))
    if len(a):
        bounds = np.append(np.flatnonzero(run), m)
        z = bounds[np.searchsorted(bounds, a, "right")]
        start[a] = True
        before_text = ~first[z]
        start[z[before_text] - 1] = True
        start[z[before_text & (cp[z - 1] == 32)]] = False
    out = at[start]
    if (data == 39).any():  # contractions: rows with an apostrophe are parted by the pattern itself
        rows = np.unique(np.searchsorted(off, np.flatnonzero(data == 39), "right") - 1)
        keep = ~np.isin(np.searchsorted(off, out, "right") - 1, rows)
        extra = []
        for r in rows:
            pos = int(off[r])
            for piece in _split.findall(data[off[r] : off[r + 1]].tobytes().decode()):
                extra.append(pos)
                pos += len(piece.encode())
        out = np.sort(np.concatenate([out[keep], np.array(extra, np.int64)]))
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank merges, the leftmost of equals, until none can."""
    parts = [word[i : i + 1] for i in range(len(word))]
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i]
        if parts[i] != x or j < 0 or parts[j] != y:
            continue
        parts[i], parts[j] = x + y, b""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for p, q in ((before[i], i), (i, after[i])):
            if p >= 0 and q >= 0 and (r := ranks.get(parts[p] + parts[q])) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[q]))
    return [ranks[p] for p in parts if p]


def automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Transitions and finality of the least automaton of the sorted, distinct words; state 0 is dead, 1 the start.

    Built word by word: the states of the last word that the next doesn't share are looked up in a register of all states
    by finality and transitions, and replaced where there is an equal one, so that suffixes are shared as prefixes are.
    """
    edges: list[dict[int, int]] = [{}, {}]
    final = [False, False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path: list[tuple[int, int, int]] = []

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            key = (final[child], tuple(edges[child].items()))
            if (known := register.get(key)) is not None:
                edges[parent][byte] = known
                edges[child] = {}
                final[child] = False
                free.append(child)
            else:
                register[key] = child

    last = b""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else 1
        for byte in w[same:]:
            if free:
                new = free.pop()
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[state][byte] = new
            path.append((state, byte, new))
            state = new
        final[state] = True
        last = w
    settle(0)
    return edges, final


def compile_lexicon(words: list[bytes], ranks: dict[bytes, int]) -> bytes:
    """The file that load() maps: the transducer, whose summed outputs number the words in sorted order, the words' ids,
    and the merge table of all pairs."""
    words = sorted({w for w in words if w})
    edges, final = automaton(words)
    size = [-1] * len(edges)

    def count(root: int) -> None:
        todo = [root]
        while todo:
            s = todo[-1]
            wait = [t for t in edges[s].values() if size[t] < 0]
            if wait:
                todo += wait
            else:
                size[s] = final[s] + sum(size[t] for t in edges[s].values())
                todo.pop()

    count(1)
    step, target, ahead = [], [], []
    for s, e in enumerate(edges):
        before = int(final[s])
        for b in sorted(e):
            step.append(s << 8 | b)
            target.append(e[b])
            ahead.append(before)
            before += size[e[b]]
    step_slots = 1 << max(8, int(np.ceil(np.log2(2 * max(1, len(step))))))
    step_keys, step_to, step_add = _hashed(np.array(step, np.int64), step_slots, np.array(target, np.int32), np.array(ahead, np.int32))
    ids = [merge_word(w, ranks) for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    slots = 1 << max(8, int(np.ceil(np.log2(8 * max(1, len(ranks))))))
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank
    keys, values = _hashed(np.fromiter(pairs, np.int64, len(pairs)), slots, np.fromiter(pairs.values(), np.int32, len(pairs)))
    byte_id = np.full(256, -1, np.int32)
    for b in range(256):
        byte_id[b] = ranks.get(bytes([b]), -1)
    by_rank = sorted(ranks, key=ranks.get)
    spell = np.zeros((max(ranks.values()) + 1 if ranks else 0) + 1, np.int64)
    for t in by_rank:
        spell[ranks[t] + 1] = len(t)
    arrays = {
        "step_keys": step_keys, "step_to": step_to, "step_add": step_add, "final": np.array(final), "offsets": offsets, "ids": np.array([x for i in ids for x in i], np.int32), "keys": keys, "values": values, "byte_id": byte_id,
        "spell": np.cumsum(spell), "bytes": np.frombuffer(b"".join(by_rank), np.uint8), "longest": np.array([max(map(len, words), default=0)]),
    }
    head, body, at = {}, [], 0
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = (str(x.dtype), x.shape, at)
        body.append(raw + b"\0" * (-len(raw) % 64))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (mix(key.astype(U)) & U(slots - 1)).astype(np.int64)


def _hashed(keys: np.ndarray, slots: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """A hash table with linear probing: keys, -1 where free, and their columns."""
    out = [np.full(slots, -1, np.int64), *(np.zeros(slots, c.dtype) for c in columns)]
    slot = _slot(keys, slots)
    left = np.arange(len(keys))
    while len(left):
        first = np.zeros(len(left), bool)
        first[np.unique(slot, return_index=True)[1]] = True
        put = first & (out[0][slot] == -1)
        for table, values in zip(out, (keys, *columns)):
            table[slot[put]] = values[left[put]]
        left, slot = left[~put], (slot[~put] + 1) & (slots - 1)
    return tuple(out)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where it isn't in the table."""
    slots = len(table)
    slot = _slot(keys, slots)
    found = table[slot]
    out = np.where(found == keys, slot, -1)
    left = np.flatnonzero((found != keys) & (found != -1))
    slot = slot[left]
    while len(left):
        slot = (slot + 1) & (slots - 1)
        found = table[slot]
        hit = found == keys[left]
        out[left[hit]] = slot[hit]
        go = ~hit & (found != -1)
        left, slot = left[go], slot[go]
    return out


@dataclass
class Lexicon:
    arrays: dict[str, np.ndarray]

    def __getattr__(self, name: str) -> np.ndarray:
        try:
            return self.__dict__["arrays"][name]
        except KeyError:
            raise AttributeError(name) from None


@lru_cache(maxsize=2)
def load(path: str) -> Lexicon:
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(n))
    raw = np.memmap(path, np.uint8, "r")
    out = {}
    for name, (kind, shape, at) in head.items():
        count = int(np.prod(shape))
        out[name] = np.frombuffer(raw, np.dtype(kind), count, 8 + n + at).reshape(shape) if count else np.zeros(shape, kind)
    return Lexicon(out)


def pair_ranks(lex: Lexicon, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of what each pair merges to; a number above all ranks where it can't."""
    slot = _find(lex.keys, a.astype(np.int64) << 32 | b)
    return np.where(slot >= 0, lex.values[slot], np.int32(1 << 30))


def merge_many(lex: Lexicon, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words (bytes one after another, none empty) and their number by word: one merge a word and round, all words at once."""
    total = len(size)
    ids, word = lex.byte_id[flat], np.repeat(np.arange(total, dtype=np.int32), size)
    rank = np.full(len(ids), 1 << 30, np.int32)  # of the pair that starts here
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = pair_ranks(lex, ids[inner], ids[inner + 1])
    done_ids, done_word = [], []
    while len(ids):
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(ids)), begin)
        going = low >> 32 < 1 << 30
        if not going.all():
            end = np.append(begin[1:], len(ids))
            stay = np.repeat(going, end - begin)
            done_ids.append(ids[~stay])
            done_word.append(word[~stay])
            shift = np.cumsum(~stay)
            at = (low[going] & 0xFFFFFFFF).astype(np.int64)
            at -= shift[at]
            ids, word, rank = ids[stay], word[stay], rank[stay]
        else:
            at = (low & 0xFFFFFFFF).astype(np.int64)
        if not len(ids):
            break
        ids[at] = rank[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        at -= np.searchsorted(np.sort(at + 1), at)
        ids, word, rank = ids[keep], word[keep], rank[keep]
        rank[at] = 1 << 30
        for p in (at[at > 0] - 1, at[at + 1 < len(ids)]):
            same = word[p] == word[p + 1]
            rank[p[~same]] = 1 << 30
            p = p[same]
            rank[p] = pair_ranks(lex, ids[p], ids[p + 1])
    ids, word = np.concatenate([*done_ids, np.zeros(0, np.int32)]), np.concatenate([*done_word, np.zeros(0, np.int32)])
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=total)


def ranks_of(lex: Lexicon) -> dict[bytes, int]:
    raw, ends = lex.bytes.tobytes(), lex.spell
    return {raw[ends[r] : ends[r + 1]]: r for r in range(len(ends) - 1) if ends[r + 1] > ends[r]}


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def _encode_words(lex: Lexicon, data: np.ndarray, s: np.ndarray, size: np.ndarray, ranks=None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each word (first byte, bytes), where its ids begin in the pool and how many there are; and the pool, in parts."""
    order = np.argsort(-size, kind="stable")
    ss, sl = s[order], size[order]
    longest = int(lex.longest[0])
    state, index = np.ones(len(s), np.int64), np.zeros(len(s), np.int64)
    m = np.searchsorted(-sl, -np.arange(longest), "left")
    for k in range(min(longest, int(sl[0]))):
        live = np.flatnonzero(state[: m[k]])
        slot = _find(lex.step_keys, state[live] << 8 | data[ss[live] + k])
        state[live] = np.where(slot >= 0, lex.step_to[slot], 0)
        index[live] += lex.step_add[slot]
    state[sl > longest] = 0
    known = lex.final[state]
    base, count = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    pick = order[known]
    base[pick] = lex.offsets[index[known]]
    count[pick] = lex.offsets[index[known] + 1] - base[pick]
    pool, more = [lex.ids], len(lex.ids)
    rest = np.sort(order[~known])
    short = rest[size[rest] <= LONG]
    if len(short):
        got, n = merge_many(lex, data[_ragged(s[short], size[short])], size[short])
        base[short], count[short] = more + np.cumsum(n) - n, n
        pool.append(got)
        more += len(got)
    for u in rest[size[rest] > LONG]:
        ranks = ranks or ranks_of(lex)
        ids = merge_word(data[s[u] : s[u] + size[u]].tobytes(), ranks)
        pool.append(np.array(ids, np.int32))
        base[u], count[u] = more, len(ids)
        more += len(ids)
    return base, count, pool


def encode(lex: Lexicon, data: np.ndarray, off: np.ndarray, ranks=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, and their number by row."""
    s = pretokens(data, off)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
    size = np.diff(np.append(s, len(data)))
    rel = np.arange(len(data)) - np.repeat(s, size)
    value = data.astype(U)
    value += U(1)
    value *= powers(int(size.max()))[rel]
    _, first, inverse = np.unique(mix(np.add.reduceat(value, s)) ^ size.astype(U), return_index=True, return_inverse=True)
    ubase, ucount, pool = _encode_words(lex, data, s[first], size[first], ranks)
    base, count = ubase[inverse], ucount[inverse]
    out = np.concatenate(pool)[_ragged(base, count)]
    row = np.searchsorted(s, off)
    total = np.concatenate([[0], np.cumsum(count)])
    return out, total[row[1:]] - total[row[:-1]]


def decode(lex: Lexicon, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and row offsets."""
    size = lex.spell[ids + 1] - lex.spell[ids] if len(ids) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    return lex.bytes[_ragged(lex.spell[ids], size)] if len(ids) else np.zeros(0, np.uint8), total[np.concatenate([[0], np.cumsum(count)])]


def _frequent(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A task's most frequent pieces. Pieces that a stretch of text holds once are passed over there: counts may be too small, never too large."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        for _, _, data, off in pieces(batch.column(0)):
            s = pretokens(data, off)
            if not len(s):
                continue
            n = np.diff(np.append(s, len(data)))
            small = n <= 32
            s, n = s[small], n[small]
            if not len(s):
                continue
            begin = np.cumsum(n) - n
            value = (data[_ragged(s, n)].astype(U) + U(1)) * powers(32)[np.arange(int(n.sum())) - np.repeat(begin, n)]
            _, first, count = np.unique(mix(np.add.reduceat(value, begin)), return_index=True, return_counts=True)
            raw = data.tobytes()
            for f, c in zip(first[count > 1].tolist(), count[count > 1].tolist()):
                w = raw[s[f] : s[f] + n[f]]
                seen[w] = seen.get(w, 0) + c
            if len(seen) > 16 * most:
                seen = dict(heapq.nlargest(8 * most, seen.items(), key=lambda x: x[1]))
    top = heapq.nlargest(most, seen.items(), key=lambda x: (x[1], x[0]))
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], ["word", "n"])


def lexicon_file(docs: DataFrame, size: int = LEXICON, tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> str:
    """Name, for SparkFiles, of a lexicon of the corpus's `size` most frequent pieces. Its choice changes speed, not ids."""
    spark: SparkSession = docs.sparkSession
    counted = docs.select("text").mapInArrow(lambda it: _frequent(it, size), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).toArrow().column("word").to_pylist()
    return put_file(spark, "lexicon", compile_lexicon([bytes(w) for w in top], load_ranks(f"{tokenizers}/{ranks}")))


def encode_documents(docs: DataFrame, lexicon: str | None = None, **options) -> DataFrame:
    """(doc_id, ids, same) of each row: the token ids of the whole text, and whether decoding them gives the text back.

    Null text: ids and same are null; empty text: no ids. A null doc_id stays null; repeated rows are answered alike;
    other columns are ignored. Encoding itself doesn't shuffle.
    """
    name = lexicon or lexicon_file(docs, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = load(SparkFiles.get(name))
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column(1), PIECE):
                ids, count = encode(lex, data, off)
                back, boff = decode(lex, ids, count)
                same = np.diff(boff) == np.diff(off)
                if len(back) == len(data) and same.all():
                    other = np.concatenate([[0], np.cumsum(back != data)])
                    same &= other[off[1:]] == other[off[:-1]]
                null = np.asarray(batch.column(1).slice(lo, hi - lo).is_null())
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(same, mask=null)], ["doc_id", "ids", "same"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, same boolean")


def decode_documents(encoded: DataFrame, lexicon: str) -> DataFrame:
    """(doc_id, text) from encode_documents() and the lexicon file it used; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = load(SparkFiles.get(lexicon))
        for batch in batches:
            lists = batch.column(1)
            count = np.diff(np.asarray(lists.offsets)) * ~np.asarray(lists.is_null())
            data, off = decode(lex, np.asarray(lists.flatten()), count)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

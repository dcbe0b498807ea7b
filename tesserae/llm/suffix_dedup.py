"""Repeated passages: maximal repeats from the interval tree of an enhanced suffix array, built in parts over the cluster.

Two suffixes belong together only if they share `min_words` words, so the array falls into classes by the hash of those
words, and each class is sorted and scanned by itself. What reaches that step is thinned without loss:

1. Winnowing picks, of each run of min_words words, the k-gram that hashes lowest; equal runs pick alike. Runs that hold no
   k-gram picked twice in the corpus can't repeat.
2. Of the rest, a class whose suffixes all follow the same word has no maximal repeat (it is part of a longer one).
3. The hashes of min_words times 1.25, 1.25 ** 2, 1.25 ** 3, ... words tell how much of a suffix is common at least and at most. What a
   group has in common is sent once, and of each suffix only what lies between. Starts of one class that lie closer than
   min_words in one text (a passage running over itself) are a run; its words are sent once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import drop, fresh, with_row_id, written
from tesserae.llm.text import U, doubled, mix, ngrams, ngrams_at, pieces, words

MIN_WORDS = 50
OUT = ["passage", "kind", "n_words", "first", "last", "row_id", "doc_id", "start_word", "cut_words"]
SUFFIX = ["class", "hash", "head", "tail", "row_id", "doc_id", "pos", "left", "run", "skip", "size"]
SCHEMA = "passage long, kind string, n_words int, first long, last long, row_id long, doc_id long, start_word int, cut_words int"


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best() of x[i : i + w] for every i that has them all."""
    width, part = 1, x
    while width * 2 <= w:
        part = best(part[:-width], part[width:])
        width *= 2
    return best(part[: len(x) - w + 1], part[w - width :][: len(x) - w + 1])


def winnow(h: np.ndarray, woff: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams, k = min_words // 2, that hash lowest in some run of min_words words of one row."""
    k = min_words // 2
    w = min_words - k + 1
    if len(h) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, U)
    g = ngrams(h, k)
    low = _sliding(g, w, np.minimum)
    ok = np.zeros(len(low) + 1, np.int64)
    rows = np.flatnonzero(np.diff(woff) >= min_words)
    np.add.at(ok, woff[rows], 1)
    np.add.at(ok, woff[rows + 1] - min_words + 1, -1)
    low[np.cumsum(ok[:-1]) == 0] = 0
    edge = np.zeros(w - 1, U)
    high = _sliding(np.concatenate([edge, low, edge]), w, np.maximum)
    at = np.flatnonzero((high == g) & (high > 0))
    return at, g[at]


def _picked(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for lo, hi, data, off in pieces(batch.column(1)):
            h, _, _, woff = words(data, off)
            at, g = winnow(h, woff, min_words)
            row = np.searchsorted(woff, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[lo:hi][row]), pa.array((at - woff[row]).astype(np.int32))], ["gram", "row_id", "pos"])


def _starts(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Class and left neighbour of each position whose next min_words words hold one of the row's given k-grams."""
    k = min_words // 2
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for lo, hi, data, off in pieces(batch.column(1)):
            h, _, _, woff = words(data, off)
            seeds = batch.column(2).slice(lo, hi - lo)
            count = np.diff(np.asarray(seeds.offsets))
            row = np.repeat(np.arange(hi - lo), count)
            at = np.asarray(seeds.flatten()).astype(np.int64) + woff[row]
            cover = np.zeros(len(h) + 2, np.int64)
            np.add.at(cover, np.maximum(at - (min_words - k), woff[row]), 1)
            np.add.at(cover, np.minimum(at, woff[row + 1] - min_words) + 1, -1)
            start = np.flatnonzero(np.cumsum(cover) > 0)
            if not len(start):
                continue
            row = np.searchsorted(woff, start, "right") - 1
            left = np.where(start > woff[row], h[start - 1], mix(ids[lo:hi][row].view(U) ^ U(0x6A09E667F3BCC909)))
            columns = [ngrams(h, min_words)[start].view(np.int64), ids[lo:hi][row], (start - woff[row]).astype(np.int32), left.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["class", "row_id", "pos", "left"])


def rungs(min_words: int, levels: np.ndarray) -> np.ndarray:
    return np.ceil(min_words * 1.25 ** np.asarray(levels)).astype(np.int64)


def _ladder(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Hashes of rungs(level) words from each given position, level from 1 on, as far as the row goes.

    A start with another of its class d < min_words words on shares min_words + d words or more only with starts that have one d
    words on too, and as much less d of what follows. So only the last start of a run is followed beyond 2 * min_words - 2 words.
    """
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for lo, hi, data, off in pieces(batch.column(1)):
            h, _, _, woff = words(data, off)
            parts = doubled(h, int(np.diff(woff).max(initial=1)))
            pos = batch.column(2).slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), np.diff(np.asarray(pos.offsets)))
            at = np.asarray(pos.flatten()).astype(np.int64) + woff[row]
            own = ngrams_at(parts, at, min_words) if len(at) else np.zeros(0, U)
            order = np.lexsort((at, own))
            near = (own[order][1:] == own[order][:-1]) & (row[order][1:] == row[order][:-1]) & (np.diff(at[order]) < min_words)
            last = np.ones(len(at), bool)
            last[order[:-1][near]] = False
            level = 1
            while True:
                n = int(rungs(min_words, level))
                keep = (at + n <= woff[row + 1]) & (last | (rungs(min_words, level - 1) < 2 * min_words - 2))
                at, row, last = at[keep], row[keep], last[keep]
                if not len(at):
                    break
                columns = [ngrams_at(parts, at, n).view(np.int64), np.full(len(at), level, np.int32), ids[lo:hi][row], (at - woff[row]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "level", "row_id", "pos"])
                level += 1


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Of each given suffix, the words after those that its group has in common, as far as others can have them too; of the
    group's first suffix also the common ones. The first min_words are the class's and not sent. A blank ends every word.

    The suffixes of a run are one stretch, the tail of the first (pos = run); skip and size say where in it each one is.
    """
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for lo, hi, data, off in pieces(batch.column(2), 1 << 20):
            _, s, e, woff = words(data, off)
            size = e - s + 1
            begin = np.concatenate([[0], np.cumsum(size)])
            plain = np.full(int(begin[-1]), 32, np.uint8)
            plain[np.arange(len(plain) - len(s)) + np.repeat(np.arange(len(s)), size - 1)] = data[np.arange(len(plain) - len(s)) + np.repeat(s - (begin[:-1] - np.arange(len(s))), size - 1)]
            raw = plain.tobytes()
            wanted = batch.column(3).slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), np.diff(np.asarray(wanted.offsets)))
            flat = wanted.flatten()
            cls, pos, left, level, group = (np.asarray(flat.field(n)) for n in ("class", "pos", "left", "level", "hash"))
            lead = np.asarray(flat.field("lead").cast(pa.int8())) > 0
            at = pos + woff[row]
            mid = begin[at + rungs(min_words, level)]
            end = begin[np.minimum(at + rungs(min_words, level + 1), woff[row + 1])]
            at = begin[at + min_words]
            run, skip = np.full(len(pos), -1, np.int32), np.zeros(len(pos), np.int64)
            first, last = mid.copy(), end.copy()
            order = np.lexsort((pos, cls, row))
            near = (row[order][1:] == row[order][:-1]) & (cls[order][1:] == cls[order][:-1]) & (np.diff(pos[order]) < min_words)
            opens = np.flatnonzero(np.concatenate([[True], ~near]))
            count = np.diff(np.append(opens, len(order)))
            for a, n in zip(opens[count > 1], count[count > 1]):
                those = order[a : a + n]
                run[those], skip[those] = pos[those[0]], at[those] - at[those[0]]
                first[those] = last[those] = at[those]
                end[those] = end[those].max()
                last[those[0]] = end[those[0]]
            size = end - at
            doc = batch.column(1).slice(lo, hi - lo).take(pa.array(row))
            for a in range(0, len(at), 4096):
                b = slice(a, a + 4096)
                head = pa.array([raw[x:y] if k else None for x, y, k in zip(at[b].tolist(), mid[b].tolist(), lead[b].tolist())], pa.binary())
                tail = pa.array([raw[x:y] for x, y in zip(first[b].tolist(), last[b].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cls[b]), pa.array(group[b]), head, tail, pa.array(ids[lo:hi][row[b]]), doc.slice(a, 4096), pa.array(pos[b]), pa.array(left[b]), pa.array(run[b]), pa.array(skip[b]), pa.array(size[b])], SUFFIX)


def arranged(buffer: list[bytes], begin: list[int], size: list[int]) -> tuple[list[int], list[int]]:
    """The suffixes buffer[begin : begin + size] in order, equal ones as they are given, and the words that each has in common with
    the one before. Suffixes of one buffer are cut out only while they are compared."""
    of = lambda i: buffer[i][begin[i] : begin[i] + size[i]]

    def compared(i: int, j: int) -> int:
        a, b = of(i), of(j)
        return (a > b) - (a < b)

    at = sorted(range(len(buffer)), key=cmp_to_key(compared) if any(begin) else of)
    return at, [0] + [common(of(x), of(y)) for x, y in zip(at, at[1:])]


MANY = object()


def intervals(lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(length, first, last) of each common-prefix interval whose suffixes follow different words.

    lcp[i]: of suffixes i - 1 and i, lcp[0] unused; left[i]: the word before suffix i. One scan with a stack.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # length, first suffix, the one left neighbour or MANY
    n = len(left)
    for i in range(1, n + 1):
        now = lcp[i] if i < n else -1
        first, seen = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            seen = own if own == seen else MANY
            if seen is MANY:
                out.append((length, first, i - 1))
        if now < 0:
            break
        if stack and stack[-1][0] == now:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else MANY
        else:
            stack.append([now, first, seen])
    return out


def common(a: bytes, b: bytes) -> int:
    """Words that two suffixes share from their start; every word ends with a blank."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return a.count(b" ", 0, n)
    other = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return a.count(b" ", 0, int(other.argmax()))


def longest_and_cut(found: list[tuple[int, int, int]], order: list) -> tuple[list[int], list[int]]:
    """Of each suffix, the length of its longest repeat, and of the longest one in which it isn't the first by `order`.

    found: intervals(), inner ones before outer ones. Of an interval only its first suffix is left open for outer ones.
    """
    n = len(order)
    longest, cut = [0] * n, [0] * n
    leader: dict[int, tuple[int, int]] = {}  # start of a closed interval to its end and first suffix
    for length, a, z in found:
        best, i, open_ = None, a, []
        while i <= z:
            if i in leader and leader[i][0] <= z:
                end, one = leader[i]
                open_.append(one)
                i = end + 1
            else:
                longest[i] = length
                open_.append(i)
                i += 1
        best = min(open_, key=lambda k: order[k])
        for k in open_:
            if k != best:
                cut[k] = length
        leader[a] = (z, best)
    return longest, cut


def _scan(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of each class, which come together, and reads its repeats off the sorted array."""
    now: int | None = None
    rows: list[list] = [[] for _ in SUFFIX[1:]]

    def closed() -> Iterator[pa.RecordBatch]:
        ordered = sorted(range(len(rows[0])), key=lambda i: (rows[3][i], rows[5][i]))
        group, head, tail, row, doc, pos, left, run, skip, size = ([c[i] for i in ordered] for c in rows)
        heads = {g: h for g, h in zip(group, head) if h is not None}
        stretches = {(r, u): t for r, u, p, t in zip(row, run, pos, tail) if u == p}
        full = [stretches[r, u] if u >= 0 else heads.get(g, b"") + t for g, t, r, u in zip(group, tail, row, run)]
        at, shared = arranged(full, skip, size)
        lcp = [min_words + n for n in shared]
        found = intervals(lcp, [left[i] for i in at])
        row, doc, pos = ([c[i] for i in at] for c in (row, doc, pos))
        place = [(d is None, d or 0, r, p) for d, r, p in zip(doc, row, pos)]
        longest, cut = longest_and_cut(found, place)
        n, m = len(at), len(found)
        first = [a for _, a, _ in found]
        columns = [
            [now] * (n + m), ["occurrence"] * n + ["repeat"] * m, longest + [x for x, _, _ in found], [*range(n), *first], [*range(n), *(z for _, _, z in found)],
            row + [row[a] for a in first], doc + [doc[a] for a in first], pos + [pos[a] for a in first], cut + [0] * m,
        ]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], OUT)

    done: list[pa.RecordBatch] = []
    for batch in batches:
        cls = np.asarray(batch.column(0))
        begin = np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(cls) else []
        columns = [batch.column(i).to_pylist() for i in range(1, len(SUFFIX))]
        for a, z in zip(begin, [*begin[1:], len(cls)]):
            if now is not None and cls[a] != now:
                done += closed()
                rows = [[] for _ in SUFFIX[1:]]
            now = int(cls[a])
            for column, values in zip(rows, columns):
                column += values[a:z]
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if now is not None:
        yield from closed()


def _where(rows: DataFrame, keys: list[str], *aggregates: Column, having: str) -> DataFrame:
    """The rows of keys whose aggregates fulfil a condition. One shuffle, read twice; neither pass sorts or holds a key's rows."""
    dealt = rows.repartition(*keys)
    good = dealt.groupBy(*keys).agg(*aggregates).filter(having).select(*keys)
    return dealt.join(good.hint("shuffle_hash"), keys, "left_semi")


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """repeats() with the row_id of shared.with_row_id()."""
    spark = docs.sparkSession
    source = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).filter("text is not null")
    grams = source.select("row_id", "text").mapInArrow(lambda it: _picked(it, min_words), "gram long, row_id long, pos int")
    twice = _where(grams, ["gram"], F.count("*").alias("n"), having="n > 1")
    seeds = twice.groupBy("row_id").agg(F.collect_set("pos").alias("seeds"))
    some = written(source.join(seeds, "row_id").dropDuplicates(["row_id"]), "repeating")
    starts = some.select("row_id", "text", "seeds").mapInArrow(lambda it: _starts(it, min_words), "class long, row_id long, pos int, left long")
    kept = written(_where(starts, ["class"], F.min("left").alias("low"), F.max("left").alias("high"), having="low <> high").select("class", "row_id", "pos", "left"), "starts")
    texts = some.select("row_id", "doc_id", "text")
    asked = kept.groupBy("row_id").agg(F.collect_list("pos").alias("pos"))
    steps = texts.select("row_id", "text").join(asked, "row_id").select("row_id", "text", "pos").mapInArrow(lambda it: _ladder(it, min_words), "hash long, level int, row_id long, pos int")
    both = _where(steps, ["hash", "level"], F.count("*").alias("n"), having="n > 1").groupBy("row_id", "pos").agg(F.max(F.struct("level", "hash")).alias("top"))
    levelled = kept.join(both, ["row_id", "pos"], "left").select("class", "row_id", "pos", "left", F.coalesce("top.level", F.lit(0)).alias("level"), F.coalesce("top.hash", F.lit(0)).alias("hash"))
    levelled = written(levelled, "levelled")
    drop(kept)
    leads = levelled.filter("level > 0").groupBy("class", "level", "hash").agg(F.min(F.struct("row_id", "pos")).alias("first")).select("first.row_id", "first.pos", F.lit(True).alias("leads"))
    led = levelled.join(leads, ["row_id", "pos"], "left").withColumn("lead", F.coalesce("leads", F.lit(False)))
    wanted = led.groupBy("row_id").agg(F.collect_list(F.struct("class", "pos", "left", "level", "hash", "lead")).alias("wanted"))
    suffixes = texts.join(wanted, "row_id").select("row_id", "doc_id", "text", "wanted").mapInArrow(lambda it: _suffixes(it, min_words), "class long, hash long, head binary, tail binary, row_id long, doc_id long, pos int, left long, run int, skip long, size long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return suffixes.repartition(parts, "class").sortWithinPartitions("class").mapInArrow(lambda it: _scan(it, min_words), SCHEMA)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every maximal repeat of at least min_words words, with all its occurrences, in space that follows their number.

    Repeats that begin with the same min_words words make a passage; its occurrences are numbered in the order of what
    follows them, so that each repeat's are a range. A row of kind 'occurrence' is one of them: doc_id, start_word, its
    number (first = last), and n_words, the longest repeat that begins there. A row of kind 'repeat' is one repeat: n_words,
    the numbers first to last of its occurrences in the passage, and doc_id and start_word of the first of these.

    A repeat is maximal if its occurrences don't all follow the same word and aren't all followed by the same word; a
    text's start and end count as words of their own. Words are runs without ASCII white space, compared by 64-bit hash.
    Occurrences may overlap: a line that a text has again and again is a repeat at every start but the last ones.

    Null, empty and shorter texts have no repeat. Rows equal in doc_id (null among them) and text count as one document; rows
    of one doc_id, or of none, with different texts are documents of their own. Other columns are ignored; an empty table
    has no repeat.
    """
    return occurrences(docs, min_words).drop("row_id", "cut_words")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans (first, count), and without the white space after each run of them."""
    raw = text.encode()
    _, s, e, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    gone = np.zeros(len(s) + 1, np.int64)
    for a, n in spans:
        gone[a] += 1
        gone[min(a + n, len(s))] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    begin = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
    end = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]])) + 1
    out, at = [], 0
    for a, z in zip(begin, end):
        out.append(raw[at : s[a]])
        at = s[z] if z < len(s) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the first occurrence of each repeat, by doc_id and place, kept and the others cut out of their texts.

    Every cut word stays at its earlier place or at one earlier still. n_chars follows the text where docs has that
    column; a text of which nothing is left goes with its row; rows without repeats, null texts among them, stay as they
    are, and so do all other columns, whatever their names. Rows of one doc_id and text are cut alike; ties of doc_id go by
    a hash of the text. An empty table stays empty.
    """
    found = occurrences(docs, min_words).filter("kind = 'occurrence' and cut_words > 0")
    spans = found.groupBy("row_id").agg(F.collect_list(F.struct("start_word", F.col("cut_words").alias("n_words"))).alias("spans"))
    columns = docs.columns
    row, at, new = (fresh(docs, c) for c in ("row_id", "spans", "new_text"))
    tagged = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    joined = tagged.join(spans.select(F.col("row_id").alias(row), F.col("spans").alias(at)), row, "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or s is None else cut_words(t, [(int(x["start_word"]), int(x["n_words"])) for x in s]))

    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(cut("text", at))
    done = joined.withColumn(new, text).filter(F.col(at).isNull() | (F.trim(new) != ""))
    size = F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length(new)) if "n_chars" in columns else None
    kinds = dict(docs.dtypes)
    return done.select([F.col(new).alias(c) if c == "text" else size.cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])

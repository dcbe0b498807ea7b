"""The n-gram join against unfiltered brute force and against its SQL."""

import re
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tesserae.llm import ngram_join
from tesserae.llm.queries import OP4_SQL, op4_ngram_join

SF = Path("/root/testdata/sf0.001")


def sets_of(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def near_texts():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(40):
        base = [f"w{rng.integers(300)}" for _ in range(80)]
        out.append(" ".join(base))
        for _ in range(3):
            again = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 9)):
                again[at] = f"v{rng.integers(300)}"
            out.append(" ".join(again))
    return out


def brute(rows, threshold=0.5):
    """{(doc_id, text): (class_id, copy_of, copies, links, nearest_id, jaccard)} by comparing all pairs."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t and sets_of(t)})
    sets = [frozenset(sets_of(t)) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    near = [[] for _ in docs]
    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        value = both / (len(sets[i]) + len(sets[j]) - both)
        if value >= threshold:
            near[i].append((j, value))
            near[j].append((i, value))
            a, b = sorted((top(i), top(j)))
            up[b] = a
    groups = [top(i) for i in range(len(docs))]
    out = {}
    for i, (doc_id, text) in enumerate(docs):
        if not near[i]:
            continue
        same = [docs[j][0] for j in range(len(docs)) if sets[j] == sets[i]]
        other = sorted((-v, docs[j][0]) for j, v in near[i] if sets[j] != sets[i])
        best = (other[0][1], -other[0][0]) if other else (None, None)
        out[doc_id, text] = (min(docs[j][0] for j in range(len(docs)) if groups[j] == groups[i]), min(same), len(same), len(near[i]), *best)
    return out


def compared(spark, given, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in given], "doc_id long, text string, jaccard long")
    want = brute(given, options.get("threshold", 0.5))
    got = [tuple(r[c] for c in ("doc_id", "class_id", "copy_of", "copies", "links", "nearest_id", "jaccard")) for r in ngram_join.near_duplicates(docs, **options).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *v)) for (i, _), v in want.items())
    return docs, want


def test_tile_pairs_are_exact():
    texts = near_texts()[:60]
    sets, grams = ngram_join.text_sets(texts, 3), [sets_of(t) for t in texts]
    left = np.arange(len(texts))
    got = {(min(i, j), max(i, j)): v for i, js, vs in ngram_join.tile_pairs(sets, left, left, 0.5) for j, v in zip(js, vs)}
    want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in combinations(enumerate(grams), 2) if len(a & b) >= 0.5 * len(a | b)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_equals_brute_force(spark):
    """Copies, copies of near neighbours, edge cases, pairs at the threshold itself, and small tiles."""
    texts = near_texts()
    texts += [t for t in texts[:24] for _ in range(3)]
    rows = list(enumerate(texts)) + [(900, texts[0].upper()), (901, None), (902, ""), (903, " . "), (None, texts[0]), (5, texts[5]), (5, texts[9]), (904, "a b"), (905, "A, b!"), (906, "a"), (907, "q1 q2 q3 q4 q5"), (908, "q1 q2 q3 q4 q6"), (909, "x " * 30000)]
    compared(spark, rows, tile_size=400)


@pytest.mark.parametrize("options", [{"bands": 1, "rows": 12}, {"bands": 1, "rows": 12, "threshold": 0.7}, {"threshold": 0.3}])
def test_prefix_filter_finds_what_keys_miss(spark, options):
    """With keys that nearly never meet, so that the prefix filter has to find the pairs; few words make chance meetings, a common line makes hot n-grams."""
    rng = np.random.default_rng(8)
    line = " ".join(f"license{k}" for k in range(25))
    rows = []
    for k in range(120):
        base = [f"w{rng.integers(12)}" for _ in range(rng.integers(3, 90))]
        rows.append((k, " ".join(base) + (f" {line}" if k % 3 else "")))
        cut = sorted(rng.integers(0, len(base) + 1, 2))
        rows.append((1000 + k, " ".join(base[: cut[0]] + base[cut[1] :] + [f"z{k}"])))
    _, want = compared(spark, rows, **options)
    assert len(want) > 15


def test_class_pairs_and_members_give_all_pairs(spark):
    texts = near_texts()[:80]
    texts += texts[:10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near, members = ngram_join.class_pairs(docs, tile_size=400)
    of = {}
    for r in members.collect():
        of.setdefault(r.copy_of, []).append(r.doc_id)
    got = {tuple(sorted(p)) for r in near.collect() for p in ((a, b) for a in of[r.left_id] for b in of[r.right_id])} | {p for m in of.values() for p in combinations(sorted(m), 2)}
    grams = [sets_of(t) for t in texts]
    assert got == {(i, j) for (i, a), (j, b) in combinations(enumerate(grams), 2) if len(a & b) >= 0.5 * len(a | b)}


def test_keep_one(spark):
    texts = near_texts()[:40]
    rows = list(enumerate(texts)) + [(900, texts[0]), (901, None), (902, ""), (None, texts[0]), (3, texts[3]), (0, "a text of its own under a number that is taken")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, row_id long, Class string")
    want = brute(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if want.get((r.doc_id, r.text), (r.doc_id,))[0] == r.doc_id)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, class long")
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.keep_one(none).count() == 0
    blank = spark.createDataFrame([(1, None), (None, "a b c d"), (2, " ")], "doc_id long, text string")
    assert ngram_join.near_duplicates(blank).count() == 0 and ngram_join.keep_one(blank).count() == 3


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(OP4_SQL)
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    assert rows and sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in names)) for r in op4_ngram_join(spark, str(SF)).collect())

"""Each operator against a brute-force version, a round trip or held-out rows, and its edge cases."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import bpe, fingerprints, packing, pii, quality, suffix_dedup, token_binary, toxicity, warc
from tesserae.llm.labelled import cut_rows, sample
from tesserae.llm.queries import OP8_SQL, op8_warc
from tesserae.llm.text import pieces

SF = Path("/root/testdata/sf0.001")
#: Nulls, empties, ties, repeated rows and an extra column that clashes with the operators' own names.
ODD = [(1, "one two three", 7), (1, "one two three", 7), (None, "one two three", 7), (2, None, None), (3, "", 1), (4, "  \n ", 1), (5, "wörd " * 3000, 2), (6, "x" * 50000, 3)]
DOCS = "doc_id long, text string, {} long"


def odd(spark, clash):
    return spark.createDataFrame(ODD, DOCS.format(clash))


def none(spark, clash="n"):
    return spark.createDataFrame([], DOCS.format(clash))


def table(spark, name):
    return spark.read.parquet(str(SF / f"{name}.parquet"))


# --- packing ---


def test_packing_covers_every_word_once(spark):
    docs = odd(spark, "shard")
    windows = packing.pack(docs, capacity=100).collect()
    assert all(w.n_words == sum(s.n_words for s in w.segments) <= 100 for w in windows)
    got = Counter((s.doc_id, k) for w in windows for s in w.segments for k in range(s.start_word, s.start_word + s.n_words))
    want = Counter((i, k) for i, t, _ in ODD if t for k in range(len(t.split())))
    assert got == want
    assert packing.pack(none(spark)).count() == 0


def test_differencing():
    of, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]
    assert sorted(np.bincount(of, [8, 7, 6, 5, 4]).astype(int).tolist()) == [14, 16]
    sizes = np.random.default_rng(1).integers(1, 500, 200)
    of = packing.fill(sizes, 2048)
    loads = np.bincount(of, sizes)
    assert loads.max() <= 2048 and loads.max() - loads.min() <= 2048 // 100


# --- personal data ---


def test_pii(spark):
    found = {r.doc_id: r for r in pii.detect(spark.createDataFrame([(1, "Write to ann.lee@example.org or call +44 20 7946 0958 today."), (2, "In 2024 we sold 1250 chairs at 3.5 each."), (3, None), (4, "")], "doc_id long, text string")).collect()}
    assert [e.type for e in found[1].entities] == ["EMAIL", "PHONE"]
    assert "ann.lee" not in found[1].text and "7946" not in found[1].text
    assert found[2].entities == [] and found[2].text.startswith("In 2024")
    assert found[3].text is None and found[4].text == ""
    docs = odd(spark, "entities")
    assert [(r.doc_id, r.text) for r in pii.redact(docs).collect()] == [(i, t) for i, t, _ in ODD]
    assert pii.detect(none(spark)).count() == 0


def test_pii_takes_secrets_without_digits_and_long_ones(spark):
    rng = np.random.default_rng(6)
    of = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, hexa, url = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "abcdefghijkLMNOPQRST0123456789-_"
    secrets = ["swordfish", "correcthorse", of(low, 24), of(low, 24), of(hexa, 256), f"eyJ{of(url, 60)}x.{of(url, 200)}x.{of(url, 60)}x"]
    texts = [f"my password: {secrets[0]} is old", f"the secret: {secrets[1]} they said", f"use sk-{secrets[2]} here", f"use ghp_{secrets[3]} here", f"see token={secrets[4]} there", f"see token={secrets[5]} there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (pii.detect(docs).collect(), pii.redact(docs).collect()):
        assert [r.doc_id for r in rows if secrets[r.doc_id] in r.text or "[SECRET]" not in r.text] == []
    clean = spark.createDataFrame([(1, "Note: the monkey: a well-known animal - so they said."), (2, f"http://{of(low, 200)}")], "doc_id long, text string")
    assert all(not r.entities for r in pii.detect(clean).collect())


# --- quality ---


def test_quality_isolates_outliers_and_edges(spark):
    x = np.random.default_rng(0).normal(size=(500, 5))
    x[0] = 8
    forest = quality.grow(x)
    assert quality.anomaly(forest, x).argmax() == 0
    docs = table(spark, "documents")
    model = quality.fit_tables(docs, table(spark, "labels"))
    rows = quality.judge(odd(spark, "keep"), model).collect()
    assert [r.doc_id for r in rows] == [i for i, _, _ in ODD]
    assert all(r.anomaly == 1 and not r.keep for r in rows[3:6])
    assert rows[0].anomaly == rows[1].anomaly == rows[2].anomaly
    assert quality.judge(none(spark), model).count() == 0


def test_quality_fits_on_every_row(spark):
    """Forest and threshold against plain draws and cut() over all rows: more labelled ones than a sample of 4000 of a class had."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnop"))
    word = lambda bad: "".join(rng.choice(letters, rng.integers(2, 9))) + ("#|"[rng.integers(2)] if rng.random() < bad else "")
    poor = rng.random(6000) < 0.1
    texts = [" ".join(word(0.4 if p else 0.1) for _ in range(rng.integers(4, 30))) for p in poor]
    rows = [*enumerate(texts), *enumerate(texts[:300]), (7, "another text of a labelled document"), (None, texts[0]), (None, texts[0]), (9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = [(k, int(not poor[k])) for k in range(5000)] + [(9000, 0), (9001, 0), (None, 1), (5500, None)]
    assert sum(y == 1 for _, y in labels) > 4000
    forest = quality.fit_tables(docs, spark.createDataFrame(labels, "doc_id long, quality int"))

    one = sorted({r for r in rows if r[1] is not None}, key=repr)
    keys = {(r.doc_id, r.text): r.k for r in spark.createDataFrame(one, "doc_id long, text string").selectExpr("*", "xxhash64(doc_id, text) k").collect()}
    x = np.concatenate([quality.statistics(d, o) for _, _, d, o in pieces(pa.array([t for _, t in one], pa.string()))])
    order = np.argsort(quality.ranks(np.array([keys[r] for r in one]), quality.TREES), axis=0)[: quality.SUBSAMPLE]
    want = quality.plant((x[order[:, t]] for t in range(quality.TREES)), quality.TREES, quality.SUBSAMPLE, np.random.default_rng(0))
    for name in ("feature", "split", "left", "right", "length"):
        assert (getattr(forest, name) == getattr(want, name)).all()
    known = dict(x for x in labels if None not in x)
    at = [k for k, (i, _) in enumerate(one) if i in known]
    assert len(at) == 5002
    score, y = quality.anomaly(want, x[at]), 1 - np.array([known[one[k][0]] for k in at])
    assert forest.threshold == quality.cut(score, y)
    judged = {(r.doc_id, r.anomaly): r.keep for r in quality.fit_judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert {(one[k][0], s): bool(s < forest.threshold) for k, s in zip(at, score) if one[k][1]}.items() <= judged.items()


def test_cut_of_a_table_equals_cut(spark):
    rng = np.random.default_rng(4)
    for n, places in ((3000, 2), (3000, 6), (40, 1), (2, 3)):
        y = rng.integers(0, 2, n)
        y[:2] = 0, 1
        score = np.round(rng.random(n) * 0.7 + 0.3 * y, places)
        rows = spark.createDataFrame(list(zip(score.tolist(), y.tolist())), "score double, y int").repartition(5)
        assert cut_rows(rows, 2.0, -1.0) == quality.cut(score, y)
    for want, y in ((2.0, []), (2.0, [0, 0]), (-1.0, [1, 1])):
        assert cut_rows(spark.createDataFrame([(0.5, v) for v in y], "score double, y int"), 2.0, -1.0) == want


# --- BPE ---


def test_bpe_equals_reference_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(f"{bpe.TOKENIZERS}/{bpe.RANKS}")
    known = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in table(spark, "documents").filter("text is not null").limit(60).collect()] + [t for _, t, _ in ODD if t] + ["it's  a\t\ntest 'quoted' ½ ١٢ 漢字 😀😀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = bpe.lexicon_file(docs)
    encoded = bpe.encode_documents(docs, name)
    for r in encoded.collect():
        assert r.ids == known.encode_ordinary(texts[r.doc_id]) and r.same
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, name).collect()} == dict(enumerate(texts))
    rows = bpe.encode_documents(odd(spark, "ids"), name).collect()
    assert rows[3].ids is None and rows[3].same is None and rows[4].ids == [] and rows[0].ids == rows[1].ids
    assert bpe.encode_documents(none(spark)).count() == 0


def test_automaton_is_minimal():
    edges, final = bpe.automaton([b"tap", b"taps", b"top", b"tops"])
    live = sum(bool(e) or f for e, f in zip(edges, final))
    assert live == 5


# --- Huffman ---


def test_huffman():
    counts = np.array([2**k for k in range(30)] + [0, 5])
    length = token_binary.code_lengths(counts, 12)
    assert length.max() <= 12 and length[30] == 0
    assert sum(2.0 ** -int(n) for n in length if n) <= 1
    code = token_binary.canonical(length)
    rng = np.random.default_rng(0)
    ids = rng.choice(np.flatnonzero(counts), 5000)
    count = np.array([0, 1, 1000, 256, 0, 3743])
    raw, off, points, moff = token_binary.encode_blocks(code, ids, count)
    assert (token_binary.decode_blocks(code, raw, off, count, points) == ids).all()
    assert token_binary.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]


def test_token_binary_round_trip(spark):
    rows = token_binary.write_binary(odd(spark, "payload")).collect()
    code = token_binary.canonical(np.frombuffer(rows[0].payload, np.uint8))
    ranks = bpe.load_ranks(f"{bpe.TOKENIZERS}/{bpe.RANKS}")
    spelt = {v: k for k, v in ranks.items()}
    blocks = [r for r in rows if r.kind == "block"]
    texts = []
    for r in blocks:
        if r.payload is None:
            texts.append((r.doc_id, None))
            continue
        raw = np.frombuffer(r.payload, np.uint8)
        ids = token_binary.decode_blocks(code, raw, np.array([0, len(raw)]), np.array([r.n_ids]), np.array(r.checkpoints, np.int64))
        texts.append((r.doc_id, b"".join(spelt[int(i)] for i in ids).decode()))
    assert Counter(texts) == Counter((i, t) for i, t, _ in ODD)
    assert token_binary.write_binary(none(spark)).count() == 1


# --- toxicity ---


def test_toxicity_held_out():
    """On the largest table: the smaller ones hold out 13 toxic documents and fewer, too few to measure (recall 0.69 there)."""
    import pandas as pd

    docs, labels = (pd.read_parquet(SF.parent / "sf0.1" / f"{n}.parquet") for n in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id").dropna(subset=["text"])
    rows = rows[rows["toxic"].isin([0, 1])]
    train = rows["doc_id"] % 3 > 0
    model = toxicity.fit(rows.loc[train, "text"].tolist(), rows.loc[train, "toxic"].to_numpy())
    held = rows[~train]
    found = np.concatenate([toxicity.scores(model, data, off) for _, _, data, off in pieces(pa.array(held["text"].tolist(), pa.string()))]) >= model.threshold
    y = held["toxic"].to_numpy() == 1
    assert found[y].mean() >= 0.8 and found[~y].mean() <= 0.02


def test_toxicity_edges(spark):
    model = toxicity.fit_tables(table(spark, "documents"), table(spark, "labels"))
    assert [r.doc_id for r in toxicity.score(odd(spark, "toxic"), model).collect()] == [i for i, _, _ in ODD]
    docs = odd(spark, "score")
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {2, 3, 4} <= {r.doc_id for r in kept.collect()}
    assert toxicity.reject(none(spark), model).count() == 0


def test_labelled_sample_takes_nulls_and_repeats(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    got = sample(odd(spark, "y"), labels, "toxic", 10)
    assert got[["doc_id", "y"]].to_numpy().tolist() == [[1, 1], [5, 0]]


# --- WARC ---


def test_warc_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = con.execute(OP8_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in op8_warc(spark, str(SF)).collect())


def test_warc_cases(spark, tmp_path):
    rows = [
        (1, "http://www.a.org/x/", 10, "response", 200, {"ETag": '"1"', "Content-Length": "3", "Server": "s"}, "old"),
        (2, "https://a.org/x", 20, "response", 200, {"etag": '"2"'}, "new"),
        (3, "http://a.org/x#f", 15, "revisit", 304, {"etag": 'W/"1"', "content-length": "0", "date": "d"}, None),
        (4, "http://a.org/x", 30, "revisit", 304, {"etag": '"1"'}, None),
        (5, "http://a.org/x", 10, "revisit", 304, {"etag": '"1"'}, None),
        (6, None, 30, "revisit", 304, None, None),
        (7, "http://a.org/x", 30, "revisit", 304, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert {k: (r.outcome, r.refers_to) for k, r in got.items()} == {3: ("resolved", 1), 4: ("mismatch", 2), 5: ("no_response", None), 6: ("no_response", None), 7: ("no_validator", 2)}
    assert got[3].payload == "old" and got[3].headers == {"etag": 'W/"1"', "content-length": "3", "server": "s", "date": "d"}
    assert warc.resolve(spark.createDataFrame([], warc.RECORDS)).count() == 0
    body = b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nhello"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.org/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body))
    record = warc.read(spark, str(tmp_path)).collect()[0]
    assert (record.status, record.payload, record.headers) == (200, "hello", {"etag": "x"})


# --- fingerprints ---


def test_fingerprints(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "j i h g f e d c b a", "a a a a a", "one"]
    rows = {r.doc_id: r.signature for r in fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m=128).collect()}
    alike = lambda i, j: np.mean(np.array(rows[i]) == np.array(rows[j]))
    assert alike(0, 1) > 0.4 and alike(0, 2) == 0 and len(rows[4]) == 128
    odds = fingerprints.fingerprint(odd(spark, "signature")).collect()
    assert odds[0].signature == odds[1].signature == odds[2].signature
    assert [r.signature is None for r in odds] == [False, False, False, True, True, True, False, False]


def test_order_min_hash_equals_brute_force():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 9, n).astype(np.uint64) for n in (1, 2, 7, 40)]
    count = np.array([len(r) for r in rows])
    x = fingerprints.numbered(np.concatenate(rows), count)
    got = fingerprints.signatures(x, count, 8, 2)
    start = np.cumsum(count) - count
    for r, (a, n) in enumerate(zip(start, count)):
        own = x[a : a + n]
        assert len(set(own.tolist())) == n  # occurrence numbers part repeated k-mers
        for j, seed in enumerate(fingerprints.seeds(8)):
            low = sorted(np.argsort(fingerprints.mix(own ^ seed))[:2])
            value = np.array([seed], np.uint64)
            for k in low:
                value = fingerprints.mix(value * np.uint64(0x9E3779B97F4A7C15) + own[k : k + 1])
            assert got[r, j] == value[0]


# --- repeats ---


def brute_repeats(texts, least):
    """{words: occurrences} of all maximal repeats, overlapping ones too."""
    words = [t.split() for t in texts]
    out = {}
    stretches = {}
    for d, w in enumerate(words):
        for a in range(len(w)):
            for z in range(a + least, len(w) + 1):
                stretches.setdefault(tuple(w[a:z]), []).append((d, a))
    for s, at in stretches.items():
        if len(at) < 2:
            continue
        left = {words[d][a - 1] if a else ("start", d) for d, a in at}
        right = {words[d][a + len(s)] if a + len(s) < len(words[d]) else ("end", d) for d, a in at}
        if len(left) > 1 and len(right) > 1:
            out[s] = sorted(at)
    return out


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    word = lambda n: [f"u{x}" for x in rng.integers(0, 10**6, n)]
    shared = word(30)
    texts = [" ".join(word(4) + shared[:20] + word(6)), " ".join(word(9) + shared + word(2)), " ".join(shared[5:] + word(3)), " ".join(word(12) + shared[2:12] + word(5) + shared[15:27]), "u1 u2"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(50, None, 1), (51, "", 1), (3, texts[3], 1)], DOCS.format("passage"))
    rows = suffix_dedup.repeats(docs, 6).collect()
    spots = {(r.passage, r["first"]): (r.doc_id, r.start_word) for r in rows if r.kind == "occurrence"}
    got = {}
    for r in (r for r in rows if r.kind == "repeat"):
        at = sorted(spots[r.passage, k] for k in range(r["first"], r["last"] + 1))
        d, a = at[0]
        got[tuple(texts[d].split()[a : a + r.n_words])] = at
    assert got == brute_repeats(texts, 6)
    assert suffix_dedup.repeats(none(spark), 6).count() == 0


def found_repeats(spark, texts, least):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.repeats(docs, least).collect()
    spots = {(r.passage, r["first"]): (r.doc_id, r.start_word) for r in rows if r.kind == "occurrence"}
    out = {}
    for r in (r for r in rows if r.kind == "repeat"):
        at = sorted(spots[r.passage, k] for k in range(r["first"], r["last"] + 1))
        d, a = at[0]
        out[tuple(texts[d].split()[a : a + r.n_words])] = at
    return out


def test_repeats_of_line_runs_equal_brute_force(spark):
    """Lines shorter than least, unequally often before a shared passage, at the ends, in other phases, and one word alone."""
    line, passage = "a b c d", " ".join(f"p{k}" for k in range(30))
    runs = lambda k, n: f"{k} " + f"{line} " * n
    texts = [runs("u", 4) + passage, runs("x", 3) + passage, (runs("y", 9)).strip(), "c d " + f"{line} " * 6 + "z", "w " * 25, "v " + "w " * 14 + passage]
    assert found_repeats(spark, texts, 6) == brute_repeats(texts, 6)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a b", "a b c", "q", passage[:40]], p=[0.5, 0.3, 0.1, 0.1]) for _ in range(30)) for _ in range(6)]
    assert found_repeats(spark, texts, 6) == brute_repeats(texts, 6)


def test_remove_cuts_what_follows_line_runs(spark):
    line, passage = " ".join(f"l{k}" for k in range(20)), " ".join(f"p{k}" for k in range(1000))
    docs = spark.createDataFrame([(1, f"u {' '.join([line] * 4)} {passage}"), (2, f"x {' '.join([line] * 3)} {passage}"), (3, " ".join(f"m{k}" for k in range(20)) + " " + " ".join(["o"] * 4000))], "doc_id long, text string")
    left = {r.doc_id: r.text.split() for r in suffix_dedup.remove(docs).collect()}
    assert sum(passage in " ".join(t) for t in left.values()) == 1
    assert left[1].count("l0") <= 3 and left[2] == ["x"] and len(left[3]) <= 21 + 50


def test_intervals_test_left_extension():
    assert suffix_dedup.intervals([0, 5, 3], [1, 2, 2]) == [(5, 0, 1), (3, 0, 2)]
    assert suffix_dedup.intervals([0, 5, 3], [1, 1, 2]) == [(3, 0, 2)]


def test_remove_keeps_the_first(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"aa {passage} bb", 19), (2, f"cc {passage} dd", 19), (3, passage, 1), (4, None, 0), (None, "zz", 2)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in suffix_dedup.remove(docs, 10).collect()}
    assert got == {1: f"aa {passage} bb", 2: "cc dd", 4: None, None: "zz"}


def test_remove_keeps_columns_of_any_name(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(1, passage, 5, "s", 1, "n"), (2, f"x {passage}", 5, "s", 1, "n"), (2, f"x {passage}", 5, "s", 1, "n"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string, row_id int, new_text string")
    got = sorted((tuple(r) for r in suffix_dedup.remove(docs, 10).collect()), key=repr)
    assert got == sorted([rows[0], (2, "x ", 1 + 1, "s", 1, "n"), (2, "x ", 1 + 1, "s", 1, "n"), rows[3]], key=repr)
    assert suffix_dedup.remove(docs.limit(0), 10).count() == 0

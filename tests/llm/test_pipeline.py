"""run() on small corpora: each stage against brute force over what the one before it left, and edge cases."""

import numpy as np

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tests.llm.test_operators import brute_repeats


def test_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage = word(60)
    clean = [word(50) for _ in range(20)]
    texts = {k: t for k, t in enumerate(clean)}
    texts |= {100: clean[0], 101: clean[1] + " more", 102: f"{word(90)} {passage}", 103: f"{word(90)} {passage} {word(40)}", 104: f"{word(30)} ann@example.org", 105: None, 106: ""}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
    left = {r.doc_id: r.text for r in now.collect()}
    assert set(left) == set(texts) - {100, 101}
    assert left[102].endswith(passage) and passage not in left[103] and len(left[103].split()) == 130
    assert "ann@example.org" not in left[104] and len(left[104].split()) == 31
    assert all(left[k] == t for k, t in enumerate(clean))
    windows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = {}
    for w in windows:
        assert w.n_words <= 2048
        for s in w.segments:
            packed[s.doc_id] = packed.get(s.doc_id, 0) + s.n_words
    assert packed == {k: len(t.split()) for k, t in left.items() if t}


def test_stages_equal_brute_force(spark, tmp_path):
    """Near duplicates by all pairs, repeats by all stretches of words, personal data where it was put, windows by their words;
    with nulls, empty texts, repeated rows, ties and columns named like the operators' own."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    bases = [word(70) for _ in range(12)]
    passages = [word(52), word(55)]
    rows = [(k, " ".join(b)) for k, b in enumerate(bases)]
    rows += [(100 + k, " ".join([*b[: 20 + 4 * k], "changed", *b[21 + 4 * k :]])) for k, b in enumerate(bases[:8])]
    rows += [(200 + k, " ".join([*word(60), *passages[k % 2], *word(5 + k)])) for k in range(6)]
    rows += [(300, "call ann.lee@example.org " + " ".join(word(20))), (301, None), (302, ""), (303, " "), (None, " ".join(bases[0])), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans long, row_id string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, now):
        path = f"{tmp_path}/{name}"
        stages[name](spark, now, str(tmp_path)).write.parquet(path)
        return spark.read.parquet(path)

    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    clean = after("toxicity", docs)
    assert texts(clean) == sorted(rows, key=repr)  # no toxic label: nothing goes
    single = after("ngram_join", clean)
    linked = brute(texts(clean))
    want = [(i, t) for i, t in texts(clean) if linked.get((i, t), (i,))[0] == i]
    assert texts(single) == want and len(want) < len(rows) - 7
    cut = after("suffix_dedup", single)
    of = sorted({(i, t) for i, t in want if t and t.strip()}, key=lambda x: (x[0] is None, x[0] or 0))
    gone = {k: set() for k in range(len(of))}
    for stretch, at in brute_repeats([t for _, t in of], 50).items():
        for d, a in sorted(at)[1:]:
            gone[d] |= set(range(a, a + len(stretch)))
    left = {of[k]: " ".join(w for a, w in enumerate(of[k][1].split()) if a not in gone[k]) for k in gone}
    wanted = sorted(((i, left[i, t] if gone[of.index((i, t))] else t) if (i, t) in left else (i, t) for i, t in want if (i, t) not in left or left[i, t]), key=repr)
    assert [(i, t and " ".join(t.split()) or t) for i, t in texts(cut)] == [(i, t and " ".join(t.split()) or t) for i, t in wanted]
    safe = after("pii", cut)
    assert [t for i, t in texts(safe) if i == 300] == [t.replace("ann.lee@example.org", "[EMAIL]") for i, t in texts(cut) if i == 300]
    assert [x for x in texts(safe) if x[0] != 300] == [x for x in texts(cut) if x[0] != 300]
    assert safe.columns == docs.columns and {(r.spans, r.row_id) for r in safe.collect()} == {(7, "z")}
    words = sorted((i, len(t.split())) for i, t in texts(safe) if i is not None and t and t.split())
    packed = sorted((s.doc_id, s.n_words) for w in corpus_pipeline.run(spark, str(tmp_path)).collect() for s in w.segments if s.doc_id is not None)
    assert packed == words


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

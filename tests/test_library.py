"""The library's queries against their SQL on the smallest tables, and small cases of sources, store and tree."""

import decimal
import io
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tesserae.functions.embedders import HashEmbedder
from tesserae.operators import tree
from tesserae.plans import catalog
from tesserae.plans.errors import NotFound, ParseError
from tesserae.sources.files import extract, read_directory
from tesserae.sources.markup import html_text, rtf_text
from tesserae.sources.rows import parse_csv, row_documents
from tesserae.streaming.store import Store, latest

SF = Path("/root/testdata/sf0.001")
FAST = "sentence_split canon_key html_text bm25_stats bm25_top10 dense_top10 vector_store_upsert filter_tree_numeric rrf csv_row_documents upsert_latest corpus_counters vector_functions continuation ndcg map_mrr".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = catalog.QUERIES[name](spark, str(SF))
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(plain(tuple(r[c] for c in names))) for r in df.collect()) == sorted(repr(plain(tuple(r))) for r in found.fetchall())


def test_csv():
    names, records = parse_csv(' a ,b\r\n"x, ""y""",2\n\n3, 4\n')
    assert names == ["a", "b"]
    assert records == [(2, ['x, "y"', "2"]), (4, ["3", " 4"])]
    with pytest.raises(ParseError):
        parse_csv("a,b\n1\n")
    assert parse_csv("") == ([], [])


def test_row_documents(spark):
    rows = row_documents(spark.createDataFrame([(1, "x", None), (2, "", "z")], "id int, a string, b string"), "id").collect()
    assert [r.text for r in rows] == ["id: 1\na: x", "id: 2\nb: z"]
    assert rows[0].meta == {"id": "1", "a": "x", "b": ""}


def test_markup():
    assert html_text("<head><title>t</title></head><p>a&amp;b<script>x</p>y</script> c</p><b>d</b>&#8212;&zz; &lt") == "a&b c\nd  &zz; &lt"
    assert html_text(None) is None and html_text("") == ""
    assert rtf_text(b"{\\rtf1{\\fonttbl x;}{\\*\\foo y}caf\\'e9 \\u8364?\\par end}") == "café €\nend"


def test_extract(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    assert extract("a.docx", out.getvalue()) == ("one\ntwo\n", "docx")
    assert extract("a.txt", "ﬁ".encode("utf-16")) == ("ﬁ", "text")
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.txt").write_bytes(b"\0\1")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.md").write_text("no")
    got = {r.title: (r.text, r.error) for r in read_directory(spark, str(tmp_path)).collect()}
    assert got == {"a": ("hello", None), "b": (None, "parse_error: binary content")}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.epoch() == 0 and store.read().count() == 0
    schema = "uri string, title string, text string, seq long, op string"
    store.apply(spark.createDataFrame([("a", "", "1", 1, "add"), ("a", "", "2", 2, "add"), ("b", "", "x", 3, "add")], schema))
    store.apply(spark.createDataFrame([("b", "", None, 4, "remove"), ("a", "", "old", 1, "add")], schema))
    assert store.epoch() == 2
    assert [(r.uri, r.text) for r in store.read().collect()] == [("a", "2")]
    assert store.read(1).count() == 2
    spark.createDataFrame([("c", "", "new", 5, "add")], schema).write.parquet(f"{tmp_path}/in")
    store.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.uri for r in store.read().collect()) == ["a", "c"]


def test_latest_with_ties_and_nulls(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 2, "z")], "k string, n int, v string")
    assert {(r.k, r.v) for r in latest(log, "k", "n").collect()} == {("a", "y"), (None, "z")}


def test_tree(spark):
    texts = ["red apples grow here.", "red apples grow there.", "blue whales swim deep.", None, "blue whales swim far."]
    nodes = tree.build(spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, text string"))
    rows = nodes.collect()
    assert sorted(r.node_id for r in rows if r.level == 0) == [1, 2, 3, 4, 5]
    assert sorted(sorted(r.children) for r in rows if r.level == 1) == [[1, 2], [3, 5]]
    best = tree.search_terms(nodes, spark.createDataFrame([(1, "blue whales")], "query_id long, text string"), 1).collect()
    assert best[0].score == 4.0 and best[0].level == 1
    near = tree.search_vectors(nodes, spark.createDataFrame([(1, "red apples")], "query_id long, text string"), HashEmbedder(64), 5).collect()
    assert near[0].rank == 1 and {1, 2} <= {r.node_id for r in near[:3]}
    own = tree.build(spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, text string"), summarize=lambda t: "short" if "apples" in t else None)
    assert sorted(r.text for r in own.filter("level = 1").collect())[1] == "short"


def test_groups_equal_plain_greedy():
    rng = np.random.default_rng(1)
    bags = [np.unique(rng.integers(0, 40, rng.integers(0, 12))) for _ in range(60)]
    free, want = [True] * 60, []
    for i, a in enumerate(bags):
        if free[i]:
            free[i] = False
            near = sorted((-len(set(a) & set(b)) / len(set(a) | set(b)), j) for j, b in enumerate(bags) if free[j] and set(a) & set(b))
            taken = [j for s, j in near if -s >= 0.1][:4]
            for j in taken:
                free[j] = False
            want.append([i, *taken])
    assert tree.groups(bags, 5, 0.1) == want


def test_pagerank_of_small_and_large_graphs_agree(spark):
    from tesserae.operators import graph

    edges = spark.createDataFrame([(1, 2, 2.0, "link"), (2, 3, 1.0, "link"), (5, 6, 1.0, "link")], graph.EDGES)
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "doc_id long")
    seeds = spark.createDataFrame([(1, 1, 1.0), (1, 7, 1.0), (2, 5, 0.0)], "query_id long, doc_id long, mass double")
    rows = lambda most: sorted((r.query_id, r.doc_id, round(r.rank, 9)) for r in graph.pagerank(nodes, edges, seeds, iterations=6, most_edges=most).collect())
    assert rows(10) == rows(0) and abs(sum(r for q, _, r in rows(10) if q == 2) - 1) < 1e-6


def test_index_snapshot(spark, tmp_path):
    from tesserae.operators import lexical
    from tesserae.streaming.snapshot import IndexStore

    chunks = spark.createDataFrame([(1, "red apples"), (2, "blue whales"), (3, "")], "chunk_id long, text string")
    store, built = IndexStore(spark, str(tmp_path / "i")), lexical.build(chunks)
    with pytest.raises(NotFound):
        store.load()
    assert store.commit(built, chunks=chunks) == 1
    read = store.load()
    for name in ("postings", "term_stats", "doc_len", "stats"):
        assert sorted(map(repr, getattr(built, name).collect())) == sorted(map(repr, getattr(read, name).collect()))
    assert store.extra("chunks").count() == 3 and store.extra("embeddings") is None
    with pytest.raises(ValueError):
        store.commit(built, other=chunks)


def test_passages_are_found_to_the_letter(spark):
    from tesserae.operators import evaluate

    docs = spark.createDataFrame([(1, "it says: alpha beta gamma delta epsilon."), (2, "xalpha beta gamma deltas"), (3, "alpha  beta gamma delta"), (4, "ab"), (5, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "b"), (3, "beta gamma"), (4, None), (5, "zz yy xx ww")], "query_id long, text string")
    assert sorted(map(tuple, evaluate.containing(asked, docs).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3)]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_approximate_vector_queries_find_the_true_top_ten(spark):
    from tesserae.operators import dense
    from tesserae.plans import catalog

    d = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.vec_id) for r in dense.search(catalog.vectors(spark, d), catalog.vector_queries(spark, d), 10).collect()}
    for name in ("pq_adc", "ivf_top10"):
        found = {(r.query_id, r.vec_id) for r in catalog.QUERIES[name](spark, d).collect()}
        assert len(found & exact) >= 0.9 * len(exact), (name, len(found & exact) / len(exact))


def test_similar_pairs_equal_brute_force(spark):
    from itertools import combinations

    from tesserae.operators import graph

    rng = np.random.default_rng(6)
    bags = {k: {int(x) for x in rng.integers(0, 60, rng.integers(1, 20))} for k in range(80)}
    bags[80] = set(bags[3])
    terms = spark.createDataFrame([(k, f"t{x}") for k, b in bags.items() for x in b], "doc_id long, term string")
    want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in combinations(sorted(bags.items()), 2) if len(a & b) >= 0.15 * len(a | b)}
    for block in (1 << 20, 100):
        got = {(r.x, r.y): r.sim for r in graph.similar_pairs(terms, 0.15, block).collect()}
        assert got == want
    assert graph.similar_pairs(terms.limit(0)).count() == 0


def test_best_of_tiles_equal_a_full_sort():
    from tesserae.operators.best import Best

    rng = np.random.default_rng(3)
    s = np.round(rng.normal(size=(5, 900)), 2)  # many equals
    s[2, :] = 1.0
    ids, best = rng.permutation(900), Best(5, 7)
    for lo in range(0, 900, 100):
        best.add(np.arange(5), ids[lo : lo + 100], s[:, lo : lo + 100])
    q, found, score = best.result()
    for k in range(5):
        order = np.lexsort((ids, -s[k]))[:7]
        assert found[q == k].tolist() == ids[order].tolist() and score[q == k].tolist() == s[k][order].tolist()


def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch):
    """More queries than are sent to tasks, vectors of several files: as one product of all with all, in bounded tiles."""
    from tesserae.operators import best, dense

    monkeypatch.setattr(dense, "FEW_QUERIES", 10)
    monkeypatch.setattr(best, "BLOCK_BYTES", 20_000)
    m = np.random.default_rng(4).normal(size=(300, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[200:] = m[:100]  # ties
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id")
    exact = m @ m.T
    order = lambda s, k: [sorted(range(300), key=lambda j: (-round(s[i, j], 6), j))[:k] for i in range(300)]
    got = lambda df: [[r.vec_id for r in sorted(rows, key=lambda r: r.rank)] for _, rows in sorted(_by_query(df).items())]
    assert got(dense.search(v, q, 5)) == order(exact, 5)
    signs = np.where(m >= 0, 1.0, -1.0)
    pool = order(signs @ signs.T, 20)
    assert got(dense.sign_search(v, q, 8, 20, 5)) == [sorted(p, key=lambda j: (-round(exact[i, j], 6), j))[:5] for i, p in enumerate(pool)]
    tokens = [m[:, :4], m[:, 4:]]
    late = sum(np.maximum(np.maximum(t @ tokens[0].T, t @ tokens[1].T), 0) for t in tokens)
    halves = v.selectExpr("vec_id", "array(slice(embedding, 1, 4), slice(embedding, 5, 4)) tokens")
    assert got(dense.late_search(halves, halves.withColumnRenamed("vec_id", "query_id"), 5)) == order(late, 5)
    centres = spark.createDataFrame([(k, m[k].tolist()) for k in range(6)], "cell int, centre array<double>")
    near = np.argsort(((m[:, None] - m[None, :6]) ** 2).sum(2), axis=1, kind="stable")
    inside = np.array([[near[j, 0] in near[i, :3] for j in range(300)] for i in range(300)])
    assert got(dense.ivf_search(dense.ivf_assign(v, centres), centres, q, 3, 5)) == order(np.where(inside, exact, -9.0), 5)
    book = spark.createDataFrame([(s, k, m[k, s * 4 : s * 4 + 4].tolist()) for s in (0, 1) for k in range(16)], "sub int, code int, centroid array<double>")
    code = [np.argmin(((t[:, None] - t[None, :16]) ** 2).sum(2).round(12), axis=1) for t in tokens]
    adc = sum(t @ t[c].T for t, c in zip(tokens, code))
    found = dense.pq_search(dense.pq_encode(v, book), book, q, 30)
    assert got(found) == order(adc, 30)
    assert got(dense.rescored(found, v, q, 5)) == [sorted(p, key=lambda j: (-round(exact[i, j], 6), j))[:5] for i, p in enumerate(order(adc, 30))]


def _by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_search_reads_bags_once_and_shuffles_only_the_best(spark, monkeypatch):
    """Against plain sums: hot and rare terms, several blocks of query terms and of queries, repeated ids, equal texts, short products."""
    from collections import Counter
    from math import log1p

    from tesserae.operators import lexical

    rng = np.random.default_rng(8)
    words = np.array(["the", "of", *(f"w{k}" for k in range(300))])
    p = np.r_[60, 30, 40 / np.arange(1, 301)]
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    texts = [text(rng.integers(0, 60)) for _ in range(150)]
    texts[50:70] = [texts[3]] * 20
    rows = [*enumerate(texts), (149, "the extra W1 row's")]
    asked = [(k, text(12)) for k in range(30)]
    made = {}
    for k, t in rows:
        made.setdefault(k, Counter()).update(w for w in t.lower().replace("'", "").split() if len(w) > 1)
    n, dl = len(rows), {k: sum(c.values()) for k, c in made.items()}
    avgdl, df = sum(dl[k] for k, _ in rows) / n, Counter(w for c in made.values() for w in c)
    w = lambda c, t: made[c][t] * 2.2 / (made[c][t] + 1.2 * (0.25 + 0.75 * dl[c] / avgdl))
    want = {}
    for q, t in asked:
        s = {c: sum(log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * w(c, x) for x in t.split() if made[c][x]) for c in made}
        want[q] = [(c, round(s[c], 6)) for c in sorted((c for c in s if s[c]), key=lambda c: (-round(s[c], 6), c))[:5]]
    monkeypatch.setattr(lexical, "QUERY_TERMS", 100)
    monkeypatch.setattr(lexical, "QUERIES", 4)
    monkeypatch.setattr(lexical, "PRODUCTS", 7)
    x = lexical.build(spark.createDataFrame(rows, "chunk_id long, text string"))
    found = lexical.search(x, spark.createDataFrame(asked, "query_id long, text string"), 5)
    got = {q: [(r.chunk_id, round(r.score, 6)) for r in sorted(hits, key=lambda r: r.rank)] for q, hits in _by_query(found).items()}
    assert got == {q: hits for q, hits in want.items() if hits}
    assert {(r.term, r.df) for r in x.term_stats.collect()} == set(df.items())


def test_synchronous_labels_vote_for_themselves(spark):
    """Without the vote of their own, the two ends of an edge would swap labels for ever."""
    from tesserae.operators import graph

    edges = spark.createDataFrame([(1, 2, 2.0, "link"), (3, 4, 1.0, "link"), (4, 5, 3.0, "link")], graph.EDGES)
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "doc_id long")
    label = {r.doc_id: r.label for r in graph.synchronous_labels(nodes, edges).collect()}
    assert label[1] == label[2] == 1 and label[4] == label[5] and label[6] == 6


def test_set_edges_equal_nearest_of_all_pairs(spark, monkeypatch):
    """Several files, hot and rare terms, equal sets: the edges of all pairs' nearest, none of which is written."""
    from tesserae.operators import best, graph

    rng = np.random.default_rng(9)
    bags = {k: {int(x) for x in np.minimum(rng.geometric(0.04, rng.integers(1, 25)), 400)} for k in range(200)}
    bags |= {k: set(bags[3]) for k in range(200, 230)}
    terms = spark.createDataFrame([(k, f"t{x}") for k, b in bags.items() for x in b], "doc_id long, term string")
    monkeypatch.setattr(best, "BLOCK_BYTES", 8000)
    monkeypatch.setattr(graph, "HOT_TERMS", 10)
    monkeypatch.setattr(graph, "PRODUCTS", 50)
    rows = lambda df: sorted((r.a, r.b, round(r.weight, 9)) for r in df.collect())
    assert rows(graph.similarity_edges(terms)) == rows(graph.nearest_edges(graph.similar_pairs(terms)))


def test_autocut_takes_no_rounding_for_a_fall(spark):
    from tesserae.operators import rerank

    scores = [10.0, 9.0, 8.0, 8.0 - 2e-15, 8.0 - 4e-15, 6.5, 5.5]  # falls 1, 1, 1.5, 1: none is twice their mean
    hits = spark.createDataFrame([(1, k, s, k) for k, s in enumerate(scores, 1)], rerank.HITS)
    assert rerank.autocut(hits).count() == 7

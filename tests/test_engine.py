"""Corpus, pipelines, engine, requests, registry, models and the command line, on small cases."""

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import __main__ as cli
from tesserae import registry
from tesserae.engine import Corpus, CorpusConfig, Engine, Hybrid, Pipeline
from tesserae.functions.embedders import CachingReranker, Fallback, HashEmbedder, HttpEmbedder, HttpReranker, OverlapReranker, ProcessEmbedder, Retrying, Service, embed_pending
from tesserae.functions.hashing import fnv1a, hash_embed, hash_embed_many, token_matrices
from tesserae.functions.wordpiece import WordPiece, wordpiece_ids
from tesserae.plans.errors import CorruptIndex, DimensionMismatch, EmptyCorpus, InvalidParams, NotFound, ParseError, TransportError, Unavailable
from tesserae.service import Service as Requests
from tesserae.service import decode_vector, default_options, encode_vector, hit_id, parse_retrieve

PLANTS = [("roses", "Roses need sun and water. Prune roses in spring."), ("ferns", "Ferns like shade. Water ferns often."), ("engines", "A diesel engine burns fuel. Engines need oil."), ("boats", "Sail boats move by wind over water.")]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark).with_embedder({"type": "hash", "dim": 64})
    rows = [(u, t, {"topic": "garden" if k < 2 else "machine", "n": str(k)}) for k, (u, t) in enumerate(PLANTS)]
    return e.add(spark.createDataFrame(rows, "uri string, text string, meta map<string,string>")).build()


# --- models ---


def plain_embed(text, dim):
    v, last = np.zeros(dim), None
    for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split():
        for key, x in ((w, 1.0), (f"{last}_{w}", 0.5)) if last else ((w, 1.0),):
            h = fnv1a(key.encode())
            v[h % dim] += -x if h >> 63 else x
        last = w
    return v / (np.linalg.norm(v) or 1)


def test_hash_embedder():
    texts = ["The cat, the CAT-flap!", "", None, "é b c", "x" * 3000]
    got = hash_embed_many(texts, 32)
    for t, row in zip(texts, got):
        assert np.allclose(row, plain_embed(t or "", 32), atol=1e-6)
    assert hash_embed("a b", 8) == pytest.approx(hash_embed_many(["a b"], 8)[0].tolist())
    one, none = token_matrices(["ab ab cd", ""], 16)
    assert one.shape == (3, 16) and (one[0] == one[1]).all() and np.allclose((one**2).sum(1), 1) and none.shape == (0, 16)


def reply(value, status=200):
    return lambda *_: (status, json.dumps(value).encode())


def test_http_embedders():
    make = lambda kind, value, status=200, dim=2: HttpEmbedder(kind, Service(transport=reply(value, status)), "m", dim)
    assert make("ollama", {"embeddings": [[3, 4]]}).embed(["a"]).tolist() == pytest.approx(np.array([[0.6, 0.8]]))
    assert make("openai", {"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [2, 0]}]}).embed(["a", "b"]).tolist() == [[1, 0], [0, 1]]
    assert make("tei", [[0, 5]]).embed(["a"]).tolist() == [[0, 1]]
    assert make("llamacpp", [{"embedding": [1, 0]}]).embed(["a", "b"]).shape == (2, 2)
    assert make("tei", []).embed([]).shape == (0, 2)
    for kind, value, error in (("ollama", {}, ParseError), ("openai", {"data": [{}]}, ParseError), ("tei", [[1, 2], [3, 4]], ParseError), ("tei", [[1, 2, 3]], DimensionMismatch), ("tei", [["x", "y"]], ParseError)):
        with pytest.raises(error):
            make(kind, value).embed(["a"])
    with pytest.raises(TransportError):
        make("tei", [[1, 2]], 500).embed(["a"])
    with pytest.raises(TransportError):
        HttpEmbedder("tei", Service(port=9, seconds=1)).embed(["a"])
    asked = []
    sent = HttpEmbedder("openai", Service(api_key="k", transport=lambda *a: asked.append(a) or (200, b'{"data": [{"embedding": [1, 0]}]}')), "m", 2)
    sent.embed(["t"])
    assert json.loads(asked[0][3]) == {"model": "m", "input": ["t"]} and asked[0][4] == {"Authorization": "Bearer k"}


class Failing:
    dimension, identity = 4, "failing"

    def __init__(self, errors):
        self.errors, self.calls = list(errors), 0

    def embed(self, texts):
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)
        return np.ones((len(texts), 4), np.float32)


def test_retry_and_fallback():
    inner = Failing([TransportError("x"), Unavailable("y")])
    assert Retrying(inner, 3, 0.001).embed(["a"]).shape == (1, 4) and inner.calls == 3
    with pytest.raises(Unavailable):
        Retrying(Failing([Unavailable("x")] * 5), 2, 0.001).embed(["a"])
    inner = Failing([ParseError("x")])
    with pytest.raises(ParseError):
        Retrying(inner, 3, 0.001).embed(["a"])
    assert inner.calls == 1
    both = Fallback(Failing([TransportError("x")]), HashEmbedder(4))
    assert both.identity == "failing" and np.allclose(both.embed(["a b"]), hash_embed_many(["a b"], 4))
    with pytest.raises(ParseError):
        Fallback(Failing([ParseError("x")]), HashEmbedder(4)).embed(["a"])
    with pytest.raises(DimensionMismatch):
        Fallback(HashEmbedder(4), HashEmbedder(8))


def test_process_embedder():
    code = "import sys, json\nfor line in sys.stdin:\n    t = json.loads(line)['texts']\n    print(json.dumps({'error': 'no'} if t == ['bad'] else {'vectors': [[len(x), 0] for x in t]}), flush=True)"
    e = ProcessEmbedder([sys.executable, "-c", code], 2)
    assert e.embed(["ab", "c"]).tolist() == [[1, 0], [1, 0]]
    with pytest.raises(Unavailable):
        e.embed(["bad"])
    e.close()
    with pytest.raises(Unavailable):
        ProcessEmbedder(["/nowhere"], 2).embed(["a"])
    with pytest.raises(TransportError):
        ProcessEmbedder([sys.executable, "-c", "pass"], 2).embed(["a"])


def test_embed_pending_asks_new_texts_once(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a b"), (4, "")], "chunk_id long, text string")
    first = embed_pending(chunks.filter("chunk_id < 3"), None, HashEmbedder(8))
    again = embed_pending(chunks, first, HashEmbedder(8)).collect()
    assert {r.chunk_id: r.embedding and [round(x, 5) for x in r.embedding] for r in again} == {1: [round(x, 5) for x in hash_embed("a b", 8)], 2: [round(x, 5) for x in hash_embed("c d", 8)], 3: [round(x, 5) for x in hash_embed("a b", 8)], 4: None}


def test_rerankers():
    assert OverlapReranker().rerank("red roses", ["roses are red", "red", ""]) == [1.0, 0.5, 0.0]
    assert HttpReranker("tei", Service(transport=reply([{"index": 1, "score": 0.9}]))).rerank("q", ["a", "b"]) == [0.0, 0.9]
    assert HttpReranker("cohere", Service(transport=reply({"results": [{"index": 0, "relevance_score": 0.4}]}))).rerank("q", ["a"]) == [0.4]
    with pytest.raises(ParseError):
        HttpReranker("tei", Service(transport=reply([{"index": 7, "score": 1}]))).rerank("q", ["a"])
    with pytest.raises(ParseError):
        HttpReranker("jina", Service(transport=reply({}))).rerank("q", ["a"])
    calls = []

    class Counting:
        def rerank(self, q, p):
            calls.append(list(p))
            return [float(len(x)) for x in p]

    c = CachingReranker(Counting(), 2)
    assert c.rerank("q", ["a", "bb", "a"]) == [1, 2, 1] and c.rerank("q", ["bb", "ccc"]) == [2, 3]
    assert calls == [["a", "bb"], ["ccc"]] and len(c.seen) == 2


def test_wordpiece(spark, tmp_path):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "the", ",", "a"]
    (tmp_path / "vocab.txt").write_text("\n".join(pieces))
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {p: k for k, p in enumerate(pieces)}}}))
    for name in ("vocab.txt", "t.json"):
        t = WordPiece.load(str(tmp_path / name))
        assert t.encode("The unaffable,xyz A") == [2, 7, 4, 5, 6, 8, 1, 9, 3]
        assert t.encode("the the the the", 4) == [2, 7, 7, 3] and t.encode("") == [2, 3]
        ids, kinds = t.encode_pair("the the the the", "a a a a a a", 9)
        assert ids == [2, 7, 7, 3, 9, 9, 9, 9, 3] and kinds == [0] * 4 + [1] * 5
    got = spark.createDataFrame([("the",), (None,)], "t string").select(wordpiece_ids(t, F.col("t")).alias("i")).collect()
    assert [r.i for r in got] == [[2, 7, 3], None]
    with pytest.raises(NotFound):
        WordPiece.load(str(tmp_path / "none"))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "empty.txt").write_text("")
    for name in ("bad.json", "empty.txt"):
        with pytest.raises(CorruptIndex):
            WordPiece.load(str(tmp_path / name))


def test_registry(tmp_path, monkeypatch):
    assert {"hash", "ollama", "openai", "voyage", "together", "llamacpp", "onnx", "gguf", "retry", "fallback", "process"} <= set(registry.embedders.names())
    e = registry.embedders.create({"type": "retry", "attempts": 2, "inner": {"type": "hash", "dim": 16}})
    assert e.dimension == 16 and e.attempts == 2 and registry.embedders.create("hash").dimension == 256
    for settings, error in (("nothing", NotFound), ({"dim": 3}, InvalidParams), ({"type": "hash", "dim": "x"}, InvalidParams), ("onnx", Unavailable), ({"type": "retry"}, InvalidParams), (7, InvalidParams)):
        with pytest.raises(error):
            registry.embedders.create(settings)
    assert registry.embedders.create({"type": "ollama", "host": "h", "timeout_ms": 500}).service.seconds == 0.5
    (tmp_path / "tess_plugin.py").write_text("from tesserae.functions.embedders import HashEmbedder\ndef register(e, r):\n    e.register('mine', lambda c: HashEmbedder(3), 'my own')\n")
    (tmp_path / "tess_bad.py").write_text("")
    monkeypatch.syspath_prepend(str(tmp_path))
    registry.load_plugin("tess_plugin")
    assert registry.embedders.create("mine").dimension == 3 and registry.embedders.describe()["mine"] == "my own"
    del registry.embedders.known["mine"]
    for name, error in (("tess_none", NotFound), ("tess_bad", InvalidParams)):
        with pytest.raises(error):
            registry.load_plugin(name)


# --- corpus and engine ---


def uris(rows):
    return [r.uri for r in rows]


def test_search_filter_and_pipelines(spark, engine):
    assert uris(engine.search("prune roses", 2))[0] == "roses"
    assert set(uris(engine.search("water", 4, F.col("meta")["topic"] == "machine"))) <= {"engines", "boats"}
    trace = []
    queries = spark.createDataFrame([(1, "prune roses"), (2, "diesel engine oil")], "query_id long, text string")
    for pipeline in (Pipeline.standard(), Pipeline.quality(), Pipeline.context(), Pipeline.best(), Pipeline.standard(Hybrid("rrf")), Pipeline.standard(Hybrid("rsf"))):
        got = {r.query_id: r.chunk_id for r in pipeline.run(engine.corpus, queries, 3, trace=trace).filter("rank = 1").collect()}
        want = {r.query_id: r.chunk_id for r in engine.search_many(queries, 1).collect()}
        assert got == want
    assert "hybrid: 2 lists of 60" in trace
    assert engine.search("zzzz", 0 + 1, F.col("meta")["topic"] == "none") == []
    with pytest.raises(InvalidParams):
        Pipeline.standard().run(engine.corpus, queries, 0)
    with pytest.raises(EmptyCorpus):
        Engine(spark).search("x")


def test_quality_at_full_relevance_is_standard(spark, engine):
    q = spark.createDataFrame([(1, "water")], "query_id long, text string")
    rows = lambda p: [(r.chunk_id, r.rank) for r in p.run(engine.corpus, q, 4).orderBy("rank").collect()]
    assert rows(Pipeline.quality(1.0)) == rows(Pipeline.standard())


def test_upsert_delete_compact_and_lexical_only(spark):
    e = Engine(spark, CorpusConfig(chunking="proposition", contextual=True)).add(spark.createDataFrame(PLANTS, "uri string, text string")).build()
    assert uris(e.search("ferns", 1)) == ["ferns"]
    e.add("ferns", "Cactus plants store water.").build()
    assert "ferns" not in " ".join(r.text.lower() for r in e.search("ferns shade often", 5) if r.uri == "ferns")
    assert uris(e.search("cactus", 1)) == ["ferns"] and e.corpus.counts()["documents"] == 4
    assert e.remove(["boats", "nothing"]) == 1 and "boats" not in uris(e.search("sail boats wind", 5))
    assert e.remove(["boats"]) == 0
    before = e.corpus.index.stats.first().n
    e.corpus.compact().build()
    assert e.corpus.index.stats.first().n < before and e.corpus.counts()["deleted"] == 0 and uris(e.search("cactus", 1)) == ["ferns"]
    found = e.corpus.find_by_uri(spark.createDataFrame([("roses",), ("boats",)], "uri string")).collect()
    assert [r.uri for r in found] == ["roses"]
    with pytest.raises(InvalidParams):
        CorpusConfig(chunking="lines")
    with pytest.raises(InvalidParams):
        Corpus(spark).add(spark.createDataFrame([(1,)], "x int"))


def test_save_and_open(spark, engine, tmp_path):
    epoch = engine.save(str(tmp_path / "index"))
    again = Engine.open(spark, str(tmp_path / "index")).with_embedder({"type": "hash", "dim": 64})
    assert epoch == 1 and [(r.uri, round(r.score, 6)) for r in again.search("water garden", 4)] == [(r.uri, round(r.score, 6)) for r in engine.search("water garden", 4)]
    again.remove(["roses"])
    assert again.save(str(tmp_path / "index")) == 2
    third = Engine.open(spark, str(tmp_path / "index"))
    assert "roses" not in uris(third.search("roses", 5)) and third.corpus.counts()["documents"] == 3
    with pytest.raises(DimensionMismatch):
        third.with_embedder({"type": "hash", "dim": 32})
    with pytest.raises(NotFound):
        Engine.open(spark, str(tmp_path / "none"))
    import shutil

    shutil.rmtree(tmp_path / "index" / "v=2" / "postings")
    with pytest.raises(CorruptIndex):
        Engine.open(spark, str(tmp_path / "index"))


def test_dense_failure_leaves_the_lexical_list(spark, engine):
    class Broken:
        dimension, identity = 64, "hash"

        def embed(self, texts):
            raise AssertionError("is asked by a task only")

    trace, old = [], engine.corpus.embeddings
    engine.corpus.embeddings = None
    try:
        got = Pipeline.standard().run(engine.corpus, engine.one("roses"), 1, trace=trace).collect()
    finally:
        engine.corpus.embeddings = old
    assert len(got) == 1 and "dense unavailable: unavailable" in trace


# --- requests ---


@pytest.fixture(scope="module")
def requests(engine):
    return Requests(engine, default_options(filter_fields=["topic", "n"], generate=lambda prompt: ["roses and sun", ""]))


def test_parameters():
    r = parse_retrieve({"query": "a", "k": 5})
    assert (r.k, r.candidates, r.top_n, r.mode) == (5, 20, 5, "hybrid")
    assert parse_retrieve({"query": "a", "k": 500}).k == 100
    assert parse_retrieve({"query": [{"text": "a"}, "b"]}).query == "a b"
    r = parse_retrieve({"query": "a", "k": 3, "rerank": True})
    assert (r.rerank, r.top_n, r.candidates) == (True, 10, 12)
    assert parse_retrieve({"query": "a", "k": 3, "rerank": {"topN": 2}}).top_n == 3 and parse_retrieve({"query": "a", "rerank": False}).rerank is False
    assert parse_retrieve({"query": "a", "fusion": {"method": "weighted"}}).fusion.method == "rsf"
    for bad in ({}, {"query": ""}, {"query": "a", "k": 0}, {"query": "a", "mode": "x"}, {"query": "a", "fusion": {"method": "x"}}, {"query": "a", "fusion": {"alpha": 2}}, {"query": "a", "k": 9, "candidateK": 3}, {"query": "a", "rewrite": "x"}):
        with pytest.raises(InvalidParams):
            parse_retrieve(bad)


def test_retrieve(requests):
    got = requests.handle("retrieve", {"query": "prune roses", "k": 2})
    assert got["hits"][0]["citation"]["source"] == "roses" and got["usage"]["mode"] == "hybrid" and got["hits"][0]["id"].startswith("roses#")
    for mode in ("dense", "sparse"):
        assert requests.handle("retrieve", {"query": "prune roses", "k": 1, "mode": mode})["hits"][0]["citation"]["source"] == "roses"
    found = requests.handle("retrieve", {"query": "water", "k": 5, "filter": {"field": "topic", "value": "machine"}})["hits"]
    assert found and {h["citation"]["source"] for h in found} <= {"engines", "boats"}
    assert requests.handle("retrieve", {"query": "x", "filter": {"field": "secret", "value": 1}})["error"]["code"] == -32602
    re = requests.handle("retrieve", {"query": "ferns water", "k": 2, "rerank": True, "includeVectors": True, "includeText": False})
    assert re["usage"]["reranked"] and "text" not in re["hits"][0] and len(decode_vector(re["hits"][0]["vector"])) == 64
    assert requests.handle("retrieve", {"query": "oil", "rewrite": "hyde"})["usage"]["mode"] == "hybrid+hyde"
    assert len(requests.handle("retrieve", {"query": "water", "k": 4, "tokenBudget": 1})["hits"]) == 1
    assert requests.handle("retrieve", {"query": "water", "minScore": 99})["hits"] == []


def test_other_methods(requests):
    e = requests.handle("embed", {"input": ["a b", "c"]})
    assert e["dimension"] == 64 and np.allclose(decode_vector(e["vectors"][0]), hash_embed("a b", 64), atol=1e-6)
    assert len(requests.handle("embed", {"input": "a", "encoding": "float"})["vectors"][0]) == 64
    assert requests.handle("embed", {})["error"]["code"] == -32602
    r = requests.handle("rerank", {"query": "red", "documents": ["blue", {"text": "red"}], "topN": 1})
    assert r["results"] == [{"index": 1, "score": 1.0}] and requests.handle("rerank", {"query": "red", "documents": ["x"], "method": "colbert"})["method"] == "colbert"
    assert requests.handle("transform", {"query": "q"})["queries"] == ["roses and sun"]
    s = requests.handle("embed_sparse", {"texts": ["roses", "zzz"]})["sparse"]
    assert s[0]["indices"] and s[1] == {"indices": [], "values": []}
    assert requests.handle("embed_multi", {"inputs": ["a b"]})["dimension"] == 64
    assert requests.handle("index_add", {"documents": []})["error"] and requests.handle("feedback", {"signals": [1, 2]}) == {"accepted": True, "received": 2}
    assert "error" in requests.handle("nothing") and Requests(requests.engine).handle("rerank", {"query": "q", "documents": []})["error"]
    assert Requests(requests.engine, hooks={"embed": lambda p: {"mine": p}}).handle("embed", {"x": 1}) == {"mine": {"x": 1}}
    offered = requests.capabilities()
    assert offered["retrieve"]["modes"] == ["hybrid", "dense", "sparse"] and offered["filter"]["fields"] == ["topic", "n"] and not offered["index"]["writable"]
    assert "rerank" not in Requests(requests.engine).capabilities()
    assert hit_id("u", 3) == "u#3" and hit_id("", 3) == "chunk-3" and decode_vector(encode_vector([1.5, -2])).tolist() == [1.5, -2]
    with pytest.raises(InvalidParams):
        decode_vector("%%%")


def test_graph_and_memory(requests):
    local = requests.handle("graph", {"query": "roses", "k": 3})
    assert local["hits"][0]["unit"] == "node" and local["usage"] == {"op": "local"}
    assert requests.handle("graph", {"query": "roses prune spring", "op": "global"})["hits"][0]["unit"] == "community"
    assert requests.handle("memory_build")["communities"] >= 1
    clues = requests.handle("memory_recall", {"query": "roses"})["clues"]
    assert clues[0] == {"query": "roses", "weight": 1.0} and "roses" in clues[1]["seedIds"]
    assert requests.handle("graph", {})["error"]["code"] == -32602 and requests.handle("memory_recall", {})["error"]


def test_index_methods(spark, tmp_path):
    s = Requests(Engine(spark), default_options(index_writable=True, persist_path=str(tmp_path / "kept")))
    added = s.handle("index_add", {"documents": [{"id": "a", "text": "apples grow", "meta": {"n": 1}}, {"uri": "b", "text": "boats sail"}]})
    assert added == {"ids": ["a", "b"], "chunks": 2}
    s.handle("index_add", {"documents": [{"id": "a", "text": "pears grow"}]})
    assert s.handle("retrieve", {"query": "grow"})["hits"][0]["text"] == "pears grow"
    assert s.handle("index_delete", {"ids": ["b", "none"]}) == {"deleted": 1}
    assert Engine.open(spark, str(tmp_path / "kept")).corpus.counts()["documents"] == 1


# --- command line ---


def test_command_line(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in PLANTS:
        (tmp_path / "docs" / f"{name}.txt").write_text(text)
    (tmp_path / "docs" / "skip.csv").write_text("a,b\n1,2\n")
    said = []
    run = lambda *a: cli.main([str(x) for x in a], spark, said.append)
    assert run("index", tmp_path / "docs", tmp_path / "index", "--ext=*.txt", "--proposition") == 0
    assert said.pop() == f"4 documents, 7 chunks in {tmp_path / 'index'}, epoch 1"
    assert run("query", tmp_path / "index", "prune roses", "-k", 1, "--pipeline", "best") == 0 and "roses.txt" in said.pop()
    assert run("info", tmp_path / "index") == 0 and said[0].split() == ["documents", "4"]
    said.clear()
    assert run("list") == 0 and any(x.startswith("embedder  hash") for x in said)
    assert run("info", tmp_path / "none") == 1 and said[-1].startswith("error: not_found")
    (tmp_path / "t.csv").write_text("id,body\n7,tall trees\n8,small stones\n")
    assert run("index", tmp_path / "t.csv", tmp_path / "rows", "--csv-id", "id") == 0
    assert run("query", tmp_path / "rows", "stones", "-k", 1) == 0 and "t.csv#8" in said[-1]
    bench = tmp_path / "beir"
    (bench / "qrels").mkdir(parents=True)
    (bench / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": u, "title": "", "text": t}) for u, t in PLANTS))
    (bench / "queries.jsonl").write_text(json.dumps({"_id": "1", "text": "prune roses"}))
    (bench / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n1\troses\t1\n")
    assert run("eval", bench) == 0 and "ndcg_10" in said[-1] and "1.0000" in said[-1]
    assert cli.suffixes(["md", "*.rst,.txt"]) == ["md", "rst", "txt"] and cli.suffixes([]) is None

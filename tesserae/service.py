"""Requests as dictionaries: their parameters checked, answered by an engine, errors as codes. No transport."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.engine import Engine, Hybrid, Pipeline
from tesserae.functions.embedders import LateReranker, pair_scorer
from tesserae.functions.hashing import token_matrices
from tesserae.operators import filters, fusion, lexical, sparse
from tesserae.plans.errors import EngineError, InvalidParams, Unavailable, to_wire

MODES, FUSIONS, REWRITES = ("dense", "sparse", "hybrid"), {"rrf": "rrf", "weighted": "rsf", "convex": "convex"}, ("hyde", "multi-query")
METHODS = ("retrieve", "embed", "rerank", "transform", "embed_sparse", "embed_multi", "graph", "index_add", "index_delete", "feedback", "memory_build", "memory_recall")


class Missing(EngineError):
    """The method isn't offered here."""

    code = "capability_missing"


class Unsupported(EngineError):
    """The method is offered, the option isn't."""

    code = "option_unsupported"


def encode_vector(v) -> str:
    """Little-endian single-precision numbers in base 64."""
    return base64.b64encode(np.asarray(v, "<f4").tobytes()).decode()


def decode_vector(text: str) -> np.ndarray:
    try:
        return np.frombuffer(base64.b64decode(text, validate=True), "<f4")
    except ValueError as e:
        raise InvalidParams("a vector is little-endian float32 in base 64") from e


def hit_id(uri: str | None, chunk_id: int) -> str:
    """The same for the same chunk of the same document, whoever asks."""
    return f"{uri}#{chunk_id}" if uri else f"chunk-{chunk_id}"


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


@dataclass
class Retrieve:
    """Checked parameters of a retrieve request."""

    query: str
    k: int = 10
    mode: str = "hybrid"
    candidates: int = 40
    fusion: Hybrid | None = None
    min_score: float | None = None
    token_budget: int | None = None
    include_text: bool = True
    include_vectors: bool = False
    rerank: bool = False
    top_n: int = 10
    filter: dict | None = None
    rewrite: str = ""


def query_text(value) -> str:
    """Text of a string, an object with 'text', or a list of both."""
    parts = value if isinstance(value, list) else [value]
    said = [p if isinstance(p, str) else p.get("text", "") if isinstance(p, dict) else "" for p in parts]
    return " ".join(s for s in said if s).strip()


def parse_retrieve(p: dict, default_k: int = 10, max_k: int = 100) -> Retrieve:
    """k is 1 at least and max_k at most; the funnel candidateK >= rerank.topN >= k widens where it isn't given, and is refused where it is given the wrong way round."""
    text = query_text(p.get("query"))
    if not text:
        raise InvalidParams("query is required and has to carry text")
    k = p["k"] if _whole(p.get("k")) else default_k
    if k < 1:
        raise InvalidParams("k must be >= 1")
    out = Retrieve(text, min(k, max_k))
    if isinstance(p.get("mode"), str):
        out.mode = p["mode"]
        if out.mode not in MODES:
            raise InvalidParams(f"mode must be {'|'.join(MODES)}")
    wanted = p.get("fusion")
    if isinstance(wanted, dict):
        method = wanted.get("method", "convex")
        if method not in FUSIONS:
            raise InvalidParams(f"fusion.method must be {'|'.join(FUSIONS)}")
        alpha, rrf_k = wanted.get("alpha", fusion.ALPHA), wanted.get("rrfK", fusion.RRF_K)
        if not isinstance(alpha, (int, float)) or not 0 <= alpha <= 1:
            raise InvalidParams("fusion.alpha must be in [0, 1]")
        out.fusion = Hybrid(FUSIONS[method], float(alpha), rrf_k=int(rrf_k))
    if isinstance(p.get("minScore"), (int, float)):
        out.min_score = float(p["minScore"])
    if _whole(p.get("tokenBudget")):
        out.token_budget = p["tokenBudget"]
    out.include_text, out.include_vectors = p.get("includeText", True) is not False, p.get("includeVectors") is True
    asked = p.get("rerank")
    if isinstance(asked, dict) or asked is True:
        out.rerank = True
        out.top_n = max(asked.get("topN", max(out.k, 10)) if isinstance(asked, dict) else max(out.k, 10), out.k)
    else:
        out.top_n = out.k
    given = p.get("candidateK")
    out.candidates = given if _whole(given) else max(out.top_n, 4 * out.k)
    if out.candidates < out.top_n:
        raise InvalidParams("candidateK must be >= rerank.topN >= k")
    if out.fusion is not None:
        out.fusion = Hybrid(out.fusion.method, out.fusion.alpha, rrf_k=out.fusion.rrf_k, candidates=out.candidates)
    out.filter = p.get("filter")
    rewrite = p.get("rewrite")
    if isinstance(rewrite, str) and rewrite not in ("", "false"):
        if rewrite not in REWRITES:
            raise InvalidParams(f"rewrite must be {'|'.join(REWRITES)}")
        out.rewrite = rewrite
    return out


@dataclass
class Options:
    default_k: int = 10
    max_k: int = 100
    filter_fields: list[str] = field(default_factory=list)
    reranker: object | None = None
    token_embed: Callable | None = None
    generate: Callable[[str], list[str]] | None = None
    sparse: bool = False
    index_writable: bool = False
    persist_path: str = ""


class Service:
    """handle(method, params) answers with a dictionary, or with {'error': ...}. hooks: functions that answer methods instead."""

    def __init__(self, engine: Engine, options: Options | None = None, hooks: dict[str, Callable[[dict], dict]] | None = None):
        self.engine, self.options, self.hooks = engine, options or Options(), hooks or {}

    def handle(self, method: str, params: dict | None = None) -> dict:
        try:
            if method not in METHODS:
                raise Missing(f"no method {method!r}")
            return self.hooks[method](params or {}) if method in self.hooks else getattr(self, method)(params or {})
        except EngineError as e:
            return {"error": to_wire(e)}

    def capabilities(self) -> dict:
        """Only what can be done is offered."""
        o, e = self.options, self.engine.corpus.embedder
        has = lambda m: m in self.hooks
        out: dict = {"citations": True, "retrieve": {"maxK": o.max_k, "modes": ["hybrid", *["dense"] * (e is not None), *["sparse"] * o.sparse], "fusion": list(FUSIONS), "scoreScale": {"kind": "cosine", "min": -1.0}}}
        if o.generate or has("transform"):
            out["retrieve"]["rewrite"] = list(REWRITES)
            out["transform"] = [*REWRITES, "rewrite"]
        if o.reranker or o.token_embed or has("rerank"):
            out["retrieve"]["rerank"] = True
            out["rerank"] = [*["cross-encoder"] * bool(o.reranker or has("rerank")), *["colbert"] * bool(o.token_embed)]
        if e is not None or has("embed"):
            out["embed"] = {"dimension": e.dimension if e else 0, "model": e.identity if e else "host"}
        if o.sparse or has("embed_sparse"):
            out["embedSparse"] = True
        if o.token_embed or has("embed_multi"):
            out["embedMulti"] = {"similarity": "cosine"}
        out |= {"graph": ["local", "global"], "index": {"writable": o.index_writable or has("index_add")}, "feedback": True, "memory": {"scopes": ["global"], "clues": True}}
        if o.filter_fields:
            out["filter"] = {"fields": o.filter_fields, "operators": list(filters.LEAVES)}
        return out

    # --- retrieval ---

    def retrieve(self, p: dict) -> dict:
        r = parse_retrieve(p, self.options.default_k, self.options.max_k)
        if r.mode == "sparse" and not self.options.sparse:
            raise Unsupported("sparse mode needs a sparse index")
        where = filters.compile_filter(r.filter, self.options.filter_fields) if r.filter is not None else None
        corpus, one, mode = self.engine.corpus, self.engine.one(r.query), r.mode
        if r.rewrite and self.options.generate:
            hits, mode = self._rewritten(one, r), f"hybrid+{r.rewrite}"
        elif mode == "sparse":
            hits = self.engine.sparse_search(one, r.candidates)
        elif mode == "dense":
            hits = corpus.dense_search(one, r.candidates, where)
        else:
            pipeline = Pipeline.standard(r.fusion) if r.fusion is not None else self.engine.pipeline
            hits = pipeline.run(corpus, one, r.candidates, where)
        if where is not None:
            hits = filters.keep_documents(hits, corpus.chunks, corpus.documents, where)
        scorer = self.options.reranker or (LateReranker() if self.options.token_embed else None)
        did = r.rerank and scorer is not None
        passages = corpus.passages()
        if did:
            head = hits.filter(F.col("rank") <= r.top_n).join(passages.select("chunk_id", F.col("text").alias("p")), "chunk_id").withColumn("q", F.lit(r.query))
            hits = lexical.ranked(head.select("query_id", "chunk_id", pair_scorer(scorer)(F.col("q"), F.col("p")).alias("score")), None)
        kept = filters.budget(hits, passages, r.k, r.min_score, r.token_budget if r.include_text else None).drop("used")
        rows = self._rows(kept, r.include_text, r.include_vectors)
        return {"hits": rows, "usage": {"candidateK": r.candidates, "returned": len(rows), "mode": mode, "reranked": did}}

    def _rewritten(self, one: DataFrame, r: Retrieve) -> DataFrame:
        said = [x for x in self.options.generate(self._prompt(r.rewrite, r.query)) if x]
        generated = lambda _: F.array(*[F.lit(x) for x in said]).cast("array<string>")
        return (self.engine.hyde if r.rewrite == "hyde" else self.engine.multi_query)(one, generated, r.candidates)

    @staticmethod
    def _prompt(method: str, query: str) -> str:
        return f"Answer this in one short passage: {query}" if method == "hyde" else f"Write three other ways to ask this, each on a line of its own: {query}"

    def _rows(self, hits: DataFrame, text: bool = True, vectors: bool = False) -> list[dict]:
        found = self.engine.corpus.resolve(hits)
        if vectors and self.engine.corpus.embeddings is not None:
            found = found.join(self.engine.corpus.embeddings.select("chunk_id", "embedding"), "chunk_id", "left")
        out = []
        for x in found.orderBy("rank").collect():
            hit = {"id": hit_id(x.uri, x.chunk_id), "score": float(x.score), "unit": "chunk", "modality": "text", "citation": {"source": x.uri}, "trust": {"level": "corpus", "injectionSuspected": False}}
            if x.start_line or x.end_line:
                hit["citation"] |= {"startLine": x.start_line, "endLine": x.end_line}
            if text:
                hit["text"] = f"{x.context}\n{x.text}" if x.context else x.text
            if vectors and "embedding" in x.__fields__ and x.embedding is not None:
                hit["vector"] = encode_vector(x.embedding)
            out.append(hit)
        return out

    # --- models ---

    def embed(self, p: dict) -> dict:
        e = self.engine.corpus.embedder
        if e is None:
            raise Unavailable("no embedder is attached")
        given = p.get("input")
        if not isinstance(given, (str, list)):
            raise InvalidParams("input must be a string or an array")
        m = e.embed([given] if isinstance(given, str) else [str(t) for t in given])
        compact = p.get("encoding", "base64") != "float"
        return {"vectors": [encode_vector(v) if compact else [float(x) for x in v] for v in m], "dimension": e.dimension, "encoding": "base64" if compact else "float", "model": e.identity}

    def rerank(self, p: dict) -> dict:
        o = self.options
        if not o.reranker and not o.token_embed:
            raise Missing("no reranker is configured")
        query, docs = p.get("query"), p.get("documents")
        if not query or not isinstance(query, str):
            raise InvalidParams("query is required")
        if not isinstance(docs, list):
            raise InvalidParams("documents[] is required")
        method = p.get("method", "cross-encoder" if o.reranker else "colbert")
        scorer = LateReranker() if not o.reranker or method == "colbert" and o.token_embed else o.reranker
        scores = scorer.rerank(query, [d if isinstance(d, str) else str(d.get("text", d)) for d in docs])
        order = sorted(range(len(scores)), key=lambda i: -scores[i])[: p.get("topN", len(scores))]
        return {"results": [{"index": i, "score": float(scores[i])} for i in order], "method": method}

    def transform(self, p: dict) -> dict:
        if not self.options.generate:
            raise Missing("no generator is configured")
        query, method = p.get("query"), p.get("method", "multi-query")
        if not query:
            raise InvalidParams("query is required")
        return {"queries": [q for q in self.options.generate(self._prompt(method, query)) if q] or [query], "method": method}

    def embed_sparse(self, p: dict) -> dict:
        if not self.options.sparse:
            raise Missing("no sparse index is configured")
        texts = p.get("texts")
        if not isinstance(texts, list):
            raise InvalidParams("texts[] is required")
        asked = self.engine.spark.createDataFrame([(k, str(t)) for k, t in enumerate(texts)], "query_id long, text string")
        out: list[dict] = [{"indices": [], "values": []} for _ in texts]
        for row in sparse.encode(self.engine.sparse_index(), asked, expand=p.get("kind") == "document").orderBy("query_id", "term").collect():
            out[row.query_id]["indices"].append(row.term)
            out[row.query_id]["values"].append(float(row.w))
        return {"sparse": out}

    def embed_multi(self, p: dict) -> dict:
        if not self.options.token_embed:
            raise Missing("no token embedder is configured")
        inputs = p.get("inputs")
        if not isinstance(inputs, list):
            raise InvalidParams("inputs[] is required")
        made = self.options.token_embed([query_text(x) for x in inputs])
        return {"matrices": [m.tolist() for m in made], "dimension": max((m.shape[1] for m in made if m.size), default=0)}

    # --- graph and memory ---

    def graph(self, p: dict) -> dict:
        op, query, k = p.get("op", "local"), p.get("query"), p.get("k", self.options.default_k)
        if not query:
            raise InvalidParams("query is required")
        if op not in ("local", "global"):
            raise InvalidParams("op must be local|global")
        one = self.engine.one(query)
        found = (self.engine.graph_global if op == "global" else self.engine.graph_local)(one, k)
        rows = self._rows(found.select("query_id", "chunk_id", "score", "rank"))
        return {"hits": [h | {"unit": "community" if op == "global" else "node"} for h in rows], "usage": {"op": op}}

    def memory_build(self, p: dict) -> dict:
        _, _, summaries = self.engine.graph()
        return {"memoryId": "graph", "tokens": 0, "communities": summaries.count()}

    def memory_recall(self, p: dict) -> dict:
        """Clues for a query: the query itself, and the documents that the graph leads to from it."""
        query, n = p.get("query"), p.get("n", 5)
        if not query:
            raise InvalidParams("query is required")
        clues: list[dict] = [{"query": query, "weight": 1.0}]
        seeds = self.engine.graph_local(self.engine.one(query), n).orderBy("rank").collect()
        if seeds:
            clues.append({"seedIds": [r.uri or str(r.chunk_id) for r in seeds], "weight": 0.7})
        return {"clues": clues}

    # --- index ---

    def _writable(self) -> None:
        if not self.options.index_writable:
            raise Missing("the index is read-only")

    def _persist(self) -> None:
        if self.options.persist_path:
            self.engine.save(self.options.persist_path)

    def index_add(self, p: dict) -> dict:
        self._writable()
        docs = p.get("documents")
        if not isinstance(docs, list) or any(not isinstance(d, dict) for d in docs):
            raise InvalidParams("documents[] is required")
        rows = [(str(d.get("id", d.get("uri", ""))), d.get("title", ""), d.get("text", ""), {k: v if isinstance(v, str) else str(v) for k, v in (d.get("meta") or {}).items()}) for d in docs]
        if rows:
            self.engine.add(self.engine.spark.createDataFrame(rows, "uri string, title string, text string, meta map<string,string>")).build()
            self._persist()
        return {"ids": [r[0] for r in rows], "chunks": self.engine.corpus.counts()["chunks"]}

    def index_delete(self, p: dict) -> dict:
        self._writable()
        ids = p.get("ids") or []
        uris = [i for i in ids if isinstance(i, str)]
        numbers = [i for i in ids if _whole(i)]
        gone = self.engine.remove(uris) if uris else 0
        if numbers:
            gone += self.engine.corpus.remove(self.engine.spark.createDataFrame([(i,) for i in numbers], "doc_id long"))
        if gone:
            self._persist()
        return {"deleted": gone}

    def feedback(self, p: dict) -> dict:
        return {"accepted": True, "received": len(p.get("signals") or [])}


def default_options(**changes) -> Options:
    """All that needs no model: hashed token vectors, word overlap and the sparse index."""
    from tesserae import registry

    return Options(**({"reranker": registry.rerankers.create("overlap"), "token_embed": token_matrices, "sparse": True} | changes))

"""Embedders and rerankers by name, from settings; and more of them from modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from tesserae.functions.embedders import CachingReranker, Fallback, HashEmbedder, HttpEmbedder, HttpReranker, LateReranker, OverlapReranker, ProcessEmbedder, Retrying, Service
from tesserae.plans.errors import InvalidParams, NotFound, Unavailable

Factory = Callable[[dict], object]


@dataclass
class Registry:
    kind: str
    known: dict[str, tuple[Factory, str]] = field(default_factory=dict)

    def register(self, name: str, factory: Factory, about: str = "") -> None:
        """A later registration of a name replaces the earlier one."""
        if not name:
            raise InvalidParams(f"a {self.kind} needs a name")
        self.known[name] = (factory, about)

    def names(self) -> list[str]:
        return sorted(self.known)

    def describe(self) -> dict[str, str]:
        return {name: self.known[name][1] for name in self.names()}

    def create(self, settings: str | dict):
        """From a name, or an object whose 'type' is one; its other keys go to the factory."""
        settings = {"type": settings} if isinstance(settings, str) else settings
        if not isinstance(settings, dict) or not isinstance(settings.get("type"), str):
            raise InvalidParams(f"settings of a {self.kind} are a name or an object with 'type'")
        name = settings["type"]
        if name not in self.known:
            raise NotFound(f"no {self.kind} {name!r}; there are {', '.join(self.names())}")
        try:
            return self.known[name][0]({k: v for k, v in settings.items() if k != "type"})
        except (TypeError, ValueError, KeyError) as e:
            raise InvalidParams(f"{self.kind} {name!r}: {e!r}") from e


embedders, rerankers = Registry("embedder"), Registry("reranker")


def _service(c: dict, **default) -> Service:
    given = {k: c[k] for k in ("host", "port", "path", "tls", "api_key", "transport") if k in c}
    return Service(**(default | given | ({"seconds": c["timeout_ms"] / 1000} if "timeout_ms" in c else {})))


def _missing(name: str) -> Factory:
    def factory(_: dict):
        raise Unavailable(f"{name} needs a runtime that isn't part of this build")

    return factory


def _openai(host: str, path: str, model: str, dim: int) -> Factory:
    return lambda c: HttpEmbedder("openai", _service(c, host=host, port=443, tls=True, path=path), c.get("model", model), int(c.get("dim", dim)))


for _name, _factory, _about in [
    ("hash", lambda c: HashEmbedder(int(c.get("dim", 256))), "hashed words and word pairs (dim)"),
    ("ollama", lambda c: HttpEmbedder("ollama", _service(c, port=11434, path="/api/embed"), c.get("model", "nomic-embed-text"), int(c.get("dim", 768))), "a local Ollama server (host, port, model, dim, timeout_ms)"),
    ("openai", _openai("api.openai.com", "/v1/embeddings", "text-embedding-3-small", 1536), "an embeddings service in OpenAI's way (host, port, tls, path, model, api_key, dim)"),
    ("voyage", _openai("api.voyageai.com", "/v1/embeddings", "voyage-3", 1024), "Voyage AI (api_key, model, dim)"),
    ("together", _openai("api.together.xyz", "/v1/embeddings", "BAAI/bge-base-en-v1.5", 768), "Together AI (api_key, model, dim)"),
    ("tei", lambda c: HttpEmbedder("tei", _service(c, path="/embed"), "tei", int(c.get("dim", 0))), "a text-embeddings-inference server (host, port, dim)"),
    ("llamacpp", lambda c: HttpEmbedder("llamacpp", _service(c, port=8080, path="/embedding"), "llamacpp", int(c.get("dim", 0))), "a llama.cpp server (host, port, path, dim)"),
    ("process", lambda c: ProcessEmbedder(list(c["command"]), int(c["dim"]), c.get("identity", "process")), "a child process that speaks lines of JSON (command, dim)"),
    ("onnx", _missing("onnx"), "a model file; not in this build"),
    ("gguf", _missing("gguf"), "a model file; not in this build"),
    ("retry", lambda c: Retrying(embedders.create(c["inner"]), int(c.get("attempts", 3)), float(c.get("wait", 0.2))), "another one, asked again after failures on the way (inner, attempts, wait)"),
    ("fallback", lambda c: Fallback(embedders.create(c["first"]), embedders.create(c["second"])), "a second one for when the first is away (first, second)"),
]:
    embedders.register(_name, _factory, _about)

for _name, _factory, _about in [
    ("overlap", lambda c: OverlapReranker(), "share of the query's words"),
    ("colbert", lambda c: LateReranker(int(c.get("dim", 64))), "MaxSim of hashed token vectors (dim)"),
    ("cross_encoder", lambda c: HttpReranker(c.get("kind", "tei"), _service(c, path={"tei": "/rerank", "cohere": "/v1/rerank"}.get(c.get("kind", "tei"), "/v1/rerank")), c.get("model", "")), "a scoring service: tei, cohere or jina (kind, host, port, path, model, api_key)"),
    ("caching", lambda c: CachingReranker(rerankers.create(c["inner"]), int(c.get("most", 65536))), "another one, whose scores are kept (inner, most)"),
    ("onnx", _missing("onnx"), "a model file; not in this build"),
]:
    rerankers.register(_name, _factory, _about)


def load_plugin(module: str) -> None:
    """Import a module and call its register(embedders, rerankers)."""
    try:
        found = importlib.import_module(module)
    except ImportError as e:
        raise NotFound(f"plugin {module}: {e}") from e
    if not callable(getattr(found, "register", None)):
        raise InvalidParams(f"plugin {module} has no register()")
    found.register(embedders, rerankers)

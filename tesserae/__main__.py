"""python -m tesserae index|query|eval|info|list"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae import registry
from tesserae.engine import CorpusConfig, Engine, Pipeline
from tesserae.operators import evaluate
from tesserae.plans.errors import EngineError
from tesserae.sources.files import formats, read_benchmark, read_directory
from tesserae.sources.rows import read_csv

TABLES = (".csv", ".tsv", ".tab")


def suffixes(given: list[str]) -> list[str] | None:
    """'.md', 'md', '*.md' and '.md,.rst' alike."""
    parts = [p.strip().lstrip("*").lstrip(".").lower() for g in given for p in g.split(",")]
    return [p for p in parts if p] or None


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tesserae")
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="a directory, or a table of rows, into an index")
    index.add_argument("source")
    index.add_argument("index")
    how = index.add_mutually_exclusive_group()
    for name in ("semantic", "proposition", "source"):
        how.add_argument(f"--{name}", dest="chunking", action="store_const", const=name)
    index.add_argument("--contextual", action="store_true")
    index.add_argument("--ext", action="append", default=[])
    index.add_argument("--csv-id", default="")
    index.add_argument("--embedder", default="")
    query = sub.add_parser("query", help="search an index")
    query.add_argument("index")
    query.add_argument("text")
    query.add_argument("-k", type=int, default=10)
    query.add_argument("--pipeline", choices=("standard", "quality", "context", "best"), default="standard")
    query.add_argument("--embedder", default="")
    measure = sub.add_parser("eval", help="metrics of a benchmark folder: corpus.jsonl, queries.jsonl, qrels/")
    measure.add_argument("benchmark")
    measure.add_argument("--split", default="test")
    measure.add_argument("--embedder", default="")
    info = sub.add_parser("info", help="counts of an index")
    info.add_argument("index")
    sub.add_parser("list", help="embedders, rerankers and file formats")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    a = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return COMMANDS[a.command](a, spark, out)
    except EngineError as e:
        out(f"error: {e.code}: {e}")
        return 1


def cmd_index(a, spark: SparkSession, out) -> int:
    engine = Engine(spark, CorpusConfig(chunking=a.chunking or "fixed", contextual=a.contextual))
    if a.embedder:
        engine.with_embedder(a.embedder)
    if a.source.lower().endswith(TABLES):
        docs = read_csv(spark, a.source).filter("error is null").select("uri", "text", "meta")
        if a.csv_id:
            docs = docs.withColumn("uri", F.concat(F.lit(f"{a.source}#"), F.col("meta")[a.csv_id]))
    else:
        docs = read_directory(spark, a.source, suffixes(a.ext)).filter("error is null")
    engine.add(docs).build()
    epoch, n = engine.save(a.index), engine.corpus.counts()
    out(f"{n['documents']} documents, {n['chunks']} chunks in {a.index}, epoch {epoch}")
    return 0


def cmd_query(a, spark: SparkSession, out) -> int:
    engine = Engine.open(spark, a.index).with_pipeline(getattr(Pipeline, a.pipeline)())
    if a.embedder:
        engine.with_embedder(a.embedder).build()
    for r in engine.search(a.text, a.k):
        out(f"{r.rank}. {r.score:.4f} {r.uri}:{r.start_line or 0} {' '.join(r.text.split())[:120]}")
    return 0


def cmd_eval(a, spark: SparkSession, out) -> int:
    corpus, queries, qrels = read_benchmark(spark, a.benchmark, a.split)
    engine = Engine(spark)
    if a.embedder:
        engine.with_embedder(a.embedder)
    engine.add(corpus.select(F.col("doc_id").cast("string").alias("uri"), "text")).build()
    hits = engine.search_many(queries.select("query_id", "text"), 100)
    best = hits.groupBy("query_id", F.col("uri").alias("doc_id")).agg(F.min("rank").alias("rank"))
    out(evaluate.report(evaluate.evaluate(best, qrels.withColumn("doc_id", F.col("doc_id").cast("string")))))
    return 0


def cmd_info(a, spark: SparkSession, out) -> int:
    engine = Engine.open(spark, a.index)
    for name, n in (engine.corpus.counts() | {"terms": engine.corpus.index.term_stats.count(), "vectors": 0 if engine.corpus.embeddings is None else engine.corpus.embeddings.count()}).items():
        out(f"{name:<12}{n:>10}")
    return 0


def cmd_list(a, spark: SparkSession, out) -> int:
    for kind, known in (("embedder", registry.embedders), ("reranker", registry.rerankers)):
        for name, about in known.describe().items():
            out(f"{kind:<10}{name:<15}{about}")
    for r in formats(spark).collect():
        out("format    " + " ".join(str(x) for x in r))
    return 0


COMMANDS = {"index": cmd_index, "query": cmd_query, "eval": cmd_eval, "info": cmd_info, "list": cmd_list}

if __name__ == "__main__":
    sys.exit(main())

"""Retrieval by a service elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tesserae.functions.embedders import Service
from tesserae.operators.lexical import ranked
from tesserae.plans.errors import ParseError


def search(queries: DataFrame, service: Service, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank) of queries (query_id, text): each is sent as {"query", "k"}, and answered with
    {"hits": [{"id", "score"}]}, ids of chunks as numbers. Null and empty texts aren't sent. An answer of another form is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, text in zip(batch["query_id"], batch["text"]):
                if not text:
                    continue
                said = service.ask({"query": text, "k": k})
                hits = said.get("hits") if isinstance(said, dict) else None
                try:
                    rows += [(query_id, int(h["id"]), float(h["score"])) for h in hits]
                except (TypeError, KeyError, ValueError) as e:
                    raise ParseError("the service gives no hits") from e
            yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "score"]).astype({"query_id": "int64", "chunk_id": "int64", "score": "float64"})

    found = queries.select("query_id", "text").mapInPandas(run, "query_id long, chunk_id long, score double")
    return ranked(found.groupBy("query_id", "chunk_id").agg({"score": "max"}).withColumnRenamed("max(score)", "score"), k).select("query_id", "chunk_id", "score", "rank")

"""Learned-sparse style retrieval: tf-idf impacts, and expansion by terms that occur together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.lexical import Index, query_terms, scanned, small
from tesserae.plans.storage import written


@dataclass
class SparseIndex:
    """impacts (term, chunk_id, w), neighbours (term, other, weight); near(terms) are the neighbours of some."""

    impacts: DataFrame
    neighbours: DataFrame
    base: Index
    near: Callable[[DataFrame], DataFrame]


def build(index: Index, most_terms: int = 64, neighbours: int = 3) -> SparseIndex:
    """Impact = ln(1 + tf) * idf. Neighbours of a term: the `neighbours` terms of largest together / sqrt(df * df + 1), counted in
    chunks of at most most_terms distinct terms."""
    impacts = index.postings.join(index.term_stats, "term").select("term", "chunk_id", (F.log1p("tf") * F.col("idf")).alias("w"))
    few = index.bags.filter((F.size("terms") > 0) & (F.size("terms") <= most_terms)).select("terms")

    def near(wanted: DataFrame | None) -> DataFrame:
        """Terms that stand beside each of wanted (term); beside all without."""
        left = few.select(F.explode("terms").alias("term"), "terms")
        if wanted is not None:
            left = left.join(small(wanted.select("term").distinct()), "term", "left_semi")
        pairs = left.select("term", F.explode("terms").alias("other")).filter("term <> other").groupBy("term", "other").agg(F.count("*").alias("together"))
        df = index.term_stats.select("term", "df")
        own = df if wanted is None else small(df.join(small(wanted.select("term").distinct()), "term", "left_semi"))
        weighed = pairs.join(own, "term").join(df.select(F.col("term").alias("other"), F.col("df").alias("df_other")), "other")
        weighed = weighed.select("term", "other", (F.col("together") / F.sqrt(F.col("df") * F.col("df_other") + 1)).alias("weight"))
        order = Window.partitionBy("term").orderBy(F.round("weight", 9).desc(), "other")
        return weighed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= neighbours).drop("place")

    return SparseIndex(impacts, near(None), index, near)


def encode(index: SparseIndex, queries: DataFrame, expand: bool = True, share: float = 0.35) -> DataFrame:
    """(query_id, term, w) with w = ln(1 + qtf) * idf; expansion adds neighbours at share * w * weight where that is more."""
    own = index.base.term_stats.join(small(query_terms(index.base, queries)), "term").select("query_id", "term", (F.log1p("qtf") * F.col("idf")).alias("w"))
    if not expand:
        return own
    own = written(own, "query_weights")
    more = own.join(index.near(own), "term").select("query_id", F.col("other").alias("term"), (share * F.col("w") * F.col("weight")).alias("w"))
    return own.unionByName(more).groupBy("query_id", "term").agg(F.max("w").alias("w"))


def search(index: SparseIndex, queries: DataFrame, k: int = 10, expand: bool = True) -> DataFrame:
    q = encode(index, queries, expand).join(index.base.term_stats, "term").select("query_id", "term", (F.col("w") * F.col("idf")).alias("qw"), "df")
    return scanned(index.base.bags, q, k, index.base.stats.first()["n"], lambda tf, dl: np.log1p(tf))

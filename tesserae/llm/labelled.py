"""Labelled documents, for fitting: a bounded sample, or the best threshold over all of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import drop, written


def largest(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): of each document the largest of its labels 0 and 1; null labels and doc_ids are left out."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    return one.groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> pd.DataFrame:
    """(doc_id, text, y): of each class the per_class documents whose doc_ids hash lowest, texts whole, in order of doc_id.

    A document with several labels has the largest of them; null labels, doc_ids and texts are left out. Only the
    chosen doc_ids, at most twice per_class, are broadcast.
    """
    one = largest(labels, label)
    low = [one.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(low[0].union(low[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(chosen, "doc_id").toPandas()
    return rows.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)


def cut_rows(scored: DataFrame, none: float, every: float) -> float:
    """toxicity.cut() of a table (score, y) of any size, exactly; `none` where no y is 1, `every` where all are.

    Scores lie in ranges in falling order; counts run on from one range to the next, so that no task has them all.
    """
    counts = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
    counts = written(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.max("score").alias("top")).orderBy("part").collect()
    n, hit = sum(p.n for p in parts), sum(p.hit for p in parts)
    if hit in (0, n):
        drop(counts)
        return every if hit else none
    starts, n0, hit0 = [], 0, 0
    for p, after in zip(parts, [*[p.top for p in parts[1:]], 0.0]):
        starts.append((p.part, n0, hit0, after))
        n0, hit0 = n0 + p.n, hit0 + p.hit
    falling = Window.partitionBy("part").orderBy(F.desc("score"))
    to_here = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.join(F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, n0 long, hit0 long, after double")), "part").select(
        "score",
        F.coalesce(F.lead("score").over(falling), "after").alias("lower"),
        (2 * (F.col("hit0") + F.sum("hit").over(to_here)) / (F.col("n0") + F.sum("n").over(to_here) + hit)).alias("f1"),
    )
    best = rows.agg(F.max("f1")).first()[0]
    row = rows.filter(F.col("f1") >= best - 1e-12).orderBy(F.desc("score")).first()
    drop(counts)
    return (row.score + row.lower) / 2

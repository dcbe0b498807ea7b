"""Reordering and thinning of hits (query_id, chunk_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.hashing import token_matrices
from tesserae.functions.text import jaccard, sentences, tokens
from tesserae.operators import lexical
from tesserae.operators.lexical import Index, ranked

HITS = "query_id long, chunk_id long, score double, rank int"

def per_query():
    return Window.partitionBy("query_id")



def scaled(column: str = "score") -> Column:
    """Between the query's least and largest; 1 where they are equal."""
    lo, hi = F.min(column).over(per_query()), F.max(column).over(per_query())
    return F.when(hi - lo > 1e-9, (F.col(column) - lo) / (hi - lo)).otherwise(1.0)


def feature_rerank(hits: DataFrame, index: Index, queries: DataFrame, weight: float = 0.1) -> DataFrame:
    """(1 - weight) * scaled score + weight * share of distinct query terms that the chunk has."""
    seen = lexical.coverage(index, queries, hits)
    base = hits.withColumn("base", scaled()).join(seen, ["query_id", "chunk_id"])
    share = F.when(F.col("terms") > 0, F.col("covered") / F.col("terms")).otherwise(0.0)
    return ranked(base.select("query_id", "chunk_id", ((1 - weight) * F.col("base") + weight * share).alias("score")), None)


def rescore(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Ranks by a callback's scores (query_id, chunk_id, score)."""
    return ranked(hits.select("query_id", "chunk_id").join(scores, ["query_id", "chunk_id"]), None)


def cross_encode(hits: DataFrame, passages: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column], top_n: int = 50, blend: float = 0.5) -> DataFrame:
    """The first top_n by blend * scaled scorer(query, passage) + (1 - blend) * scaled score, equals in their old order; the
    rest follow as they were."""
    block = passages.select("chunk_id", F.col("text").alias("passage")).join(lexical.small(hits.filter(F.col("rank") <= top_n)), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    both = block.withColumn("ce", scorer(F.col("query"), F.col("passage")).cast("double")).withColumn("a", scaled("ce")).withColumn("b", scaled("score"))
    mixed = both.select("query_id", "chunk_id", (blend * F.col("a") + (1 - blend) * F.col("b")).alias("score"), F.col("rank").alias("old"))
    head = mixed.withColumn("rank", F.row_number().over(per_query().orderBy(F.round("score", 6).desc(), "old"))).select("query_id", "chunk_id", "score", "rank")
    tail = hits.filter(F.col("rank") > top_n).select("query_id", "chunk_id", "score", "rank")
    return head.unionByName(tail)


def overlap_scorer(query: Column, passage: Column) -> Column:
    """A scorer without a model: share of the query's distinct tokens that the passage has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(passage))) / F.size(q)).otherwise(0.0)


def maxsim_score(q: np.ndarray, d: np.ndarray) -> float:
    """Sum over the rows of q of the largest dot product with a row of d, not below 0; 0 for matrices of different widths."""
    if not len(q) or not len(d) or q.shape[1] != d.shape[1]:
        return 0.0
    return float(np.maximum((q @ d.T).max(1), 0).sum())


def maxsim(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, chunk_id, q_tokens, d_tokens: arrays of vectors) with score, a matrix product a pair."""

    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        of = lambda m: np.stack([np.asarray(v, float) for v in m]) if m is not None and len(m) and len({len(v) for v in m}) == 1 else np.zeros((0, 0))
        return pd.Series([maxsim_score(of(a), of(b)) for a, b in zip(q, d)], dtype=float)

    return pairs.withColumn("score", F.pandas_udf(run, "double")("q_tokens", "d_tokens"))


def late_rerank(hits: DataFrame, passages: DataFrame, queries: DataFrame, embed: Callable[[list], list[np.ndarray]] = token_matrices, top_n: int = 100) -> DataFrame:
    """The first top_n hits by MaxSim. embed: texts to token matrices, called on the distinct texts of an Arrow batch, so that
    matrices are never rows of a table."""

    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        qc, asked = pd.factorize(q.fillna(""))
        dc, texts = pd.factorize(d.fillna(""))
        qm, out = embed(list(asked)), np.zeros(len(q))
        order = np.argsort(dc, kind="stable")
        edge = np.searchsorted(dc[order], np.arange(len(texts) + 1))
        for lo in range(0, len(texts), 32):  # so many texts' matrices at a time
            for k, m in enumerate(embed(list(texts[lo : lo + 32])), lo):
                for i in order[edge[k] : edge[k + 1]]:
                    out[i] = maxsim_score(qm[qc[i]], m)
        return pd.Series(out)

    head = hits.filter(F.col("rank") <= top_n).select("query_id", "chunk_id")
    both = passages.select("chunk_id", F.col("text").alias("d")).join(lexical.small(head), "chunk_id").join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    return ranked(both.select("query_id", "chunk_id", F.pandas_udf(run, "double")("q", "d").alias("score")), None)


def _similarities(pdf: pd.DataFrame) -> np.ndarray:
    """Cosines if every row has an embedding, else Jaccard indices of their token sets."""
    n = len(pdf)
    if pdf["embedding"].map(lambda v: v is not None and len(v) > 0).all() and pdf["embedding"].map(len).nunique() == 1:
        m = np.stack(pdf["embedding"].map(np.asarray)).astype(float)
        return m @ m.T
    bags = [set(t) if t is not None else set() for t in pdf["terms"]]
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            both = len(bags[i] & bags[j])
            out[i, j] = out[j, i] = both / (len(bags[i]) + len(bags[j]) - both) if both else 0.0
    return out


def _pool(hits: DataFrame, passages: DataFrame) -> DataFrame:
    embedding = F.col("embedding") if "embedding" in passages.columns else F.lit(None).cast("array<float>")
    found = passages.select("chunk_id", "text", embedding.alias("embedding")).join(lexical.small(hits.select("query_id", "chunk_id", "score", "rank")), "chunk_id")
    return found.select("chunk_id", "query_id", "score", "rank", F.array_distinct(tokens(F.col("text"))).alias("terms"), "embedding")


def _per_query(hits: DataFrame, passages: DataFrame, pick: Callable[[np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        s = pdf["score"].to_numpy(float)
        order = pick(s, _similarities(pdf))
        out = pdf.loc[order, ["query_id", "chunk_id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return _pool(hits, passages).groupBy("query_id").applyInPandas(run, HITS)


def _unit(s: np.ndarray) -> np.ndarray:
    span = s.max() - s.min()
    return (s - s.min()) / (span if span > 1e-9 else 1.0)


def mmr_order(s: np.ndarray, sim: np.ndarray, relevance: float = 0.5, k: int | None = None) -> list[int]:
    rel, near = _unit(s), np.zeros(len(s))
    left, out = np.ones(len(s), bool), []
    while left.any() and len(out) < (k or len(s)):
        value = np.round(relevance * rel - (1 - relevance) * (near if out else 0), 9)  # equals stay equal, however they were summed
        i = int(np.argmax(np.where(left, value, -np.inf)))
        left[i] = False
        out.append(i)
        near = np.maximum(near, sim[i]) if len(out) > 1 else sim[i].copy()
    return out


def mmr(hits: DataFrame, passages: DataFrame, relevance: float = 0.5, k: int | None = None) -> DataFrame:
    """Maximal marginal relevance: relevance * scaled score - (1 - relevance) * largest similarity to what is chosen.

    Scores stay as they are; equals go to the one of lower rank. Pools are of one query, some hundred rows.
    """
    return _per_query(hits, passages, lambda s, sim: mmr_order(s, sim, relevance, k))


def dartboard_order(s: np.ndarray, sim: np.ndarray, relevance: float = 0.7, sigma: float = 0.5, k: int | None = None) -> list[int]:
    rel = _unit(s)
    aim = np.exp(rel / max(sigma, 1e-6))
    aim /= aim.sum()
    sim = sim.copy()
    np.fill_diagonal(sim, 1.0)
    covered, left, out = np.zeros(len(s)), np.ones(len(s), bool), []
    while left.any() and len(out) < (k or len(s)):
        gain = np.maximum(sim - covered[None, :], 0) @ aim
        i = int(np.argmax(np.where(left, np.round(relevance * rel + (1 - relevance) * gain, 9), -np.inf)))
        left[i] = False
        out.append(i)
        covered = np.maximum(covered, sim[i])
    return out


def dartboard(hits: DataFrame, passages: DataFrame, relevance: float = 0.7, sigma: float = 0.5, k: int | None = None) -> DataFrame:
    """Chooses by own relevance and by how much a hit adds to the cover of all hits, each weighed by its likelihood."""
    return _per_query(hits, passages, lambda s, sim: dartboard_order(s, sim, relevance, sigma, k))


def distinct_order(sim: np.ndarray, threshold: float, window: int = 0) -> list[int]:
    n, kept = len(sim), []
    window = n if window == 0 else min(window, n)
    for i in range(window):
        if not any(sim[i, j] >= threshold for j in kept):
            kept.append(i)
    return kept + list(range(window, n))


def fold_duplicates(hits: DataFrame, passages: DataFrame, threshold: float = 0.92, window: int = 0) -> DataFrame:
    """Drops a hit that is as similar as threshold to one kept before it, among the first `window` hits (0: all)."""
    return _per_query(hits, passages, lambda s, sim: distinct_order(sim, threshold, window))


def autocut(hits: DataFrame, min_keep: int = 3, factor: float = 2.0) -> DataFrame:
    """Cuts before the first fall of score, after min_keep hits, of at least `factor` times the mean fall of the list.

    Lists of fewer than 3 hits, of no more than min_keep, or without any fall stay whole. Scores that differ by 1e-9 at most
    are equal: sums of the same parts in another order don't make a fall.
    """
    order = per_query().orderBy("rank")
    gaps = hits.withColumn("gap", F.lag("score").over(order) - F.col("score")).withColumn("n", F.count("*").over(per_query()))
    mean = F.avg(F.when(F.col("gap") > 1e-9, F.col("gap"))).over(per_query())
    over = (F.col("rank") > min_keep) & (F.col("n") >= 3) & (F.col("gap") >= factor * F.col("mean"))
    cut = F.min(F.when(over, F.col("rank"))).over(per_query())
    return gaps.withColumn("mean", mean).withColumn("cut", cut).filter(F.col("cut").isNull() | (F.col("rank") < F.col("cut"))).select("query_id", "chunk_id", "score", "rank")


def stitch(hits: DataFrame, chunks: DataFrame, max_gap: int = 1) -> DataFrame:
    """Drops a hit whose chunk lies within max_gap lines of a kept, better one of its document."""
    side = chunks.select("chunk_id", "doc_id", "start_line", "end_line").join(lexical.small(hits), "chunk_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[int, list[tuple[int, int]]] = {}
        rows = []
        for r in pdf.sort_values("rank").itertuples(index=False):
            spans = kept.setdefault(r.doc_id, [])
            if any(max(a - r.end_line, r.start_line - b, 0) <= max_gap for a, b in spans):
                continue
            spans.append((r.start_line, r.end_line))
            rows.append((r.query_id, r.chunk_id, r.score, len(rows) + 1))
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "score", "rank"]).astype({"rank": "int32"})

    return side.groupBy("query_id").applyInPandas(run, HITS)


def cascade(retrieved: DataFrame, passages: DataFrame, queries: DataFrame, late: Callable[[list], list[np.ndarray]] | None = None, scorer=None, budgets: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Retrieve, then late interaction, then the scorer, on ever fewer hits; and a trace (stage, given, kept)."""
    b = {"retrieve": 200, "late_in": 150, "late_out": 50, "cross_in": 40, "cross_out": 20, "final": 10} | (budgets or {})
    now = retrieved.filter(F.col("rank") <= b["retrieve"])
    steps = [("retrieve", retrieved, now)]
    if late is not None:
        out = late_rerank(now, passages, queries, late, b["late_in"]).filter(F.col("rank") <= b["late_out"])
        steps.append(("late", now, out))
        now = out
    if scorer is not None:
        out = cross_encode(now.filter(F.col("rank") <= b["cross_in"]), passages, queries, scorer, b["cross_in"], 1.0).filter(F.col("rank") <= b["cross_out"])
        steps.append(("cross", now, out))
        now = out
    final = now.filter(F.col("rank") <= b["final"])
    steps.append(("final", now, final))
    trace = None
    for k, (name, given, kept) in enumerate(steps):
        line = given.agg(F.count("*").alias("given")).crossJoin(kept.agg(F.count("*").alias("kept"))).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "given", "kept")
        trace = line if trace is None else trace.unionByName(line)
    return final, trace


def correct(hits: DataFrame, index: Index, queries: DataFrame, upper: float = 0.6, lower: float = 0.3, keep: int = 3, relevance: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """Corrective grading: (query_id, chunk_id, relevance, confidence, action, source).

    relevance = 0.75 scaled score + 0.25 coverage, or as given (query_id, chunk_id, relevance); confidence is the query's
    largest; action is correct from `upper`, incorrect to `lower`, else ambiguous. The best `keep` above `lower` stay. An
    incorrect query takes `external` (query_id, chunk_id) instead, an ambiguous one takes it as well.
    """
    if relevance is None:
        seen = lexical.coverage(index, queries, hits)
        share = F.when(F.col("terms") > 0, F.col("covered") / F.col("terms")).otherwise(0.0)
        graded = hits.withColumn("base", scaled()).join(seen, ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.75 * F.col("base") + 0.25 * share)).alias("relevance"))
    else:
        graded = hits.select("query_id", "chunk_id").join(relevance, ["query_id", "chunk_id"])
    sure = queries.select("query_id").join(graded.groupBy("query_id").agg(F.max("relevance").alias("confidence")), "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    action = F.when(F.col("confidence") >= upper, "correct").when(F.col("confidence") <= lower, "incorrect").otherwise("ambiguous")
    acted = sure.withColumn("action", action)
    order = per_query().orderBy(F.round("relevance", 6).desc(), "chunk_id")
    own = graded.filter(F.col("relevance") > lower).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).drop("place").join(acted, "query_id").filter("action <> 'incorrect'").withColumn("source", F.lit("corpus"))
    if external is None:
        return own.select("query_id", "chunk_id", "relevance", "confidence", "action", "source")
    added = external.select("query_id", "chunk_id").join(acted.filter("action <> 'correct'"), "query_id").select("query_id", "chunk_id", F.lit(None).cast("double").alias("relevance"), "confidence", "action", F.lit("external").alias("source"))
    return own.select(added.columns).unionByName(added)


def support(answers: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(query_id, support): share of each answer's sentences of which at least half the tokens occur in the query's knowledge.

    A sentence without tokens counts among all sentences only; an answer without sentences scores 0.
    """
    bag = knowledge.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).distinct()
    said = answers.select("query_id", F.posexplode(sentences(F.col("text"), 6)).alias("s", "sentence"))
    terms = said.select("query_id", "s", F.explode(tokens(F.col("sentence"))).alias("term"))
    held = terms.join(bag.withColumn("in_bag", F.lit(1)), ["query_id", "term"], "left").groupBy("query_id", "s").agg(F.avg(F.coalesce("in_bag", F.lit(0))).alias("share"))
    marked = said.select("query_id", "s").join(held, ["query_id", "s"], "left").groupBy("query_id").agg(F.avg(F.when(F.col("share") >= 0.5, 1.0).otherwise(0.0)).alias("support"))
    return answers.select("query_id").distinct().join(marked, "query_id", "left").select("query_id", F.coalesce("support", F.lit(0.0)).alias("support"))


def ensemble_weights(hits: DataFrame, temperature: float = 1.0) -> DataFrame:
    """hits with weight: softmax of score / temperature within each query."""
    e = F.exp((F.col("score") - F.max("score").over(per_query())) / F.lit(float(temperature)))
    return hits.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(per_query())).drop("e")


def mix_distributions(weighted: DataFrame) -> DataFrame:
    """weighted (query_id, weight, dist: array<double>) as (query_id, slot, p): the weighted sum by slot, short rows as 0 there."""
    return weighted.select("query_id", "weight", F.posexplode("dist").alias("slot", "x")).groupBy("query_id", "slot").agg(F.sum(F.col("weight") * F.col("x")).alias("p"))


def prompt(hits: DataFrame, passages: DataFrame, queries: DataFrame, instruction: str = "Answer the question using only the context.") -> DataFrame:
    """(query_id, prompt): instruction, numbered passages in order of rank, question."""
    parts = passages.select("chunk_id", "text").join(lexical.small(hits), "chunk_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("p"))
    context = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n")
    return queries.join(parts, "query_id", "left").select("query_id", F.concat(F.lit(instruction + "\n\nContext:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), "text", F.lit("\nAnswer:")).alias("prompt"))


def similarity_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))

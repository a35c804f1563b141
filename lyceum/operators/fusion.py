"""Fusing, reranking and evaluating ranked lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
RANK_CONSTANT, WINDOW_SIZE, TOP_K = 60, 50, 5


def rrf(ranked: DataFrame, rank_constant: int = RANK_CONSTANT, window: int = WINDOW_SIZE, top_k: int = TOP_K) -> DataFrame:
    """Reciprocal rank fusion of (backend, query_id, doc_id, rank): query_id, rank, doc_id, score (12 places), components."""
    part = (F.lit(1.0) / (F.col("rank") + rank_constant)).alias("part")
    fused = ranked.where(F.col("rank") <= window).select("query_id", "doc_id", "backend", "rank", part)
    fused = fused.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"), F.array_sort(F.collect_list(F.struct("backend", "rank"))).alias("components"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", "score", "components")


def rerank(pool: DataFrame, scores: DataFrame, top_k: int | None = None) -> DataFrame:
    """The pool (query_id, doc_id, rank) in the order of new scores (query_id, doc_id, new_score); ties keep the pool's order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank", "doc_id")
    out = pool.join(scores, ["query_id", "doc_id"]).withColumn("new_rank", F.row_number().over(order))
    return out.where(F.col("new_rank") <= top_k) if top_k else out


def pool_mismatch(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows that only one side has: a reranker must score exactly the pool."""
    side = pool.select("query_id", "doc_id", F.lit(1).alias("p")).join(scores.select("query_id", "doc_id", F.lit(1).alias("s")), ["query_id", "doc_id"], "full_outer")
    return side.where("p is null or s is null").select("query_id", "doc_id", F.when(F.col("p").isNull(), "unknown").otherwise("unscored").alias("problem"))


def top_k_stability(repeats: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """One row: queries, stable queries and their share; stable means that all repeats have the same set of top documents."""
    sets = repeats.where(F.col("rank") <= top_k).groupBy("query_id", "repeat").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    stable = sets.groupBy("query_id").agg((F.count_distinct("docs") == 1).alias("stable"))
    return stable.agg(F.count("*").alias("queries"), F.count_if("stable").alias("stable"), F.coalesce(F.round(F.avg(F.col("stable").cast("int")), 6), F.lit(0.0)).alias("share"))


def query_metrics(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Recall at 1 and 5, hit at 1 and 5, reciprocal rank, hard-negative intrusion, false accepts and misses of every gold query.

    `gold` is (query_id, answerable, relevant array, hard_negative array), `hits` (query_id, rank, unit_ids array).
    An unanswerable query has nothing to find: it only counts as a false accept or an abstention.
    """
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_ids"))).alias("hits"))
    rows = gold.join(lists, "query_id", "left")
    top = lambda k: F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda h: h["rank"] <= k), lambda h: h["unit_ids"])))
    n = F.size("relevant")
    asked = F.col("answerable")
    recall = lambda k: F.when(asked & (n > 0), F.coalesce(F.size(F.array_intersect(top(k), "relevant")), F.lit(0)) / n).otherwise(0.0)
    first = F.array_min(F.transform(F.filter("hits", lambda h: F.arrays_overlap(h["unit_ids"], F.col("relevant"))), lambda h: h["rank"]))
    some = F.coalesce(F.size("hits") > 0, F.lit(False))
    return rows.select(
        "query_id", "answerable",
        F.round(recall(1), 6).alias("recall_1"), F.round(recall(5), 6).alias("recall_5"), (recall(1) > 0).cast("int").alias("hit_1"), (recall(5) > 0).cast("int").alias("hit_5"),
        F.coalesce(F.round(F.when(asked, 1 / first), 6), F.lit(0.0)).alias("reciprocal_rank"),
        (asked & F.coalesce(F.arrays_overlap(top(5), F.col("hard_negative")), F.lit(False))).cast("int").alias("intrusion"),
        (~F.col("answerable") & some).cast("int").alias("false_accept"), (F.col("answerable") & ~some).cast("int").alias("missing"), (~some).cast("int").alias("abstained"),
    )


def nearest_rank(df: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """Nearest-rank percentile of each group, nothing for an empty one."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias("percentile"))


#: Rows and queries of a block of the comparison, on average.
ROW_BLOCK, QUERY_BLOCK = 16_384, 4_096


def dense_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows (vec_id, embedding) of each query (query_id, query) by cosine, rounded to six places; a row is not its own neighbour.

    Rows and queries are dealt to blocks by hash; each pair of blocks is one matrix product, of which
    only the k best of each query (and what ties with the last) leave. Nothing is broadcast, and a
    task holds one block of either side. Null vectors have no neighbours and are none.
    """
    rows, queries = rows.where("embedding is not null"), queries.where("query is not null")
    many = lambda df, size: max(1, -(-df.count() // size))
    n, m = many(rows, ROW_BLOCK), many(queries, QUERY_BLOCK)
    block = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    left = rows.select("vec_id", "embedding", block("vec_id", n).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    right = queries.select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), block("query_id", m).alias("j"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = (np.array(t.column(c).to_pylist(), np.float64) for t, c in ((a, "embedding"), (b, "query")))
        vec, ask = a.column("vec_id").to_numpy(), b.column("query_id").to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round((q @ x.T) / np.sqrt(np.outer((q * q).sum(1), (x * x).sum(1))), 6)
        score[(ask[:, None] == vec[None, :]) | np.isnan(score)] = -np.inf
        last = np.partition(score, -min(k, len(vec)), axis=1)[:, -min(k, len(vec))]
        r, c = np.nonzero((score >= last[:, None]) & (score > -np.inf))
        return pa.table({"query_id": ask[r], "vec_id": vec[c], "score": score[r, c]})

    scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Inverted index and BM25 retrieval with an abstain gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions.text import informative, snippet, tokenize

# The scoring constants.
K1, B, TOP_K = 1.5, 0.75, 4
#: Query tokens up to which the query side is broadcast.
BROADCAST_TOKENS = 200_000


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, doc_id, tf)."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokenize(F.col(text))).alias("token"))
    return tokens.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, len): tokens of each document, none for an empty one."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(tokenize(F.col(text))).cast("long").alias("len"))


def index_stats(lengths: DataFrame) -> DataFrame:
    """(n_docs, avgdl): one row; the average is rounded to three places before it is used."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.round(F.avg("len"), 3), F.lit(0.0)).alias("avgdl"))


def query_tokens(queries: DataFrame, query_id: str, text: str, glossary: DataFrame | None = None) -> DataFrame:
    """(query_id, tokens): informative tokens, and after them those that a glossary (src, dst) ties to them."""
    out = queries.select(F.col(query_id).alias("query_id"), informative(tokenize(F.col(text))).alias("tokens"))
    if glossary is None:
        return out
    edges = glossary.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dst"))
    each = out.select("query_id", F.posexplode("tokens").alias("pos", "src")).join(F.broadcast(edges), "src", "left")
    grown = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("all"))
    more = F.flatten(F.filter(F.transform("all", lambda x: x["dst"]), lambda x: x.isNotNull()))
    grown = grown.select("query_id", F.array_distinct(more).alias("more"))
    return out.join(grown, "query_id", "left").select("query_id", F.when(F.col("more").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array_except("more", "tokens"))).alias("tokens"))


def glossary_edges(terms: DataFrame) -> DataFrame:
    """(src, dst): tokens of each term of a group, tied to the tokens of the group's other terms; `terms` is (term, others)."""
    group = terms.select(F.concat(F.array("term"), "others").alias("group")).select(F.transform("group", tokenize).alias("group"))
    left = group.select("group", F.posexplode("group").alias("i", "src")).select("group", "i", F.explode("src").alias("src"))
    right = left.select("i", "src", F.posexplode("group").alias("j", "dst")).where("i <> j")
    return right.select("src", F.explode("dst").alias("dst")).distinct()


def bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for documents that share a token with a query.

    Query tokens are few beside the postings, so they go to the postings, which are never moved
    for tokens that no query asks for; only the matching ones are joined with their document.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    wanted = asked.select("token").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TOKENS else wanted
    found = postings.join(wanted, "token", "left_semi")
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    stats = F.broadcast(index_stats(lengths))
    length = F.greatest(F.col("len"), F.lit(1))
    each = found.join(df, "token").join(lengths, "doc_id").crossJoin(stats)
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    each = each.select("token", "doc_id", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length / norm))).alias("part"))
    return each.join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def top_k(scores: DataFrame, k: int = TOP_K, min_score: float = 0.0) -> DataFrame:
    """The k best documents of each query (ties: the lower id), then those below the least score go."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))
    return ranked.where(F.col("score") >= min_score)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, min_score: float = 0.0, query_id: str = "query_id", text: str = "text", glossary: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score (four places) and snippet of each hit."""
    asked = query_tokens(queries, query_id, text, glossary)
    hits = top_k(bm25(postings(docs), doc_lengths(docs), asked), k, min_score)
    out = hits.join(asked, "query_id").join(docs.select("doc_id", "text"), "doc_id")
    return out.select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"), snippet(F.col("text"), F.col("tokens")).alias("snippet"))


def abstentions(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, abstain): a query without a hit abstains."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.col("n_hits").isNull().alias("abstain"))

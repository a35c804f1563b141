"""Queries of the corpus families: retrieval, cleaning, quality, duplicates, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.functions import quality as q
from lyceum.functions import text as t
from lyceum.operators import chunking, duplicates, fusion, retrieval, sessions
from lyceum.session import prepare, stored, table

#: Words of a benchmark passage that ask the query; the passage's tokens beyond them are its answer.
QUESTION_WORDS = 12
#: Runs of words of the passages up to which they are broadcast to the documents.
BROADCAST_RUNS = 2_000_000
GLOSSARY = [("the", ["der", "le"]), ("and", ["und", "et"]), ("tion", ["ción"])]

TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9\-'']*')"
STOP = "[" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + "]"
BLANK = r"[ \t\n\r\f\v]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(prepare(spark), sf_dir, "documents")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage asks with its first words."""
    words = F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, QUESTION_WORDS)
    return table(prepare(spark), sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and occurrences of every token."""
    p = retrieval.postings(_docs(spark, sf_dir))
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def index_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every document in tokens."""
    return retrieval.doc_lengths(_docs(spark, sf_dir))


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents and their mean length."""
    return retrieval.index_stats(retrieval.doc_lengths(_docs(spark, sf_dir)))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark question."""
    hits = retrieval.search(_docs(spark, sf_dir), _questions(spark, sf_dir), k=5)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 3).alias("score"))


def bm25_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents with the window around the first hit."""
    return retrieval.search(_docs(spark, sf_dir), _questions(spark, sf_dir), k=1).select("query_id", "doc_id", "snippet")


def bm25_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits reach the least score, and whether a question abstains."""
    asked = _questions(spark, sf_dir).unionByName(prepare(spark).createDataFrame([(-1, "what is the of"), (-2, "zzqq unheard")], "query_id long, text string"))
    return retrieval.abstentions(asked, retrieval.search(_docs(spark, sf_dir), asked, k=5, min_score=30.0))


def glossary_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query tokens with those that the glossary ties to them."""
    terms = prepare(spark).createDataFrame(GLOSSARY, "term string, others array<string>")
    asked = _questions(spark, sf_dir).select("query_id", F.concat(F.lit("tion "), "text").alias("text"))
    out = retrieval.query_tokens(asked, "query_id", "text", retrieval.glossary_edges(terms))
    return out.select("query_id", F.array_join("tokens", " ").alias("tokens"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of every cleaned page."""
    clean = t.clean_text(F.col("html"))
    return table(prepare(spark), sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n"), F.md5(clean.cast("binary")).alias("digest"))


def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document."""
    out = chunking.chunk_documents(_docs(spark, sf_dir))
    return out.select("doc_id", "chunk", "title", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as typed units, chunked by conversation."""
    rows = table(prepare(spark), sf_dir, "conversations").select(
        F.concat(F.lit("conv"), "conv_id").alias("source_file"), F.col("conv_id").cast("string").alias("source_id"), F.lit("ch01").alias("chapter_id"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("string").alias("parent_unit_id"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page"), "turn", F.concat_ws("-", "conv_id", "turn").alias("unit_id"),
        F.when(F.col("role") == "user", "question").otherwise("text").alias("kind"), F.lit(None).cast("string").alias("asset_role"), F.lit(None).cast("string").alias("asset_path"), "text",
        F.lit(None).cast("string").alias("latex"), F.lit(None).cast("string").alias("html"),
    )
    out = chunking.chunk_units(rows.withColumnRenamed("turn", "ordinal"))
    return out.select("source_file", "chunk", "kind", F.array_join("unit_ids", ",").alias("unit_ids"), F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _signals() -> dict:
    n = F.length("text")
    return {
        "page": F.lit(1), "text": F.col("text"), "image_count": (F.col("doc_id") % 4).cast("int"), "image_area_ratio": (F.col("doc_id") % 10) / 20.0, "vector_count": (F.col("doc_id") % 130).cast("int"),
        "multi_column_hint": F.col("doc_id") % 11 == 0, "table_hint": F.contains("text", F.lit(" | ")), "formula_hint": F.when(n % 97 != 0, F.col("doc_id") % 17 == 0),
    }


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, reasons and route of every document as a page."""
    rows = q.assess(_docs(spark, sf_dir).select("doc_id", "text"), _signals())
    return rows.select("doc_id", "score", F.array_join("reasons", ",").alias("reasons"), "route")


def page_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of broken characters of every document."""
    s = q.corruption(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", *[s[c].cast("long").alias(c) for c in ("nul", "mojibake", "bad")], F.round(s["symbol_ratio"], 6).alias("symbol_ratio"))


def quality_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by reason and route."""
    rows = q.assess(_docs(spark, sf_dir).select("doc_id", "text"), _signals()).select("score", F.explode_outer("reasons").alias("reason"), "route")
    return rows.groupBy("reason", "route").agg(F.count("*").alias("n"), F.min("score").alias("least"))


def language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language evidence and label."""
    return _docs(spark, sf_dir).groupBy("lang", t.language_evidence(F.col("text")).alias("evidence")).agg(F.count("*").alias("n"))


def heading_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique anchors of first lines within each source."""
    rows = _docs(spark, sf_dir).select("doc_id", "source", t.slug(F.substring_index("text", "\n", 1)).alias("slug"))
    return sessions.anchors(rows, ["source"], "doc_id", "slug").select("doc_id", "anchor")


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in a language."""
    groups = duplicates.exact_groups(_docs(spark, sf_dir), "lang", "doc_id")
    return groups.select(F.col("block").alias("lang"), "fingerprint", F.size("members").cast("long").alias("n"), "display", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def exact_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hidden copy with the document that is shown for it."""
    rows = _docs(spark, sf_dir).select("doc_id", "lang", duplicates.exact_fingerprint(F.col("text")).alias("fingerprint"), t.normalize_near(F.col("text")).alias("near")).where("near <> ''")
    return duplicates.star_pairs(rows, ["lang", "fingerprint"], "doc_id").select("left_id", "right_id")


def fold_display_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without hidden copies, and the number of their aliases."""
    docs = _docs(spark, sf_dir)
    out = duplicates.fold(docs, duplicates.exact_groups(docs, "lang", "doc_id"), "doc_id")
    return out.select("doc_id", F.size("aliases").cast("long").alias("n_aliases"))


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of a language whose trigrams agree."""
    out = duplicates.near_pairs(_docs(spark, sf_dir), "lang", "doc_id")
    return out.select(F.col("block").alias("lang"), "left_id", "right_id", "match_kind", "score_ppm")


def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of different sources that disagree in numbers or truth words."""
    docs = _docs(spark, sf_dir)
    units = docs.select(F.col("doc_id").alias("unit_id"), "source", "text", F.lit("text").alias("kind"))
    ranks = docs.select("source").distinct().select("source", F.length("source").alias("rank"))
    out = duplicates.conflicts(duplicates.near_pairs(docs, "lang", "doc_id"), units, ranks)
    return out.select("left_id", "right_id", "kind", F.array_join("signals", ",").alias("signals"), "preferred")


def contamination_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, run): eight words in a row that a document shares with a benchmark passage.

    The passages' runs are a small, stated set; a document's runs meet them by hash where it lies
    or by a shuffle of eight-byte keys, and copies of a run in one document count once.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = df.select(key, words(F.col("text")).alias("w")).where(F.size("w") >= 8)
        each = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " ")))))
        return w.select(key, each.alias("run"))

    spark = prepare(spark)
    passages = stored(runs(table(spark, sf_dir, "benchmark"), "item_id"))
    return runs(_docs(spark, sf_dir), "doc_id").join(F.broadcast(passages) if passages.count() <= BROADCAST_RUNS else passages, "run")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share runs with benchmark passages: how many passages and runs."""
    return contamination_pairs(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("run").alias("runs"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists of the questions: BM25, and documents by how many distinct question tokens they hold."""
    docs, asked = _docs(spark, sf_dir), retrieval.query_tokens(_questions(spark, sf_dir), "query_id", "text")
    p = retrieval.postings(docs)
    sparse = retrieval.top_k(retrieval.bm25(p, retrieval.doc_lengths(docs), asked), 50).select(F.lit("bm25").alias("backend"), "query_id", "doc_id", "rank")
    held = asked.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")).join(p, "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id")
    overlap = held.withColumn("rank", F.row_number().over(order)).where("rank <= 50").select(F.lit("overlap").alias("backend"), "query_id", "doc_id", "rank")
    return sparse.unionByName(overlap)


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists fused by reciprocal ranks."""
    out = fusion.rrf(_lists(spark, sf_dir))
    return out.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"), F.size("components").cast("long").alias("backends"))


def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 pool in the order of text length."""
    pool = _lists(spark, sf_dir).where("backend = 'overlap' and rank <= 10").select("query_id", "doc_id", "rank")
    scores = pool.join(_docs(spark, sf_dir).select("doc_id", F.length("text").alias("new_score")), "doc_id").select("query_id", "doc_id", "new_score")
    return fusion.rerank(pool, scores, 3).select("query_id", F.col("new_rank").alias("rank"), "doc_id", "new_score")


def topk_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the two lists have the same five best documents."""
    return fusion.top_k_stability(_lists(spark, sf_dir).select("query_id", "doc_id", "rank", F.col("backend").alias("repeat")))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(prepare(spark), sf_dir, "embeddings")
    return rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    rows, asked = _vectors(spark, sf_dir)
    return fusion.dense_top_k(rows.select("vec_id", "embedding"), asked.select("query_id", "query"), 5).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the nearest vectors, where vectors of a query's label are relevant."""
    rows, asked = _vectors(spark, sf_dir)
    hits = fusion.dense_top_k(rows.select("vec_id", "embedding"), asked.select("query_id", "query"), 5).join(rows.select("vec_id", "label"), "vec_id")
    label = lambda c: F.array(F.concat(F.lit("label"), c.cast("string")))
    gold = asked.select("query_id", (F.col("query_label") != 9).alias("answerable"), label(F.col("query_label")).alias("relevant"), label((F.col("query_label") + 1) % 10).alias("hard_negative"))
    return fusion.query_metrics(gold, hits.select("query_id", "rank", label(F.col("label")).alias("unit_ids")))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_snippets, bm25_abstain, index_postings, index_doc_stats, index_summary, glossary_expand, clean_text, chunk_spans, chunk_units, page_quality, page_corruption,
        quality_reason_counts, language_evidence, heading_slugs, exact_dup_groups, exact_dup_pairs, fold_display_units, near_dup_pairs, source_conflicts, contamination, rrf_fuse, rerank_pool, topk_stability, dense_cosine_topk, ir_metrics,
    )
}



def _listed(names: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in names) + "]"


_QUESTIONS = rf"""asked as (select item_id as query_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '{BLANK}+', ' ', 'g')), ' '), 1, {QUESTION_WORDS}), ' ') as text from benchmark)"""
_INDEX = f"""
toks as (select doc_id, unnest({TOKENS.format("text")}) as token from documents),
post as (select token, doc_id, count(*)::bigint as tf from toks group by 1, 2),
lens as (select doc_id, len({TOKENS.format("text")})::bigint as len from documents),
stats as (select count(*)::bigint as n_docs, round(avg(len), 3) as avgdl from lens),
df as (select token, count(*)::bigint as df from post group by 1)"""
_BM25 = f"""
qt as (select distinct query_id, token from (select query_id, unnest({TOKENS.format("text")}) as token from asked) where not list_contains({STOP}, token)),
scored as (
  select qt.query_id, post.doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len, 1) / avgdl))) as score
  from qt join post using (token) join df using (token) join lens using (doc_id), stats group by 1, 2
),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scored)"""
_LISTS = """
held as (select query_id, doc_id, count(*) as n from qt join post using (token) group by 1, 2),
lists as (
  select 'bm25' as backend, query_id, doc_id, rank from ranked where rank <= 50
  union all select * from (select 'overlap', query_id, doc_id, row_number() over (partition by query_id order by n desc, doc_id) as rank from held) where rank <= 50
)"""
_NORMAL = rf"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v\x{{85}}\x{{a0}}]+', ' ', 'g'))"
_PAIRS = f"""
u as (select doc_id, lang, source, text, sha256({_NORMAL}) as fingerprint, replace(lower({_NORMAL}), 'ß', 'ss') as near from documents where {_NORMAL} <> ''),
reps as (select lang, fingerprint, near, min(doc_id) as doc_id from u group by 1, 2, 3),
first_u as (select lang, fingerprint, min(doc_id) as left_id from u group by 1, 2),
first_r as (select lang, near, min(doc_id) as left_id from reps group by 1, 2),
texts as (select lang, near, min(doc_id) as doc_id, length(near) - 2 as n from reps where length(near) >= 24 group by 1, 2),
grams as (select doc_id, gram, count(*) as c from (select doc_id, unnest(list_transform(range(1, n + 1), lambda i: substring(near, i, 3))) as gram from texts) group by 1, 2),
cand as (select a.lang, a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from texts a join texts b on a.lang = b.lang and (a.n < b.n or (a.n = b.n and a.doc_id < b.doc_id)) and b.n <= (2 * a.n * 1000000) // 920000 - a.n),
hits as (select lang, x, y, nx, ny, sum(least(g.c, h.c))::bigint as shared from cand join grams g on g.doc_id = x join grams h on h.doc_id = y and h.gram = g.gram group by all),
pairs as (
  select u.lang, left_id, u.doc_id as right_id, 'exact' as match_kind, 1000000::bigint as score_ppm from u join first_u using (lang, fingerprint) where u.doc_id > left_id
  union all select reps.lang, left_id, reps.doc_id, 'near', 1000000 from reps join first_r using (lang, near) where reps.doc_id > left_id
  union all select lang, least(x, y), greatest(x, y), 'near', ((2 * shared * 1000000) // (nx + ny))::bigint from hits where (2 * shared * 1000000) // (nx + ny) >= 920000
)"""

_RUNS = r"""w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from benchmark),
wr as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as run from w where len(w) >= 8),
br as (select distinct item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as run from b where len(w) >= 8)"""

ORACLE = {
    "bm25_topk": f"with {_QUESTIONS}, {_INDEX}, {_BM25} select query_id, rank::int as rank, doc_id, round(round(score, 4), 3) as score from ranked where rank <= 5",
    "bm25_abstain": f"""with base as (select * from benchmark), {_QUESTIONS.replace('asked as', 'a0 as')}, asked as (select * from a0 union all select -1, 'what is the of' union all select -2, 'zzqq unheard'), {_INDEX}, {_BM25},
h as (select query_id, count(*)::bigint as n from ranked where rank <= 5 and score >= 30 group by 1)
select query_id, coalesce(n, 0)::bigint as n_hits, n is null as abstain from asked left join h using (query_id)""",
    "index_postings": f"with {_INDEX} select token, count(*)::bigint as df, sum(tf)::bigint as cf from post group by 1",
    "index_doc_stats": f"with {_INDEX} select * from lens",
    "index_summary": f"with {_INDEX} select * from stats",
    "glossary_expand": rf"""with {_QUESTIONS}, q as (select query_id, list_filter({TOKENS.format("'tion ' || text")}, lambda x: not list_contains({STOP}, x)) as tokens from asked),
e(src, dst) as (values ('the', 'der'), ('the', 'le'), ('der', 'the'), ('der', 'le'), ('le', 'the'), ('le', 'der'), ('and', 'und'), ('and', 'et'), ('und', 'and'), ('und', 'et'), ('et', 'and'), ('et', 'und'), ('tion', 'ci'), ('tion', 'n'), ('ci', 'tion'), ('n', 'tion')),
p as (select query_id, unnest(tokens) as src, unnest(range(1, len(tokens) + 1)) as pos from q), m as (select query_id, dst, min(pos) as pos from p join e using (src) group by 1, 2),
x as (select m.query_id, list(dst order by pos, dst) as more from m join q using (query_id) where not list_contains(tokens, dst) group by 1)
select query_id, array_to_string(case when more is null then tokens else list_concat(tokens, more) end, ' ') as tokens from q left join x using (query_id)""",
    "clean_text": r"""with a as (select page_id, regexp_replace(coalesce(html, ''), '(?i)</?(?:div|span|p|br|img|table|tr|td|th|ul|ol|li|a|b|i|em|strong)\b[^>]*>', ' ', 'g') as t from pages),
b as (select page_id, regexp_replace(substring(t, 1, 2048), '(?:^|\s)[\w.#][\w.#\-, >]{0,60}\{\s*(?:[a-zA-Z-]+\s*:\s*[^{};:]{1,80};?\s*){1,8}\}', ' ', 'g') || substring(t, 2049) as t from a),
c as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t　]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from b),
d as (select page_id, regexp_replace(t, '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g') as t from c)
select page_id, length(t)::bigint as n, md5(t) as digest from d""",
    "page_corruption": r"""with c as (select doc_id, text, (length(text) - length(replace(text, chr(65533), '')))::bigint as nul,
  (select sum((length(text) - length(replace(text, f, ''))) // length(f)) from (values ('Ã'), ('Â'), ('â€'), ('â€™'), ('â€œ'), ('â€' || chr(65533)), ('ï»¿'), ('Ð'), ('Ñ')) v(f))::bigint as mojibake,
  len(regexp_extract_all(text, '[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]'))::bigint as controls, len(regexp_extract_all(text, '[\p{Co}]'))::bigint as private,
  len(regexp_extract_all(text, '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]'))::bigint as visible, len(regexp_extract_all(text, '[\p{P}\p{S}]'))::bigint as symbols from documents)
select doc_id, nul, mojibake, nul + mojibake + controls + private as bad, round(case when visible > 0 then symbols / visible else 0 end, 6) as symbol_ratio from c""",
    "exact_dup_groups": f"with {_PAIRS} select lang, fingerprint, count(*)::bigint as n, min(doc_id) as display, string_agg(doc_id::varchar, ',' order by doc_id) as members from u group by 1, 2 having count(*) > 1",
    "exact_dup_pairs": f"with {_PAIRS} select left_id, right_id from pairs where match_kind = 'exact'",
    "fold_display_units": f"with {_PAIRS} select d.doc_id, (select count(*) from pairs p where match_kind = 'exact' and p.left_id = d.doc_id)::bigint as n_aliases from documents d where d.doc_id not in (select right_id from pairs where match_kind = 'exact')",
    "near_dup_pairs": f"with {_PAIRS} select * from pairs",
    "contamination": f"""with {_RUNS} select doc_id, count(distinct item_id)::bigint as items, count(distinct run)::bigint as runs from wr join br using (run) group by 1""",
    "rrf_fuse": f"""with {_QUESTIONS}, {_INDEX}, {_BM25}, {_LISTS}, f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 12) as score, count(*)::bigint as backends from lists group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) select query_id, rank::int as rank, doc_id, round(score, 9) as score, backends from r where rank <= 5""",
    "rerank_pool": f"""with {_QUESTIONS}, {_INDEX}, {_BM25}, {_LISTS}, p as (select query_id, doc_id, rank, length(text) as new_score from lists join documents using (doc_id) where backend = 'overlap' and rank <= 10),
r as (select *, row_number() over (partition by query_id order by new_score desc, rank, doc_id) as new_rank from p) select query_id, new_rank::int as rank, doc_id, new_score::int as new_score from r where new_rank <= 3""",
    "topk_stability": f"""with {_QUESTIONS}, {_INDEX}, {_BM25}, {_LISTS}, s as (select query_id, backend, list(doc_id order by doc_id) as docs from lists where rank <= 5 group by 1, 2),
t as (select query_id, count(distinct docs) = 1 as stable from s group by 1) select count(*)::bigint as queries, count(*) filter (stable)::bigint as stable, round(avg(stable::int), 6) as share from t""",
    "dense_cosine_topk": """with q as (select vec_id as query_id, embedding::double[] as query from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], query), 6) as score from embeddings, q where vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, rank::int as rank, vec_id, round(score, 4) as score from r where rank <= 5""",
    "ir_metrics": """with q as (select vec_id as query_id, embedding::double[] as query, label as ql from embeddings where vec_id % 20 = 0),
s as (select query_id, ql, vec_id, label, round(list_cosine_similarity(embedding::double[], query), 6) as score from embeddings, q where vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s),
m as (select query_id, ql, max((rank = 1 and label = ql)::int) as r1, max((rank <= 5 and label = ql)::int) as r5, min(case when label = ql then rank end) as first, max((label = (ql + 1) % 10)::int) as intr from r where rank <= 5 group by 1, 2)
select query_id, ql <> 9 as answerable, (r1 * (ql <> 9)::int)::double as recall_1, (r5 * (ql <> 9)::int)::double as recall_5, r1 * (ql <> 9)::int as hit_1, r5 * (ql <> 9)::int as hit_5, case when ql <> 9 then coalesce(round(1.0 / first, 6), 0) else 0 end::double as reciprocal_rank, intr * (ql <> 9)::int as intrusion, (ql = 9)::int as false_accept, 0 as missing, 0 as abstained from m""",
    "bm25_snippets": f"""with {_QUESTIONS}, {_INDEX}, {_BM25}, q as (select query_id, list_filter({TOKENS.format("text")}, lambda x: not list_contains({STOP}, x)) as tokens from asked),
h as (select query_id, doc_id, text, list_filter(list_transform(tokens, lambda t: instr(lower(text), t)), lambda i: i > 0) as places from ranked join q using (query_id) join documents using (doc_id) where rank = 1),
s as (select query_id, doc_id, text, greatest(0, coalesce(places[1] - 1, 0) - 60) as start from h)
select query_id, doc_id, trim(regexp_replace(substring(text, start + 1, 240), '\\s+', ' ', 'g')) as snippet from s""",
    "heading_slugs": r"""with h as (select doc_id, source, regexp_replace(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '[^\p{L}\p{N}_\-\s]', '', 'g'), '\s', '-', 'g') as slug from documents),
n as (select *, row_number() over (partition by source, slug order by doc_id) - 1 as n from h) select doc_id, case when n > 0 then slug || '-' || n else slug end as anchor from n""",
    "language_evidence": r"""with w as (select lang, text, regexp_extract_all(text, '[A-Za-z]+') as raw, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) as words,
  regexp_extract_all(regexp_replace(text, '\\(?:begin|end)\{[A-Za-z*]+\}|\\[A-Za-z]+', '', 'g'), '[A-Za-z]+') as seen, regexp_matches(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') as han from documents),
e as (select lang, case when text is null or trim(text) = '' then 'unknown'
  when han then case when list_sum(list_transform(words, lambda x: length(x))) >= 3 and list_has_any(words, PROSE) then 'mixed' else 'zh' end
  when not regexp_matches(text, '(?i)\\(?:text|textrm|textsf|texttt|textnormal|mbox)\s*\{') and regexp_matches(text, '\\[A-Za-z]+|[0-9=+*/^<>≤≥∑∏∫√±×÷≠≈∈∉⊂⊆⊃⊇∅∀∃∪∩(){}\[\]|_]')
    and len(list_filter(seen, lambda t: not (length(t) = 1 or (not list_contains(FORMULA, lower(t)) and (list_contains(MATHS, lower(t)) or (t = upper(t) and length(t) <= 4)))))) = 0 then 'zxx'
  when list_has_any(words, LABELS) then 'en' else 'unknown' end as evidence from w)
select lang, evidence, count(*) as n from e group by 1, 2""".replace("PROSE", _listed(t.ENGLISH_PROSE)).replace("FORMULA", _listed(t.ENGLISH_PROSE + t.FORMULA_PROSE)).replace("MATHS", _listed(t.MATH_WORDS)).replace("LABELS", _listed(t.ENGLISH_PROSE + t.ENGLISH_LABELS)),
}

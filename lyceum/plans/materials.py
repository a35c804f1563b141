"""Queries of course materials: visual pages, chapters, problems, formulas, claims, the promotion gate."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.functions import mathtext, vocabulary
from lyceum.functions import quality as q
from lyceum.operators import claims, extraction, fusion, gate, ledger, pages, questions, retrieval
from lyceum.plans import corpus
from lyceum.session import prepare, stored, table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(prepare(spark), sf_dir, name)


def _pick(words: tuple[str, ...], by: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.col(by) % len(words) + 1).cast("int"))


HINTS = ("see the figure", "a comfortable paragraph", "shaded region", "draw a tree", "table of contents", "nothing", "x-axis", "fig. 3")
SQL_HINTS = "list_extract(['" + "', '".join(HINTS) + "'], (doc_id % 8 + 1)::int)"


def _hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", _pick(HINTS, "doc_id")).alias("text"))


def visual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual kinds of every document as a page that ends in a hint."""
    has, kinds = pages.classify_page(F.col("text"), F.when(F.col("doc_id") % 50 == 0, 1), F.col("doc_id") % 6)
    return _hinted(spark, sf_dir).select("doc_id", has.alias("has_visual"), F.array_join(kinds, ",").alias("kinds"))


def asset_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that need a figure, as a text and as a page that can be rendered."""
    return _hinted(spark, sf_dir).select("doc_id", pages.needs_assets(F.col("text"), F.lit(False)).alias("as_text"), pages.needs_assets(F.col("text"), F.lit(True)).alias("as_page"))


def visual_question_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions beside visual pages, by state."""
    has, _ = pages.classify_page(F.col("text"), F.lit(0), F.lit(0))
    seen = _hinted(spark, sf_dir).where("doc_id % 3 <> 0").select(F.lit("f").alias("file"), F.col("doc_id").alias("page"), has.alias("has_visual"))
    asked = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("f").alias("file"), F.col("doc_id").alias("page"), (F.col("quality") == 1).alias("has_asset"))
    return pages.question_index(asked, seen).groupBy("visual", "suspect", "unscanned").agg(F.count("*").alias("n"))


def chapter_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of turns as pages, carried forward within a conversation."""
    head = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Chapter "), (F.col("conv_id") % 7 + F.col("turn")).cast("string"), F.lit("\n"))).otherwise("")
    rows = _t(spark, sf_dir, "conversations").select(F.concat(F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("ch0"), (F.col("conv_id") % 9 + 1).cast("string"))).otherwise("notes"), F.lit("_"), "conv_id").alias("file"), F.col("turn").alias("page"), F.concat(head, F.lit("t")).alias("text"))
    return pages.chapters(rows)


def _lecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("conv_id"), F.col("turn")
    role = F.when(k % 2 == 1, " Solution").otherwise(F.when(c % 4 == 0, " ...... 12").otherwise(""))
    said = F.concat(F.when(c % 3 == 0, "Quiz ").otherwise("Example "), (c % 11 + 1).cast("string"), F.lit("."), (F.floor(k / 2) + 1).cast("string"), role)
    return _t(spark, sf_dir, "conversations").select(F.concat(F.lit("f"), (c % 40).cast("string")).alias("file"), (c * 100 + k).alias("page"), F.concat(F.lit("intro\n"), said, F.lit("\nbody")).alias("text"))


def lecture_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked problems and solutions by chapter."""
    return pages.markers(_lecture(spark, sf_dir)).groupBy("kind", "chapter", "role").agg(F.count("*").alias("n"))


def lecture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with the page of their solution."""
    return pages.paired(pages.markers(_lecture(spark, sf_dir))).drop("variant")


def orphan_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions without a problem."""
    return pages.orphan_solutions(pages.markers(_lecture(spark, sf_dir)))


FORMULAS = ("cost $x^2$ and", "raw x^2 here", "p_0 bare", r"use \alpha now", r"shown $$\frac{a}{b}$$ ok", "`x^2` code", "= 4\n9, done", r"C:\alpha\x_1 path")


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", _pick(FORMULAS, "doc_id"), "text").alias("text"))


def math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of every text: number and first end."""
    s = mathtext.spans_of("text")
    return _formulas(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0))["end"].alias("first_end"))


def math_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw notation, bare commands and flattened layout of every text."""
    rows = _formulas(spark, sf_dir)
    return rows.select("doc_id", mathtext.raw_notation_of("text").alias("raw"), mathtext.bare_command_of("text").alias("command"), mathtext.layout_hazard(F.col("text")).alias("layout"))


MESSAGES = ("NUL byte", "bad LaTeX", "missing answer", "keyword list", "chapter unknown", "asset lost", "needs review", "other thing", "公式错误")


def message_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by code and severity."""
    said = _pick(MESSAGES, "doc_id")
    rows = _t(spark, sf_dir, "documents").select(vocabulary.message_code(said).alias("code"), vocabulary.severity(said, ["NUL", "missing"]).alias("severity"))
    return rows.groupBy("code", "severity").agg(F.count("*").alias("n"))


def path_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that paths name."""
    d = F.col("doc_id").cast("string")
    path = F.concat(_pick(("lec_", "x/ch0", "lecture-3/notes", "ps", "plain/"), "doc_id"), d, F.lit(".md"))
    return _t(spark, sf_dir, "documents").select("doc_id", vocabulary.chapter_of(path).alias("chapter"))


def opened_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a tool log says were opened, for each user of the events."""
    call = lambda name, fields: F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"' + name + '","input":{'), fields, F.lit("}}]}}"))
    u = (F.col("user_id") % 10).cast("string")
    log = F.concat_ws(
        "\n", call("Read", F.concat(F.lit('"file_path":"ch'), u, F.lit('.md"'))), F.lit("not json"), call("Grep", F.concat(F.lit('"pattern":"ch99","path":"dir'), u, F.lit('"'))), call("Read", F.concat(F.lit('"file_path":"ch'), u, F.lit('.md"'))),
        call("Glob", F.lit('"pattern":"*.md"')), call("Bash", F.lit('"path":"no"')), F.lit('{"type":"result","result":"ok","total_cost_usd":0.1}'),
    )
    users = _t(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.array_join(vocabulary.opened_files(log), "|").alias("files"))


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents")
    units = docs.select(F.col("doc_id").cast("string").alias("unit_id"), F.col("source").alias("source_id"), F.when(F.col("doc_id") % 5 == 0, "formula").otherwise("text").alias("kind"), F.when(F.col("doc_id") % 31 == 0, "student_attempt").alias("asset_role"), F.when(F.col("doc_id") % 29 == 0, "p1").otherwise("p2").alias("asset_path"), "text")
    quote = F.when(F.col("doc_id") % 9 == 0, "nowhere to be found").when(F.col("doc_id") % 9 == 1, " ").otherwise(F.substring("text", 5, 12))
    said = docs.select(F.col("doc_id").alias("claim_id"), F.col("doc_id").cast("string").alias("unit_id"), quote.alias("quote"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 4 + 2).cast("int")).alias("start"))
    return units, said


def claims_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with their span or why they have none."""
    units, said = _quotes(spark, sf_dir)
    return claims.located(said, units).select("claim_id", "start", "end", "problem")


def claims_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by the rule that they break."""
    units, said = _quotes(spark, sf_dir)
    c = F.col("claim_id")
    live = units.select("unit_id", "source_id", F.sha2("text", 256).alias("payload_sha256"))
    rows = said.join(live, "unit_id").select(
        "claim_id", "unit_id", F.when(c % 37 == 0, "gone").otherwise(F.col("source_id")).alias("source_id"), F.when(c % 23 == 0, "old").otherwise("new").alias("source_sha256"),
        F.when(c % 19 == 0, "x").otherwise(F.col("payload_sha256")).alias("payload_sha256"), F.when(c % 3 == 0, "formula_evidence").otherwise("concept_evidence").alias("role"), "quote", F.lit(4).alias("start"),
    )
    sources = units.select("source_id").distinct().select("source_id", F.lit("new").alias("sha256"))
    tainted = prepare(spark).createDataFrame([("p1",)], "path string")
    return claims.verify(rows, units, sources, tainted).groupBy("problem").agg(F.count("*").alias("n"))


def multi_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages whose lines are boxes: a gap between them makes columns."""
    rows = _t(spark, sf_dir, "lineitem")
    x = F.when(F.col("l_linenumber") % 2 == 0, 100.0).otherwise(0.0) * (F.col("l_orderkey") % 3)
    y = F.col("l_linenumber") * 10.0 * F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(0.2)
    boxes = rows.select(F.lit("f").alias("file"), F.col("l_orderkey").alias("page"), x.alias("x0"), (x + 80).alias("x1"), y.alias("y0"), (y + 25).alias("y1"))
    return pages.columns_hint(boxes).groupBy("multi_column").agg(F.count("*").alias("n"))


def merged_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assessments of every document as one."""
    d = F.col("doc_id")
    side = lambda k: {"score": d * k % 101, "reasons": F.filter(F.array(F.when(d % k == 0, F.lit("table_hint")), F.when(d % (k + 1) == 0, F.lit("no_text")), F.when(d % (k + 2) == 0, F.lit("own_reason"))), lambda r: r.isNotNull()), "route": _pick(("fast", "recover", "review")[: k - 1], "doc_id")}
    score, reasons, route = q.merge_quality(side(3), side(4))
    return _t(spark, sf_dir, "documents").select("doc_id", score.alias("score"), F.array_join(reasons, ",").alias("reasons"), route.alias("route"))


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether fused lists may replace BM25 for the benchmark passages: their documents are those that hold a run of their words."""
    spark = prepare(spark)
    docs, asked = _t(spark, sf_dir, "documents"), corpus._questions(spark, sf_dir)
    lists = corpus._lists(spark, sf_dir)
    relevant = corpus.contamination_pairs(spark, sf_dir).groupBy("item_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("relevant"))
    none = F.array().cast("array<string>")
    gold = asked.join(relevant, F.col("query_id") == F.col("item_id"), "left").select(
        "query_id", F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string")).alias("course_id"), F.col("relevant").isNotNull().alias("answerable"), F.coalesce("relevant", none).alias("relevant"), none.alias("hard_negative"), F.array(F.lit("rare_term")).alias("tags")
    )
    unit = F.array(F.col("doc_id").cast("string")).alias("unit_ids")
    base = fusion.query_metrics(gold, lists.where("backend = 'bm25' and rank <= 5").select("query_id", "rank", unit))
    cand = fusion.query_metrics(gold, fusion.rrf(lists).select("query_id", "rank", unit))
    lim = gate.limits()
    why = gate.sufficiency(gold, ["rare_term"], lim)
    asked_n, indexed = max(1, asked.count()), docs.count()
    postings = stored(retrieval.postings(docs).groupBy("token").agg(F.count("*").alias("df")))
    index_bytes = postings.agg(F.sum(F.octet_length("token") + 12 * F.col("df"))).first()[0] or 0  # a token, and a document and a count for each posting
    again = lists.where("rank <= 5").select("query_id", "backend", "doc_id", "rank", F.lit(0).alias("repeat")).unionByName(corpus._lists(spark, sf_dir).where("rank <= 5").select("query_id", "backend", "doc_id", "rank", F.lit(1).alias("repeat")))

    def run(metrics: DataFrame, kind: str, hits: DataFrame) -> dict:
        """A receipt of measured values: the time that all hits take, dealt to the questions, as they are answered together."""
        began = time.monotonic()
        hits.write.format("noop").mode("overwrite").save()
        latency = 1000 * (time.monotonic() - began) / asked_n
        same = again if kind == "rrf" else again.where("backend = 'bm25'")
        stability = fusion.top_k_stability(same.select("query_id", F.concat_ws(":", "backend", "doc_id").alias("doc_id"), "rank", "repeat")).first().share
        sums = metrics.agg(F.avg(F.when(F.col("answerable"), F.col("recall_5"))).alias("recall_5"), F.avg("intrusion").alias("intrusion"), F.sum("false_accept").alias("false_accepts"), F.sum("missing").alias("missing")).first().asDict()
        resources = {"p95_latency_ms": latency, "index_size_bytes": index_bytes, "indexed_docs": indexed, "top5_stability": stability}
        return {"kind": kind, "resources": resources, "slices": {r["tag"]: r["recall_5"] for r in gate.slice_recall(metrics, gold).collect()}} | sums

    bm25, rrf = lists.where("backend = 'bm25'"), fusion.rrf(lists)
    decision, reasons = gate.decide(why, run(base, "bm25", bm25) if not why else None, run(cand, "rrf", rrf) if not why else None, gate.compare(base, cand) if not why else None, ["rare_term"], lim)
    return spark.createDataFrame([(decision, ",".join(reasons))], "decision string, reasons string")


def answer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank at which BM25 finds a document that holds a run of the asking passage."""
    docs, asked = _t(spark, sf_dir, "documents"), corpus._questions(spark, sf_dir)
    hits = retrieval.search(docs, asked, k=20).select("query_id", "rank", "doc_id")
    pairs = corpus.contamination_pairs(spark, sf_dir).select(F.col("item_id").alias("query_id"), "doc_id").distinct()
    return hits.join(pairs, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"), F.count("*").alias("found"))


# ---- extraction: a turn is a unit, its conversation the source ----


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, k = F.col("conv_id"), F.col("turn")
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws("-", c, k).alias("unit_id"), c, k, F.when(F.col("role") == "assistant", "answer").otherwise("question").alias("kind"))
    gold = rows.select("unit_id", "kind", F.when(c % 6 != 0, F.concat(F.lit("ch"), (c % 5).cast("string"))).alias("chapter_id"), F.when(c % 3 == 0, "ai").otherwise("source").alias("provenance"), (k % 3 == 0).alias("requires_visual"))
    found = rows.where(c % 13 != 0).select(
        "unit_id", "kind", F.concat(F.lit("ch"), ((c + F.when(k == 2, 1).otherwise(0)) % 5).cast("string")).alias("chapter_id"), F.when(c % 4 == 0, "ai").otherwise("source").alias("provenance"), (k % 2 == 0).alias("requires_visual"),
        F.when(c % 2 == 0, F.when(c % 8 == 0, "student_attempt").when(c % 10 == 0, "worked_solution").otherwise("question_context")).alias("asset_role"), F.lit("p").alias("asset_path"), F.when(c % 7 != 0, "x").alias("asset_sha256"), (k % 4 == 1).alias("exposed_in_question"),
    )
    return gold, found


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter and provenance accuracy and visual recall, one row each."""
    gold, found = _units(spark, sf_dir)
    parts = [extraction.agreement(gold, found, "chapter_id", skip_null=True), extraction.agreement(gold, found, "provenance", skip_null=False), extraction.visual_recall(gold, found)]
    rows = [p.toDF("hits", "total", "share").withColumn("metric", F.lit(n)) for n, p in zip(("chapter", "provenance", "visual"), parts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def leaking_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the answer side that a question shows."""
    return extraction.leaks(_units(spark, sf_dir)[1])


def qa_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns as pairs against pairs of even and odd turns."""
    c = _t(spark, sf_dir, "conversations").where("turn >= 1").select("conv_id", F.col("turn").alias("q"), (F.col("turn") + 1).alias("a"))
    return extraction.pair_scores(c.where("q % 2 = 1"), c.where("q % 3 <> 0"), ["conv_id", "q", "a"])


def extraction_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of the fused lists."""
    lists = fusion.rrf(corpus._lists(spark, sf_dir)).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("units"))
    relevant = corpus.contamination_pairs(spark, sf_dir).groupBy(F.col("item_id").alias("query_id")).agg(F.array_sort(F.collect_set("doc_id")).alias("relevant"))
    return extraction.retrieval_scores(relevant, lists)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, ("Which is right?\nA. ", "Fill in: x ____ y\nA. ", "Points to treat:\nA. ", "Answer: ____\n"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.regexp_replace("text", "\\n", " "), F.lit("\nB. other thing")).alias("text"), F.element_at(F.array(*map(F.lit, ("Answer: B", "1) b because", "other thing.", "Solution set", "Question 2: C"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("answer"))


def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by type, and the letters of their answers."""
    kind, options = questions.question_type(F.col("text"))
    rows = _typed(spark, sf_dir).select(kind.alias("type"), options.alias("options"), "answer")
    return rows.groupBy("type", questions.choice_letter(F.col("answer"), F.col("options")).alias("letter"), questions.answer_body(F.col("answer")).alias("body")).agg(F.count("*").alias("n"))


def patch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units after a ledger of patches, by whether they exist and what didn't fit."""
    c = _t(spark, sf_dir, "conversations")
    uid = F.concat_ws("-", "conv_id", "turn")
    null = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    units = c.where("turn < 3").select(uid.alias("unit_id"), F.when(F.col("role") == "assistant", "answer").otherwise("question").alias("kind"), F.lit("t").alias("text"), *null("chapter_id", "phase_id", "asset_role", "paired_unit_id"))
    k = F.col("conv_id") % 4
    op = F.when(F.col("turn") == 3, "add_unit").when(k == 0, "assign_chapter").when(k == 1, "classify_asset").when(k == 2, "replace_unit").otherwise("pair_qa")
    ops = c.where("turn > 0").select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("seq"), op.alias("op"), uid.alias("unit_id"), F.lit("question").alias("kind"), F.lit("new").alias("text"), F.lit("ch01").alias("chapter_id"), F.lit("p1").alias("phase_id"), F.lit("question_context").alias("asset_role"),
        F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("paired_unit_id"), F.lit("stale").alias("expected_sha256"),
    )
    return ledger.replay(units, ops).groupBy("exists", "changed", "problems").agg(F.count("*").alias("n"))


def conflict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts by their status after decisions."""
    d = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders")
    conflicts = rows.select(d.alias("conflict_id"), _pick(("answer_mismatch", "textual_divergence", "provenance_mismatch"), "o_orderkey").alias("kind"), d.alias("issue_id"))
    patches = rows.where(d % 2 == 0).select(d.alias("issue_id"), F.concat(F.lit("p"), d.cast("string")).alias("patch_id"), _pick(("mark_resolved", "x", "mark_unrecoverable", "x", "replace_unit"), "o_orderkey").alias("op"), F.when(d % 7 == 0, "proposed").otherwise("applied").alias("status"), F.lit("r").alias("reason"))
    return ledger.overlay(conflicts, patches).groupBy("kind", "status", "problem").agg(F.count("*").alias("n"))


def conflict_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to review for pairs of neighbouring documents, by severity and number of targets."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "source", (F.col("doc_id") % 9).alias("page"))
    pairs = docs.select(F.col("unit_id").alias("conflict_id"), _pick(("numeric_mismatch", "textual_divergence"), "unit_id").alias("kind"), F.col("unit_id").alias("left_id"), (F.col("unit_id") + 1).alias("right_id"))
    return ledger.conflict_reviews(pairs, docs).groupBy("severity", F.size("targets").alias("targets")).agg(F.count("*").alias("n"))


def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batches whose turns are events."""
    e = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("batch"), F.col("turn").alias("seq"), F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), "planned").otherwise(F.element_at(F.array(*map(F.lit, ledger.BATCH_STATES)), F.least(F.col("turn") + 1, F.lit(3)).cast("int"))).alias("state"))
    return ledger.batch_states(e).groupBy("state", "skipped").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        visual_pages, asset_cues, visual_question_index, chapter_carry_forward, lecture_markers, lecture_pairs, orphan_solutions, math_spans, math_hazards, message_codes, path_chapters, opened_files,
        claims_located, claims_verified, multi_column, merged_quality, gate_decision, answer_rank, extraction_scores, leaking_units, qa_pair_scores, extraction_retrieval, question_types, patch_replay,
        conflict_overlay, conflict_reviews, batch_states,
    )
}

_CARRY = """with p as (select case when conv_id % 5 = 0 then 'ch0' || (conv_id % 9 + 1) else 'notes' end || '_' || conv_id as file, turn as page, case when turn % 3 = 1 then 'Chapter ' || (conv_id % 7 + turn) || chr(10) else '' end || 't' as text,
  case when turn % 3 = 1 then conv_id % 7 + turn when conv_id % 5 = 0 then conv_id % 9 + 1 end as own from conversations)
select file, page, text, coalesce(c, 1)::int as chapter, c is null as guessed from (select *, last_value(own ignore nulls) over (partition by file order by page rows unbounded preceding) as c from p)"""
_MARKS = """m as (select 'f' || (conv_id % 40) as file, conv_id * 100 + turn as page, case when conv_id % 3 = 0 then 'quiz' else 'example' end as kind, (conv_id % 11 + 1)::int as chapter, (turn // 2 + 1)::int as num,
  case when turn % 2 = 1 then 'solution' else 'problem' end as role from conversations where not (turn % 2 = 0 and conv_id % 4 = 0))"""

ORACLE = {
    "visual_pages": rf"""with h as (select doc_id, text || ' ' || {SQL_HINTS} as t from documents), l as (select doc_id, lower(t) as l, ' ' || regexp_replace(lower(t), '[^a-z0-9]', ' ', 'g') || ' ' as w, t from h),
k as (select *, list_filter([case when l like '%chart%' and regexp_matches(l, '(^|[^a-z0-9])(chart|bar chart|pie chart)([^a-z0-9]|$)') then 'chart' end,
  case when regexp_matches(l, '(^|[^a-z0-9])circuit([^a-z0-9]|$)') then 'circuit' end, case when regexp_matches(l, '(^|[^a-z0-9])(diagram|schematic|state machine)([^a-z0-9]|$)') then 'diagram' end,
  case when regexp_matches(l, '(^|[^a-z0-9])(figure|fig\.|illustration)([^a-z0-9]|$)') then 'figure' end, case when regexp_matches(l, '(^|[^a-z0-9])(flowchart|flow chart)([^a-z0-9]|$)') then 'flowchart' end,
  case when regexp_matches(l, '(^|[^a-z0-9])(geometry|venn)([^a-z0-9]|$)') then 'geometry' end, case when regexp_matches(l, '(^|[^a-z0-9])(graph|curve|waveform)([^a-z0-9]|$)') then 'graph' end, case when regexp_matches(l, '(^|[^a-z0-9])map([^a-z0-9]|$)') then 'map' end,
  case when regexp_matches(l, '(^|[^a-z0-9])(plot|scatter|sample path)([^a-z0-9]|$)') then 'plot' end, case when regexp_matches(l, '(^|[^a-z0-9])(screenshot|console output)([^a-z0-9]|$)') then 'screenshot' end,
  case when regexp_matches(l, '(^|[^a-z0-9])(table|tabular)([^a-z0-9]|$)') or len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S[ \t]{{5,}}\S'))) >= 3 then 'table' end,
  case when regexp_matches(l, '(^|[^a-z0-9])tree([^a-z0-9]|$)') then 'tree' end], lambda x: x is not null) as kinds from l)
select doc_id, doc_id % 50 = 0 or doc_id % 6 >= 4 or regexp_matches(l, '(^|[^a-z0-9])(figure|fig\.?|table)\s*[0-9]') or regexp_matches(l, '(^|[^a-z0-9])(x-axis|y-axis|legend|axis)([^a-z0-9]|$)') or len(kinds) > 0 as has_visual, array_to_string(kinds, ',') as kinds from k""",
    "asset_cues": rf"""with h as (select doc_id, lower(text || ' ' || {SQL_HINTS}) as t from documents),
m as (select doc_id, replace(replace(replace(replace(replace(t, 'table of contents', ' '), 'figure it out', ' '), 'figure out', ' '), 'graph theory', ' '), 'figure caption', ' ') as t from h),
s as (select doc_id, t, regexp_matches(t, 'venn|at right|to the right|shown (on the right|below|above)|as shown|\bshaded?\b|(figure|diagram|table|image|picture|chart|graph|tree|plot)s?\s+(below|above|at right|to the right)|(shown|given)\s+in\s+(figure|table|fig\.?)') as a from m)
select doc_id, a as as_text, a or regexp_matches(t, '\b(diagram|figure|table|graph|plot|tree|circuit|draw|drawn|axes|rectangle|triangle|histograms?|flow\s*charts?)\b|(see|on)\s+(the\s+)?(next|previous)\s+page|matrix\s+(below|above|shown)') as as_page from s""",
    "chapter_carry_forward": _CARRY,
    "lecture_markers": f"with {_MARKS} select kind, chapter, role, count(*)::bigint as n from m group by 1, 2, 3",
    "lecture_pairs": f"""with {_MARKS}, p as (select kind, chapter, num, file, min(page) as page from m where role = 'problem' group by 1, 2, 3, 4), f as (select kind, chapter, num, count(*) as files from p group by 1, 2, 3),
s as (select kind, chapter, num, file, min(page) as page from m where role = 'solution' group by 1, 2, 3, 4), o as (select kind, chapter, num, min(file) as file, arg_min(page, file) as page from s group by 1, 2, 3)
select p.kind, p.chapter, p.num, p.file, p.page, case when s.page is not null then p.file when files = 1 then o.file end as answer_file, coalesce(s.page, case when files = 1 then o.page end) as answer_page, files > 1 as ambiguous
from p join f using (kind, chapter, num) left join s using (kind, chapter, num, file) left join o on o.kind = p.kind and o.chapter = p.chapter and o.num = p.num""",
    "orphan_solutions": f"with {_MARKS} select distinct kind, chapter, num from m where role = 'solution' except select kind, chapter, num from m where role = 'problem'",
    "message_codes": """with m as (select list_extract(['unsafe_control_text', 'formula_or_math', 'missing_answer', 'subjective_keywords_missing', 'chapter_mapping', 'visual_asset', 'review_pending', 'other', 'formula_or_math'], (doc_id % 9 + 1)::int) as code, case when doc_id % 9 in (0, 2) then 'blocking' else 'warning' end as severity from documents) select code, severity, count(*)::bigint as n from m group by 1, 2""",
    "path_chapters": "select doc_id, (case doc_id % 5 when 0 then doc_id when 1 then doc_id when 2 then 3 when 3 then doc_id end)::int as chapter from documents",
    "opened_files": "select distinct user_id, 'ch' || (user_id % 10) || '.md|dir' || (user_id % 10) || '|*.md' as files from events",
    "claims_verified": """with u as (select doc_id as c, source, substring(text, 1, 300) as t, case when doc_id % 9 = 0 then 'nowhere to be found' when doc_id % 9 = 1 then ' ' else substring(text, 5, 12) end as quote, case when doc_id % 5 = 0 then 'formula' else 'text' end as kind from documents),
p as (select case when c % 37 = 0 then 'unit_stale' when c % 23 = 0 then 'source_stale' when c % 19 = 0 then 'payload_changed' when substring(t, 5, length(quote)) <> quote then 'quote_changed' when c % 31 = 0 then 'student_attempt' when c % 29 = 0 then 'tainted_asset'
  when c % 3 = 0 and kind <> 'formula' then 'role_mismatch' end as problem from u) select problem, count(*)::bigint as n from p group by 1""",
    "extraction_scores": """with c as (select conv_id as c, turn as k from conversations),
j as (select *, c % 13 <> 0 as f from c), r as (
  select 'chapter' as metric, count(*) filter (f and c % 5 = (c + (k = 2)::int) % 5)::bigint as hits, count(*)::bigint as total from j where c % 6 <> 0
  union all select 'provenance', count(*) filter (f and (c % 3 = 0) = (c % 4 = 0))::bigint, count(*)::bigint from j
  union all select 'visual', count(*) filter (f and k % 2 = 0 and c % 2 = 0 and c % 8 <> 0 and c % 7 <> 0)::bigint, count(*)::bigint from j where k % 3 = 0)
select hits, total, round(coalesce(hits / nullif(total, 0), 0), 6) as share, metric from r""",
    "leaking_units": "select conv_id || '-' || turn as unit_id from conversations where conv_id % 13 <> 0 and turn % 4 = 1 and (role = 'assistant' or (conv_id % 2 = 0 and (conv_id % 8 = 0 or conv_id % 10 = 0)))",
    "qa_pair_scores": """with c as (select count(*) filter (turn % 2 = 1 and turn % 3 <> 0)::bigint as tp, count(*) filter (turn % 2 <> 1 and turn % 3 <> 0)::bigint as fp, count(*) filter (turn % 2 = 1 and turn % 3 = 0)::bigint as fn from conversations where turn >= 1)
select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""",
    "conflict_overlay": """with o as (select list_extract(['answer_mismatch', 'textual_divergence', 'provenance_mismatch'], (o_orderkey % 3 + 1)::int) as kind, case when o_orderkey % 2 = 0 and o_orderkey % 7 <> 0 then list_extract(['mark_resolved', 'x', 'mark_unrecoverable', 'x', 'replace_unit'], (o_orderkey % 5 + 1)::int) end as op from orders),
s as (select kind, case when op = 'mark_resolved' and kind <> 'answer_mismatch' then 'resolved_keep_both' when op = 'mark_unrecoverable' then 'unrecoverable' else 'unresolved' end as status, case when op = 'mark_resolved' and kind = 'answer_mismatch' then 'blocking_needs_correction' end as problem from o)
select kind, status, problem, count(*)::bigint as n from s group by 1, 2, 3""",
    "conflict_reviews": """with p as (select a.doc_id, case when a.doc_id % 2 = 0 then 'blocking' else 'warning' end as severity, unnest(case when b.source is null then [a.source] when a.source = b.source then [a.source] else [a.source, b.source] end) as source, case when a.source = b.source then 2 else 1 end as targets from documents a left join documents b on b.doc_id = a.doc_id + 1)
select severity, targets::int as targets, count(*)::bigint as n from p group by 1, 2""",
    "claims_located": """with s as (select doc_id as claim_id, text, case when doc_id % 9 = 0 then 'nowhere to be found' when doc_id % 9 = 1 then ' ' else substring(text, 5, 12) end as quote, case when doc_id % 2 = 0 then (doc_id % 4 + 2)::int end as given from documents),
p as (select *, instr(text, quote) as pos, case when text is null or text = '' then 'payload_missing' when trim(coalesce(quote, '')) = '' then 'quote_blank' when given is not null and substring(text, given + 1, length(quote)) <> quote then 'quote_not_at_start'
  when given is null and instr(text, quote) = 0 then 'quote_absent' when given is null and instr(substring(text, instr(text, quote) + 1), quote) > 0 then 'quote_ambiguous' end as problem from s)
select claim_id, case when problem is null then coalesce(given, pos - 1) end::int as "start", case when problem is null then coalesce(given, pos - 1) + length(quote) end::int as "end", problem from p""",
    "multi_column": """with b as (select l_orderkey as page, l_linenumber, case when l_linenumber % 2 = 0 then 100.0::double else 0 end * (l_orderkey % 3) as x0, l_linenumber * 10.0::double * case when l_orderkey % 2 = 0 then 1.0::double else 0.2::double end as y0 from lineitem),
r as (select page, x0, x0 + 80 as x1, y0, y0 + 25 as y1, count(*) over (partition by page) as n, max(x0 + 80) over (partition by page) - min(x0) over (partition by page) as width from b),
w as (select *, row_number() over o as k, max(x1) over l as lx, min(x0) over r as rx, min(y0) over l as ly0, max(y1) over l as ly1, min(y0) over r as ry0, max(y1) over r as ry1 from r
  window o as (partition by page order by x0, y0), l as (partition by page order by x0, y0 rows between unbounded preceding and current row), r as (partition by page order by x0, y0 rows between 1 following and unbounded following)),
p as (select page, bool_or(coalesce(n >= 4 and k >= 2 and n - k >= 2 and rx - lx >= 0.03 * width and least(ly1, ry1) - greatest(ly0, ry0) >= 0.25 * least(ly1 - ly0, ry1 - ry0), false)) as multi_column from w group by 1)
select multi_column, count(*) as n from p group by 1""",
    "merged_quality": """select doc_id, least(doc_id * 3 % 101, doc_id * 4 % 101) as score,
  array_to_string(list_filter([case when doc_id % 4 = 0 or doc_id % 5 = 0 then 'no_text' end, case when doc_id % 3 = 0 or doc_id % 4 = 0 then 'table_hint' end, case when doc_id % 5 = 0 or doc_id % 6 = 0 then 'own_reason' end], lambda x: x is not null), ',') as reasons,
  list_extract(['fast', 'recover', 'review'], greatest(doc_id % 2, doc_id % 3)::int + 1) as route from documents""",
    "answer_rank": f"""with {corpus._QUESTIONS}, {corpus._INDEX}, {corpus._BM25}, {corpus._RUNS}, p as (select distinct item_id as query_id, doc_id from wr join br using (run))
select query_id, min(rank)::int as rank, count(*) as found from ranked join p using (query_id, doc_id) where rank <= 20 group by 1""",
    "extraction_retrieval": f"""with {corpus._QUESTIONS}, {corpus._INDEX}, {corpus._BM25}, {corpus._LISTS}, {corpus._RUNS}, f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 12) as score from lists group by 1, 2),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f qualify rank <= 5), g as (select distinct item_id as query_id, doc_id from wr join br using (run)),
q as (select g.query_id, count(*) as n, count(k.rank) filter (k.rank = 1) as h1, count(k.rank) as h5, min(k.rank) as first from g left join k using (query_id, doc_id) group by 1)
select count(*) as queries, round(avg(round(h1 / n, 6)), 6) as recall_at_1, round(avg(round(h5 / n, 6)), 6) as recall_at_5, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr from q""",
    "batch_states": """with e as (select conv_id, turn, case when turn = 1 and conv_id % 3 = 0 then 1 else least(turn + 1, 3) end as s from conversations),
a as (select conv_id, count(*) as n, min(turn) filter (s = 1) as t1 from e group by 1), b as (select a.*, (select min(turn) from e where e.conv_id = a.conv_id and s = 2 and turn > t1) as t2 from a),
c as (select b.*, (select min(turn) from e where e.conv_id = b.conv_id and s = 3 and turn > t2) as t3 from b)
select case when t3 is not null then 'taught' when t2 is not null then 'visual_ready' when t1 is not null then 'planned' end as state, n - (t1 is not null)::int - (t2 is not null)::int - (t3 is not null)::int as skipped, count(*) as n from c group by 1, 2""",
}
ORACLE["visual_question_index"] = ORACLE["visual_pages"].split("select doc_id, doc_id % 50")[0].rstrip() + """,
v as (select doc_id, regexp_matches(l, '(^|[^a-z0-9])(figure|fig\\.?|table)\\s*[0-9]') or regexp_matches(l, '(^|[^a-z0-9])(x-axis|y-axis|legend|axis)([^a-z0-9]|$)') or len(kinds) > 0 as has from k where doc_id % 3 <> 0)
select coalesce(has, false) as visual, coalesce(has, false) and quality <> 1 as suspect, has is null as unscanned, count(*) as n from labels left join v using (doc_id) group by 1, 2, 3"""

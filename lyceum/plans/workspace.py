"""Queries of a study workspace: listings, state commands, calibration, audits, assembly; each has SQL of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions import answers as ans
from lyceum.functions import vocabulary as words
from lyceum.operators import fusion, questions
from lyceum.operators import workspace as ws
from lyceum.plans.study import _bank, _labels
from lyceum.session import prepare, table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(prepare(spark), sf_dir, name)


def _pick(values: tuple, by: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _sql_pick(values: tuple, by: str) -> str:
    listed = ", ".join("null" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], (({by}) % {len(values)} + 1)::int)"


# ---- listings ----


def figure_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual pages of files whose name holds LEC1 in any case: all pages, visual ones, those found by structure only."""
    d = F.col("doc_id")
    kinds = F.filter(F.array(F.when(d % 2 == 0, F.lit("figure")), F.when(d % 3 == 0, F.lit("table"))), lambda k: k.isNotNull())
    pages = _t(spark, sf_dir, "documents").select(F.concat(F.lit("lec"), (d % 30).cast("string")).alias("file"), d.alias("page"), kinds.alias("kinds"))
    totals = pages.groupBy("file").agg(F.count("*").alias("pages_total"))
    return ws.figure_counts(ws.figure_pages(pages.where("page % 5 <> 0"), file="LEC1"), totals)


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that show a table."""
    d = F.col("doc_id")
    kinds = F.filter(F.array(F.when(d % 2 == 0, F.lit("figure")), F.when(d % 3 == 0, F.lit("table"))), lambda k: k.isNotNull())
    return ws.figure_pages(_t(spark, sf_dir, "documents").select(d.alias("page"), kinds.alias("kinds")), kind="table").select("page")


def image_question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each chapter that need a picture, may need one, or are suspects."""
    p = F.col("p_partkey")
    bank = _t(spark, sf_dir, "part").select(
        F.when(p % 97 != 0, p).alias("id"), F.when(p % 3 != 0, F.col("p_size")).alias("chapter"), F.when(p % 2 == 0, p % 4).alias("phase"), F.when(p % 5 != 4, p % 5 == 0).alias("requires_assets"), (p % 7 == 1).alias("maybe_requires_assets")
    )
    suspects = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), _pick(("quiz_bank", "teaching_examples", None, "teaching_examples"), F.col("l_partkey")).alias("source_layer"))
    return ws.image_question_counts(bank, suspects)


def pending_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress through a roster of orders by priority, from records of other revisions and of unknown items as well."""
    k = F.col("o_orderkey")
    orders = _t(spark, sf_dir, "orders")
    roster = orders.select(F.col("o_orderpriority").alias("chapter"), k.alias("id"), (-k).alias("position"), F.col("o_orderstatus").alias("revision"))
    recorded = orders.where(k % 3 != 0).select(F.col("o_orderpriority").alias("chapter"), F.when(k % 50 == 1, k + 10**9).otherwise(k).alias("id"), F.when(k % 5 == 0, "old").otherwise(F.col("o_orderstatus")).alias("revision"))
    again = recorded.where(F.col("id") % 2 == 0).withColumn("revision", F.lit("older"))
    return ws.pending_items(roster, recorded.unionByName(again))


def question_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of every part as a question, on both sides, and whether its prompt can be shown in full."""
    p = F.col("p_partkey")
    asked = _t(spark, sf_dir, "part").select(p.alias("id"), (p % 4 == 0).alias("requires_assets"), (p % 4 == 1).alias("maybe_requires_assets"), F.when(p % 8 == 2, "stub").when(p % 8 == 3, "full").alias("text_status"))
    lines = _t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ordinal"), F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("path"),
        _pick(("question_context", "figure", "worked_solution", "student_attempt", "answer_context"), F.col("l_orderkey")).alias("role"), (F.col("l_quantity") < 47).alias("usable"),
    )
    tainted = _t(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("path"))
    return ws.question_assets(asked, lines, tainted).select("id", "why", F.array_join("prompt", ",").alias("prompt"), F.array_join("answer", ",").alias("answer"), "complete")


def page_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of files by the side of the items that use them."""
    k = F.col("o_orderkey")
    items = _t(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("source_file"), F.array(k % 400, k % 400 + 1).alias("source_pages"), F.when(k % 3 == 0, F.concat(F.lit("f"), (k % 60).cast("string"))).alias("answer_file"), F.array(k * 7 % 900).alias("answer_pages")
    )
    return ws.page_sides(items)


# ---- state commands ----


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    said = _pick(("corrected", "已复盘", "resolved", " reviewed ", "no such word"), s)
    return _t(spark, sf_dir, "supplier").select(s.alias("seq"), F.when(s % 3 == 0, F.col("s_nationkey") + F.when(s % 2 == 0, 20).otherwise(0)).cast("long").alias("id"), F.when(s % 3 == 1, s * 20).alias("index"), said.alias("status"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select((c + 1).alias("position"), F.when(c % 4 != 0, F.col("c_nationkey").cast("long")).alias("id"), F.lit("to_review").alias("status"), F.col("c_name").alias("note"))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after commands by id and by place."""
    return ws.set_statuses(_log(spark, sf_dir).drop("note"), _commands(spark, sf_dir), words.ROW_STATUSES)


def status_command_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that name no entry."""
    return ws.command_problems(_log(spark, sf_dir), _commands(spark, sf_dir))


def window_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of window statuses, and why some are refused."""
    window = _t(spark, sf_dir, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") % 900).cast("string")).alias("point"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("chapter"))
    k = F.col("o_orderkey")
    said = _pick(("in_window", "窗口外", "verified by quiz", "nonsense"), k)
    commands = _t(spark, sf_dir, "orders").select(k.alias("seq"), F.concat(F.lit("p"), (k % 1000).cast("string")).alias("point"), F.when(k % 2 == 0, "BUILDING").alias("chapter"), said.alias("status"))
    return ws.window_transitions(window, commands, words.WINDOW_STATUSES)


def appended_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with new entries behind it."""
    s = F.col("s_suppkey")
    new = _t(spark, sf_dir, "supplier").select(s.alias("seq"), F.col("s_nationkey").cast("long").alias("id"), F.when(s % 4 == 0, "  ").when(s % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "s_name")).alias("note"))
    return ws.append_rows(_log(spark, sf_dir), new, "to_revisit")


def dependency_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of users' events, full after 64."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("previous"), F.lit("x").alias("current"))
    return ws.dependency_events(e)


# ---- calibration ----


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = F.col("doc_id")
    key = [F.concat(F.lit("c"), (d % 3).cast("string")).alias("course"), d.cast("string").alias("item_id")]
    scores = _t(spark, sf_dir, "labels").select(*key, (F.col("toxic") == 1).alias("judge_error"), (F.col("quality") == 1).alias("right"))
    scores = scores.unionByName(scores.where("item_id like '%7'"))
    docs = _t(spark, sf_dir, "documents")
    return scores, docs.where("doc_id % 13 <> 0").select(*key, F.col("lang").alias("answer")), docs.where("doc_id % 17 <> 0").select(*key, (d % 3 != 1).alias("answerable"))


def calibration_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps verdicts from being calibrated, counted."""
    return ws.pool_problems(*_verdicts(spark, sf_dir), ["course", "item_id"])


def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty verdicts in four strata: a stated sample size."""
    scores, answers, gold = _verdicts(spark, sf_dir)
    pool = ws.calibration_pool(scores.distinct(), answers, gold, ["course", "item_id"])
    return ws.calibration_sample(pool, 60, "seed", ["course", "item_id"]).select("course", "item_id", "answerable", "right", "stratum", "answer")


def calibration_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty verdicts, half of them right."""
    scores, answers, gold = _verdicts(spark, sf_dir)
    pool = ws.calibration_pool(scores.distinct(), answers, gold, ["course", "item_id"])
    return ws.calibration_sample(pool, 40, "seed", ["course", "item_id"], two_strata=True).select("course", "item_id", "right", "stratum")


def significance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether differences count, by language."""
    d = F.col("doc_id")
    flag = ws.significant(d % 100 / 1000.0, (d % 7 - 3) / 10.0, (d % 7 - 2) / 10.0)
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(flag).alias("significant"), F.count("*").alias("n"))


def vote_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a conversation's turns that agree with its majority on being short."""
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.length("text") < 200).alias("ones"), F.count_if(F.col("turn") > 0).alias("votes"))
    return rows.select("conv_id", F.round(ans.agreement(F.least("ones", "votes"), F.col("votes")), 6).alias("agreement"))


def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of workspaces whose inputs are documents, some of them absent."""
    d = F.col("doc_id")
    files = _t(spark, sf_dir, "documents").where("doc_id % 11 <> 0").select(F.floor(d / 4).alias("workspace"), _pick(ws.RUN_INPUTS, d).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return ws.inputs_digest(files)


SAID = ("You've hit your limit", "API Error: overloaded", "the answer is 4", "Rate limited, retry", "prompt is too long", "你已达到上限", None, "resets at noon", "temporarily limiting")


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by what went wrong with their run."""
    said = _pick(SAID, F.col("o_orderkey"))
    rows = _t(spark, sf_dir, "orders").select(words.error_class(said).alias("kind"), words.is_infra_error(said).alias("infra"), words.model_family(_pick(("claude-x", "Gemini 2", "gpt-4", None, "other", "mock-1"), F.col("o_custkey"))).alias("family"))
    return rows.groupBy("kind", "infra", "family").agg(F.count("*").alias("n"))


MODE_WORDS = ("from_scratch", " 零基础从头讲 ", "Teach from Scratch", "panic", "sprint", "mock", "Mid-Course", "dunno", None)
TIER_WORDS, LANGUAGE_WORDS = ("le1d", "今天", "3-7 Days", "7天以上", "never"), ("zh", "ENGLISH", "中英双语", "Bilingual", "klingon")


def canonical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes, tiers and languages in many words, as codes."""
    k = F.col("o_orderkey")
    mode, tier, lang = words.canonical_mode(_pick(MODE_WORDS, k)), words.canonical(_pick(TIER_WORDS, k), words.TIERS), words.canonical(_pick(LANGUAGE_WORDS, F.col("o_custkey")), words.LANGUAGES)
    rows = _t(spark, sf_dir, "orders").select(mode.alias("m"), tier.alias("t"), lang.alias("l"))
    return rows.groupBy(F.col("m.code").alias("mode"), F.col("m.tier").alias("implied_tier"), F.col("m.known").alias("mode_known"), F.col("t.code").alias("tier"), F.col("l.code").alias("lang"), F.col("l.known").alias("lang_known")).agg(F.count("*").alias("n"))


# ---- audits ----


def fusion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused lists of orders' lines that were tampered with, by what the recomputation finds."""
    rows = _t(spark, sf_dir, "lineitem")
    best = rows.groupBy(F.col("l_linestatus").alias("backend"), F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.min("l_linenumber").alias("rank"))
    fused = fusion.rrf(best).drop("components")
    q = F.col("query_id")
    claimed = fused.where((q % 11 != 0) | (F.col("rank") != 2)).withColumn("score", F.when(q % 7 == 0, F.col("score") + 0.5).otherwise(F.col("score"))).withColumn("doc_id", F.when((q % 13 == 0) & (F.col("rank") == 1), F.lit(-1)).otherwise(F.col("doc_id")))
    extra = claimed.where((q % 5 == 0) & (F.col("rank") == 1)).withColumn("rank", F.lit(9))
    return ws.fusion_audit(claimed.unionByName(extra), fused).groupBy("problem").agg(F.count("*").alias("n"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    return _t(spark, sf_dir, "orders").select(
        F.when(k % 500 == 3, F.lit(1)).otherwise(k).alias("query_id"), F.col("o_orderpriority").alias("course_id"), F.when(k % 90 == 7, " ").otherwise(F.col("o_orderstatus")).alias("query"), (k % 6 != 0).alias("answerable"),
        F.when(k % 8 == 0, none).when(k % 40 == 1, F.array(text(k % 2500), text(k % 2500))).otherwise(F.array(text(k % 2500))).alias("relevant"), F.when(k % 30 == 5, F.array(text(k % 2500))).otherwise(F.array(text(k % 2600 + 1), text(k % 9))).alias("hard_negative"),
        F.when(k % 70 == 9, F.array(F.lit("t"), F.lit("t"))).alias("tags"),
    )


def gold_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold queries that break their contract, by rule."""
    courses = _gold(spark, sf_dir).select("course_id").distinct().where("course_id <> '5-LOW'")
    return ws.gold_problems(_gold(spark, sf_dir), courses).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def index_binding_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that an index of parts does not hold, or holds on the answer side."""
    p = F.col("p_partkey")
    index = _t(spark, sf_dir, "part").select((p - F.when(p % 400 == 1, 1).otherwise(0)).alias("doc_id"), F.when(p % 10 == 0, "answer").otherwise("text").alias("kind"), F.array(p.cast("string"), (p + 1).cast("string")).alias("unit_ids"))
    return ws.index_binding_problems(_gold(spark, sf_dir), index).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def receipt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made of orders' lines against their queries, by rule."""
    gold = _t(spark, sf_dir, "orders").where("o_orderkey % 31 <> 0").select(F.col("o_orderkey").alias("query_id"))
    lines = _t(spark, sf_dir, "lineitem").where("l_orderkey % 29 <> 0").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 40).alias("doc_id"), (F.col("l_orderkey") % 23 == 0).alias("abstain"))
    quiet = _t(spark, sf_dir, "orders").where("o_orderkey % 29 = 1").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 10**8).otherwise(0)).alias("query_id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("doc_id"), (F.col("o_orderkey") % 3 == 0).alias("abstain"))
    return ws.receipt_problems(gold, lines.unionByName(quiet)).groupBy("rule").agg(F.count("*").alias("n"))


# ---- assembly ----


def phase_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of nations' sections with their phase; a page of two sections goes by the later one."""
    n = F.col("n_nationkey")
    key = lambda a, b: F.struct(a.alias("file"), b.cast("int").alias("page"))
    sections = _t(spark, sf_dir, "nation").select(n.alias("position"), F.when(n % 3 != 0, F.col("n_regionkey") + 8).alias("chapter"), F.array(key(F.lit("a\\b"), n), key(F.lit("a/b"), n + 1), key(F.col("n_name"), n * 2)).alias("page_keys"))
    return ws.phase_map(sections)


def question_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their place and their text with options."""
    bank = _bank(spark, sf_dir)
    p = F.col("p_partkey")
    return bank.select("p_partkey", ws.question_ordinal(F.when(p % 5 != 0, F.col("id")), p).alias("ordinal"), ws.question_text(F.when(p % 7 != 0, F.col("question")), F.col("options")).alias("text"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("conv_id"), F.col("turn")
    return _t(spark, sf_dir, "conversations").select(
        F.concat_ws("-", c, k).alias("unit_id"), F.when(F.col("role") == "assistant", "answer").otherwise("question").alias("kind"), F.when(k % 4 != 3, F.concat_ws("-", c, k + 1)).alias("paired_unit_id"), F.col("text"), (c % 7).alias("source_id"), (c % 2).cast("string").alias("source_sha256")
    )


def conflict_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their answer and the rank of their source's revision."""
    ranks = prepare(spark).createDataFrame([(1, "1", 3, "syllabus"), (2, "0", 2, "recent"), (3, "x", 9, "no")], "source_id long, source_sha256 string, rank int, basis string")
    return ws.conflict_members(_paired(spark, sf_dir), ranks)


def generation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a benchmark run in stages, counted."""
    spark = prepare(spark)
    items = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "algo").otherwise("psyc").alias("course"), F.col("o_orderkey").alias("item_id"))
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    said = _pick(SAID, F.col("o_orderkey"))
    failed = _t(spark, sf_dir, "orders").where(words.is_infra_error(said)).select(F.lit("algo").alias("course"), F.lit("a").alias("model"), F.col("o_orderkey").alias("item_id"))
    return ws.generation_tasks(items, models, failed, "psyc").groupBy("stage", "course", "model", "arm").agg(F.count("*").alias("n"), F.max("item_id").alias("last_item"))


def provenance_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose marks of a generated answer contradict each other."""
    p = F.col("p_partkey")
    flag, source, answer = F.when(p % 3 != 0, p % 3 == 1), _pick(("lecture", "ai_generated", "mixed", None), p), _pick(("source", "ai_generated", "ai_supplemented", None, "source"), p)
    return _t(spark, sf_dir, "part").groupBy(questions.ai_provenance_problem(flag, source, answer).alias("problem")).agg(F.count("*").alias("n"))


def difficulty_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why questions are hard: everything readable counts, and answer pages come as lists."""
    bank = _bank(spark, sf_dir).withColumn("chapter_no", F.col("p_size")).withColumn("explanation", F.when(F.col("p_partkey") % 9 == 0, "by recursion, maximize it"))
    q = {c: F.col(c) for c in ("knowledge_points", "requires_assets", "type", "chapter_no")}
    text = questions.readable({c: F.col(c) for c in ("question", "explanation", "answer", "keywords", "options")})
    pages = F.array(F.col("p_partkey") % 4, F.col("p_partkey") % 6)
    level, points, reason = questions.difficulty(q | {"text": text, "multipage": questions.many_pages(pages, "list")}, F.lit(30))
    return bank.select("id", level.alias("difficulty"), points.alias("points"), reason.alias("reason"))


# ---- answers ----


def answer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in several forms through the whole ladder: value, verbatim gold, hedges, abstentions, verdicts."""
    c, k, n = F.col("conv_id"), F.col("turn"), F.length("text")
    numeric = k % 3 == 0
    form = F.when(numeric, (c * 7 + k) % 4).otherwise((c * 7 + k) % 5)
    said = (
        F.when(form == 0, F.concat(F.lit("the answer is "), n.cast("string"))).when(form == 1, F.concat(F.lit("not sure, maybe "), n.cast("string"), F.lit(".5")))
        .when(form == 2, F.concat(F.lit("not covered; I checked all "), n.cast("string"), F.lit(" lectures"))).when(form == 3, "Surely \"blue horse\" it is").otherwise("It is not the Blue horse.")
    )
    votes = k % 4
    rows = _t(spark, sf_dir, "conversations").select(
        ((c + k) % 5 != 0).alias("answerable"), F.when(numeric, "numeric").otherwise("factual").alias("answer_type"), said.alias("said"), n.cast("double").alias("gold_value"), F.when(c % 2 == 0, 0.5).alias("tolerance"),
        votes.alias("votes"), F.least(c % 3, votes).alias("votes_for"), F.when(c % 5 == 0, votes).otherwise(0).alias("votes_abstained"), (c % 4 / 3.0).alias("faithful"),
    )
    x = F.col("said")
    found = {k: F.col(k) for k in ("answerable", "answer_type", "votes", "votes_for", "votes_abstained", "faithful")}
    found |= {"abstained": ans.abstained(x), "hedged": ans.hedged_of(x), "numeric_ok": ans.numeric_ok(ans.final_number_of(x), F.col("gold_value"), F.col("tolerance")), "has_gold": ans.contains_gold_of(x, F.lit("blue horse"))}
    out = rows.select(ans.decide(found).alias("d")).select("d.*")
    return out.groupBy("correct", "abstained", "hallucinated", "scored_by").agg(F.count("*").alias("n"), F.round(F.sum("faithfulness"), 4).alias("faithfulness"), F.round(F.sum("self_consistency"), 4).alias("self_consistency"))


def quality_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labels a length rule meets, by language: a calibration table."""
    rows = _labels(spark, sf_dir).select("lang", ((F.col("n_chars") > 400) == (F.col("quality") == 1)).alias("same"))
    return rows.groupBy("lang").agg(F.count_if("same").alias("same"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        figure_page_counts, table_pages, image_question_counts, pending_examples, question_assets, page_sides, status_updates, status_command_problems, window_transitions, appended_entries, dependency_histories,
        calibration_problems, calibration_sample, calibration_halves, significance_flags, vote_agreement, run_digests, error_classes, canonical_words, fusion_audit, gold_problems, index_binding_problems, receipt_problems,
        phase_map, question_places, conflict_members, generation_tasks, provenance_problems, difficulty_reasons, answer_decisions, quality_agreement,
    )
}

_VERDICTS_SQL = """
s0 as (select 'c' || (doc_id % 3) as course, doc_id::varchar as item_id, toxic = 1 as judge_error, quality = 1 as "right" from labels),
sc as (select * from s0 union all select * from s0 where item_id like '%7'),
an as (select 'c' || (doc_id % 3) as course, doc_id::varchar as item_id, lang as answer from documents where doc_id % 13 <> 0),
go as (select 'c' || (doc_id % 3) as course, doc_id::varchar as item_id, doc_id % 3 <> 1 as answerable from documents where doc_id % 17 <> 0),
pool as (select distinct course, item_id, "right", answer, answerable, md5('seed|' || course || '|' || item_id) as place from (select distinct * from s0) join an using (course, item_id) join go using (course, item_id) where not judge_error)
"""
_ROW_SQL = "case trim(status) " + " ".join(f"when '{w}' then '{code}'" for code, names in words.ROW_STATUSES.items() for w in (code, *names)) + " else trim(status) end"
_COMMANDS_SQL = f"""
cmd as (select s_suppkey as seq, case when s_suppkey % 3 = 0 then s_nationkey + case when s_suppkey % 2 = 0 then 20 else 0 end end::bigint as id, case when s_suppkey % 3 = 1 then s_suppkey * 20 end as index,
  {_sql_pick(("corrected", "已复盘", "resolved", " reviewed ", "no such word"), "s_suppkey")} as status from supplier),
log as (select c_custkey + 1 as position, case when c_custkey % 4 <> 0 then c_nationkey end::bigint as id, 'to_review' as status, c_name as note from customer)
"""
_GOLD_SQL = """
gold as (select case when o_orderkey % 500 = 3 then 1 else o_orderkey end as query_id, o_orderpriority as course_id, case when o_orderkey % 90 = 7 then ' ' else o_orderstatus end as query, o_orderkey % 6 <> 0 as answerable,
  case when o_orderkey % 8 = 0 then []::varchar[] when o_orderkey % 40 = 1 then [(o_orderkey % 2500)::varchar, (o_orderkey % 2500)::varchar] else [(o_orderkey % 2500)::varchar] end as relevant,
  case when o_orderkey % 30 = 5 then [(o_orderkey % 2500)::varchar] else [(o_orderkey % 2600 + 1)::varchar, (o_orderkey % 9)::varchar] end as hard_negative, o_orderkey % 70 = 9 as tags_twice from orders)
"""
_INFRA = "(" + " or ".join(f"contains(lower(said), '{m}')" for m in words.INFRA_ERRORS) + ")"
_PROVENANCE = {"flag": "case when p_partkey % 3 <> 0 then p_partkey % 3 = 1 end", "source": _sql_pick(("lecture", "ai_generated", "mixed", None), "p_partkey"), "answer": _sql_pick(("source", "ai_generated", "ai_supplemented", None, "source"), "p_partkey")}


def _words_sql(column: str, known: dict[str, tuple[str, ...]]) -> str:
    pairs = sorted({(w.lower(), code) for code, names in known.items() for w in (code, *names)})
    return f"case lower(trim({column})) " + " ".join(f"when '{w}' then '{code}'" for w, code in pairs) + " end"


ORACLE = {
    "figure_page_counts": """
with p as (select 'lec' || (doc_id % 30) as file, doc_id, doc_id % 2 <> 0 and doc_id % 3 <> 0 as bare from documents)
select file, (select count(*) from p q where q.file = p.file) as pages_total, count(*) as visual, count(*) filter (bare) as structural_only from p where doc_id % 5 <> 0 and file like 'lec1%' group by file
""",
    "table_pages": "select doc_id as page from documents where doc_id % 3 = 0",
    "image_question_counts": """
with s as (select distinct l_partkey as id from lineitem where l_partkey % 4 in (0, 2)), b as (select * from part where p_partkey % 97 <> 0)
select coalesce(case when p_partkey % 3 <> 0 then p_size::varchar end, case when p_partkey % 2 = 0 then (p_partkey % 4)::varchar end, '?') as chapter, count(*) as questions, count(*) filter (p_partkey % 5 = 0) as requires,
  count(*) filter (p_partkey % 7 = 1) as maybe, count(*) filter (s.id is not null) as suspects from b left join s on s.id = p_partkey group by 1
""",
    "pending_examples": """
with o as (select o_orderpriority as chapter, o_orderkey as k, o_orderstatus as st from orders),
r as (select chapter, case when k % 50 = 1 then k + 1000000000 else k end as id, case when k % 5 = 0 then 'old' else st end as rev from o where k % 3 <> 0),
a as (select o.chapter, o.k, exists(select 1 from r where r.chapter = o.chapter and r.id = o.k and r.rev = o.st) as done, exists(select 1 from r where r.chapter = o.chapter and r.id = o.k) as seen from o),
u as (select chapter, count(distinct id) as unexpected from r where id >= 1000000000 group by 1)
select a.chapter, count(*) as total, count(*) filter (done) as completed, count(*) filter (not done) as pending, count(*) filter (not done and seen) as stale, any_value(coalesce(unexpected, 0)) as unexpected,
  max(k) filter (not done) as next_id from a left join u using (chapter) group by 1
""",
    "question_assets": f"""
with l as (select l_partkey as id, l_orderkey, l_linenumber, l_suppkey, 'a' || l_suppkey as path, {_sql_pick(("question_context", "figure", "worked_solution", "student_attempt", "answer_context"), "l_orderkey")} as role, l_quantity < 47 as usable
  from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 9 = 0)),
g as (select id, string_agg(path, ',' order by l_orderkey, l_linenumber, l_suppkey) filter (role in ('question_context', 'figure') and usable) as prompt,
  string_agg(path, ',' order by l_orderkey, l_linenumber, l_suppkey) filter (role in ('worked_solution', 'answer_context') and usable) as answer, count(*) filter (role in ('question_context', 'figure') and not usable) as broken from l group by 1)
select p_partkey as id, case when p_partkey % 4 = 0 then 'requires' when p_partkey % 4 = 1 then 'maybe' when p_partkey % 8 = 2 then 'stub' end as why, coalesce(prompt, '') as prompt, coalesce(answer, '') as answer,
  (p_partkey % 4 > 1 and p_partkey % 8 <> 2) or (prompt is not null and coalesce(broken, 0) = 0) as complete from part left join g on id = p_partkey
""",
    "page_sides": """
with u as (
  select 'f' || (o_custkey % 50) as file, unnest([o_orderkey % 400, o_orderkey % 400 + 1]) as page, true as prompt from orders
  union all select case when o_orderkey % 3 = 0 then 'f' || (o_orderkey % 60) else 'f' || (o_custkey % 50) end, o_orderkey * 7 % 900, false from orders)
select file, page, case when bool_or(prompt) then 'prompt' else 'answer' end as side from u group by 1, 2
""",
    "status_updates": f"""
with {_COMMANDS_SQL}, said as (select seq, id, index, {_ROW_SQL} as new from cmd),
h as (select position, arg_max(new, seq) as new from (
  select log.position, seq, new from log join said on said.id = log.id union all select log.position, seq, new from log join said on said.id is null and said.index = log.position) group by 1)
select position, id, coalesce(new, status) as status from log left join h using (position)
""",
    "status_command_problems": f"""
with {_COMMANDS_SQL}
select * from (select seq, case when id is not null then case when id not in (select id from log where id is not null) then 'no_such_id' end
  when index is null then 'no_locator' when index < 1 or index > (select count(*) from log) then 'index_out_of_range' end as problem from cmd) where problem is not null
""",
    "window_transitions": """
with w as (select 'p' || (c_custkey % 900) as point, case when c_custkey % 5 <> 0 then c_mktsegment end as chapter from customer),
c as (select o_orderkey as seq, 'p' || (o_orderkey % 1000) as point, case when o_orderkey % 2 = 0 then 'BUILDING' end as chapter, o_orderkey % 4 = 3 as odd from orders),
h as (select seq, odd, count(w.point) as hits from c left join w on w.point = c.point and (c.chapter is null or c.chapter = w.chapter) group by 1, 2)
select seq, hits, case when odd then 'status_unknown' when hits = 0 then 'point_unknown' when hits > 1 then 'chapter_needed' end as problem from h
""",
    "appended_entries": """
select c_custkey + 1 as position, case when c_custkey % 4 <> 0 then c_nationkey end::bigint as id, c_name as note, 'to_review' as status from customer
union all select (select max(c_custkey) + 1 from customer) + row_number() over (order by s_suppkey), s_nationkey::bigint, s_name, 'to_revisit' from supplier where s_suppkey % 4 > 1
""",
    "dependency_histories": """
with e as (select user_id as batch, row_number() over (partition by user_id order by event_id) as k, event_type || '|' || case when event_id % 2 = 0 then event_id::varchar else '' end || '|x' as said from events)
select batch, count(*) filter (k <= 64) as kept, count(*) filter (k > 64) as refused, sha256(string_agg(said, chr(10) order by k) filter (k <= 64)) as digest, bool_or(k > 64) as overflow from e group by 1
""",
    "calibration_problems": f"""
with {_VERDICTS_SQL}, good as (select course, item_id from sc where not judge_error), n as (
  select 'answer_repeated' as problem, count(*) as n from (select 1 from an group by course, item_id having count(*) > 1)
  union all select 'score_repeated', count(*) from (select 1 from good group by course, item_id having count(*) > 1)
  union all select 'score_without_answer', count(*) from good anti join an using (course, item_id)
  union all select 'score_without_gold', count(*) from good anti join go using (course, item_id))
select * from n where n > 0
""",
    "calibration_sample": f"""
with {_VERDICTS_SQL}, r as (select *, case when answerable then case when "right" then 0 else 1 end when "right" then 2 else 3 end as stratum from pool),
k as (select *, row_number() over (partition by stratum order by place, course, item_id) as rank from r),
x as (select *, rank > list_extract([20, 20, 10, 10], stratum + 1) as extra from k)
select course, item_id, answerable, "right", stratum, answer from x qualify row_number() over (order by extra, place, course, item_id) <= 60
""",
    "calibration_halves": f"""
with {_VERDICTS_SQL} select course, item_id, "right", case when "right" then 0 else 1 end as stratum from pool qualify row_number() over (partition by "right" order by place, course, item_id) <= 20
""",
    "significance_flags": "select lang, count(*) filter (doc_id % 100 < 50 and (doc_id % 7 - 3 > 0 or doc_id % 7 - 2 < 0)) as significant, count(*) as n from documents group by 1",
    "vote_agreement": """
with v as (select conv_id, count(*) filter (length(text) < 200) as o, count(*) filter (turn > 0) as n from conversations group by 1)
select conv_id, round(case when n > 0 then greatest(least(o, n), n - least(o, n)) / n else 1.0 end, 6)::double as agreement from v
""",
    "run_digests": """
with f as (select doc_id // 4 as workspace, doc_id % 4 as k, sha256(coalesce(text, '')) as sha from documents where doc_id % 11 <> 0),
g as (select workspace, max(sha) filter (k = 0) as a, max(sha) filter (k = 1) as b, max(sha) filter (k = 2) as c, max(sha) filter (k = 3) as d from f group by 1)
select workspace, 'sha256:' || substr(sha256(encode('references/quiz_bank.json') || coalesce(unhex(a), encode('<absent>')) || encode('study_plan.md') || coalesce(unhex(b), encode('<absent>'))
  || encode('study_state.json') || coalesce(unhex(c), encode('<absent>')) || encode('study_progress.md') || coalesce(unhex(d), encode('<absent>'))), 1, 24) as digest from g
""",
    "error_classes": f"""
with s as (select coalesce({_sql_pick(SAID, "o_orderkey")}, '') as said, {_sql_pick(("claude", "gemini", "openai", "unknown", "other", "mock"), "o_custkey")} as family from orders)
select case when contains(lower(said), 'hit your limit') or contains(lower(said), 'usage limit') or contains(lower(said), 'resets ') then 'hard'
  when contains(lower(said), 'temporarily limiting') or contains(lower(said), 'rate limited') or contains(lower(said), 'api error') or contains(lower(said), 'overloaded') then 'transient' else 'ok' end as kind,
  {_INFRA} as infra, family, count(*) as n from s group by 1, 2, 3
""",
    "canonical_words": f"""
with w as (select coalesce({_sql_pick(MODE_WORDS, "o_orderkey")}, '') as m, {_sql_pick(TIER_WORDS, "o_orderkey")} as t, {_sql_pick(LANGUAGE_WORDS, "o_custkey")} as l from orders)
select case m when 'panic' then 'from_scratch' when 'sprint' then 'fill_gaps' when 'mock' then 'fill_gaps' else coalesce({_words_sql("m", words.MODES)}, trim(m)) end as mode, case m when 'panic' then 'le1d' when 'sprint' then 'd1_3' end as implied_tier,
  {_words_sql("m", words.MODES)} is not null as mode_known, coalesce({_words_sql("t", words.TIERS)}, t) as tier, coalesce({_words_sql("l", words.LANGUAGES)}, l) as lang, {_words_sql("l", words.LANGUAGES)} is not null as lang_known, count(*) as n from w group by all
""",
    "fusion_audit": """
with b as (select l_linestatus as backend, l_orderkey as q, l_partkey as d, min(l_linenumber) as rank from lineitem group by 1, 2, 3),
f as (select q, d, round(sum(1.0::double / (60 + rank)), 12) as s from b where rank <= 50 group by 1, 2), t as (select *, row_number() over (partition by q order by s desc, d) as rank from f qualify rank <= 5),
c as (select q, case when q % 13 = 0 and rank = 1 then -1 else d end as d, case when q % 7 = 0 then s + 0.5 else s end as s, rank from t where q % 11 <> 0 or rank <> 2), c2 as (select * from c union all select q, d, s, 9 from c where q % 5 = 0 and rank = 1),
j as (select case when c2.q is null then 'missing' when t.q is null then 'surplus' when c2.d <> t.d then 'doc_id' when c2.s <> t.s then 'score' end as problem from c2 full join t on c2.q = t.q and c2.rank = t.rank)
select problem, count(*) as n from j where problem is not null group by 1
""",
    "gold_problems": f"""
with {_GOLD_SQL}, r as (
  select 'query_id_repeated' as rule, query_id::varchar as key from gold group by query_id having count(*) > 1
  union all select 'course_unknown', query_id::varchar from gold where course_id = '5-LOW' union all select 'query_blank', query_id::varchar from gold where trim(query) = ''
  union all select 'answerable_without_relevant', query_id::varchar from gold where answerable and len(relevant) = 0 union all select 'unanswerable_with_relevant', query_id::varchar from gold where not answerable and len(relevant) > 0
  union all select 'relevant_and_negative', query_id::varchar from gold where list_has_any(relevant, hard_negative) union all select 'relevant_repeated', query_id::varchar from gold where len(list_distinct(relevant)) < len(relevant)
  union all select 'negative_repeated', query_id::varchar from gold where len(list_distinct(hard_negative)) < len(hard_negative) union all select 'tags_repeated', query_id::varchar from gold where tags_twice)
select rule, count(*) as n, min(key) as first_key from r group by 1
""",
    "index_binding_problems": f"""
with {_GOLD_SQL}, i as (select p_partkey - case when p_partkey % 400 = 1 then 1 else 0 end as doc_id, p_partkey % 10 = 0 as answer, unnest([p_partkey::varchar, (p_partkey + 1)::varchar]) as u from part),
lab as (select unnest(relevant) as u, true as rel from gold union all select unnest(hard_negative), false from gold), r as (
  select distinct 'unit_not_indexed' as rule, u as key from lab where u not in (select u from i) union all select distinct 'answer_side_unit', u from lab where rel and u in (select u from i where answer)
  union all select 'doc_id_repeated', doc_id::varchar from i group by doc_id having count(*) > 2)
select rule, count(*) as n, min(key) as first_key from r group by 1
""",
    "receipt_problems": """
with g as (select distinct o_orderkey as q from orders where o_orderkey % 31 <> 0),
r as (select l_orderkey as q, l_linenumber as rank, l_partkey % 40 as d, l_orderkey % 23 = 0 as ab from lineitem where l_orderkey % 29 <> 0
  union all select o_orderkey + case when o_orderkey % 2 = 0 then 100000000 else 0 end, null, null, o_orderkey % 3 = 0 from orders where o_orderkey % 29 = 1),
h as (select q, count(rank) as n, min(rank) as lo, max(rank) as hi, count(distinct rank) as ranks, count(distinct d) filter (rank is not null) as docs, bool_or(ab) as ab from r group by 1), x as (
  select 'query_missing' as rule from g where q not in (select q from h) union all select 'query_unknown' from h where q not in (select q from g)
  union all select 'ranks_not_consecutive' from h where n > 0 and (lo <> 1 or hi <> n or ranks <> n) union all select 'document_repeated' from h where n > 0 and docs < n union all select 'abstain_disagrees' from h where ab <> (n = 0))
select rule, count(*) as n from x group by 1
""",
    "phase_map": """
with s as (select row_number() over (order by n_nationkey) as ph, case when n_nationkey % 3 <> 0 then n_regionkey + 8 end as ch, n_nationkey as k, n_name from nation),
p as (select ph, coalesce(ch, ph) as no, 'a/b' as file, k as page from s union all select ph, coalesce(ch, ph), 'a/b', k + 1 from s union all select ph, coalesce(ch, ph), n_name, k * 2 from s),
m as (select file, page, max(ph) as ph, arg_max(no, ph) as no from p group by 1, 2)
select file, page::int as page, no::varchar as chapter, 'Phase ' || ph as phase, 'ch' || lpad(no::varchar, greatest(2, length(no::varchar))::int, '0') as chapter_id, 'phase' || lpad(ph::varchar, greatest(2, length(ph::varchar))::int, '0') as phase_id from m
""",
    "question_places": """
select p_partkey, case when p_partkey % 5 = 0 then 100000 + p_partkey * 10 else 100000 + ('0x' || substr(sha256(p_partkey::varchar), 1, 14))::bigint * 2 end::bigint as ordinal,
  trim(case when p_partkey % 7 = 0 then '' else p_name || ' ' || p_type || ' ' || list_extract(['integral', 'prove that', 'matrix of a proof', 'plain'], (p_partkey % 4 + 1)::int) end
    || case when p_partkey % 6 = 0 then chr(10) || 'A. A. x' || chr(10) || 'B. B. ' || p_name else '' end, ' ' || chr(10)) as text from part
""",
    "conflict_members": """
with u as (select conv_id || '-' || turn as unit_id, role = 'assistant' as answer, case when turn % 4 <> 3 then conv_id || '-' || (turn + 1) end as paired, conv_id % 7 as s, conv_id % 2 as h from conversations)
select u.unit_id, case when not u.answer then a.unit_id end as answer_id, case when u.s = 1 and u.h = 1 then 3 when u.s = 2 and u.h = 0 then 2 else 0 end as priority_rank, case when u.s = 1 and u.h = 1 then 'syllabus' when u.s = 2 and u.h = 0 then 'recent' else 'unspecified' end as priority_basis
from u left join u a on a.unit_id = u.paired and a.answer
""",
    "generation_tasks": f"""
with i as (select case when o_orderkey % 3 = 0 then 'algo' else 'psyc' end as course, o_orderkey as item_id from orders), m as (select unnest(['a', 'b', 'c']) as model),
f as (select o_orderkey as item_id, coalesce({_sql_pick(SAID, "o_orderkey")}, '') as said from orders), t as (
  select 0 as stage, course, model, 'rawfiles' as arm, item_id from i, m union all select 1, course, model, arm, item_id from i, m, (select unnest(['closedbook', 'skill']) as arm) where course = 'psyc'
  union all select 2, 'algo', 'a', 'material', item_id from f where {_INFRA} union all select 3, course, model, 'material', item_id from i, m where course = 'psyc')
select stage, course, model, arm, count(*) as n, max(item_id) as last_item from t group by 1, 2, 3, 4
""",
    "provenance_problems": f"""
with p as (select {_PROVENANCE["flag"]} as flag, {_PROVENANCE["source"]} as source, {_PROVENANCE["answer"]} as answer from part)
select case when (coalesce(flag, false) or coalesce(source = 'ai_generated', false) or coalesce(answer in ('ai_generated', 'ai_supplemented'), false)) and not coalesce(source in ('ai_generated', 'mixed'), false) then 'ai_answer_provenance_invalid'
  when flag = false and source = 'ai_generated' then 'ai_answer_provenance_conflict' end as problem, count(*) as n from p group by 1
""",
    "difficulty_reasons": """
with b as (select *, p_name || ' ' || p_type || ' ' || list_extract(['integral', 'prove that', 'matrix of a proof', 'plain'], (p_partkey % 4 + 1)::int) || case when p_partkey % 9 = 0 then ' by recursion, maximize it' else '' end as t,
    list_extract(['choice', 'subjective', 'code', 'true_false', 'fill_blank', 'riddle'], (p_partkey % 6 + 1)::int) as type, len(list_distinct(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''))) as kp from part),
f as (select *, list_filter([case when contains(lower(t), 'integral') then '积分' end, case when contains(lower(t), 'prove that') or contains(lower(t), 'proof') then '证明' end,
    case when contains(lower(t), 'recursion') then '递归归纳' end, case when contains(lower(t), 'matrix') then '矩阵' end, case when contains(lower(t), 'maximize') then '优化' end], lambda x: x is not null) as fam from b),
s as (select *, case when kp >= 3 then 2 when kp = 2 then 1 else 0 end as a, least(len(fam), 2) as c, case when p_partkey % 5 = 0 then 1 else 0 end as d, case when p_partkey % 4 <> p_partkey % 6 then 1 else 0 end as e,
    case when p_size >= 30 then 1 else 0 end as g, case when type in ('subjective', 'code') then 1 else 0 end as h from f),
q as (select *, a + c + d + e + g + h as points from s), l as (select *, case when points <= 0 then 1 when points = 1 then 2 when points <= 3 then 3 when points <= 5 then 4 else 5 end as level from q)
select p_partkey::varchar as id, level as difficulty, points::int as points, '启发式下界 d=' || level || '：' || case when points > 0 then array_to_string(list_filter([case when a > 0 then '跨' || kp || '知识点' end, case when c > 0 then '结构:' || array_to_string(fam[1:3], '/') end,
  case when d > 0 then '需读图' end, case when e > 0 then '多页解答' end, case when g > 0 then '章节靠后(ch' || p_size || ')' end, case when h > 0 then '开放题型' end], lambda x: x is not null), '、') else '无高难信号' end as reason from l
""",
    "answer_decisions": """
with r as (select conv_id as c, turn as k, turn % 3 = 0 as num, (conv_id + turn) % 5 <> 0 as ok, case when turn % 3 = 0 then (conv_id * 7 + turn) % 4 else (conv_id * 7 + turn) % 5 end as form, turn % 4 as votes from conversations),
v as (select *, least(c % 3, votes) as vf, case when c % 5 = 0 then votes else 0 end as va, (c % 4) / 3.0::double as fa, form in (1, 2) as ab, form = 1 as hedge, form in (0, 2) or (form = 1 and c % 2 = 0) as value_ok, form = 3 as gold from r),
d as (select *, case when not ok then 'abstention' when num then 'numeric' when gold and not ab then 'lexical' when votes > 0 then 'judge' else 'judge_error' end as scored_by from v),
e as (select *, case scored_by when 'abstention' then ab when 'numeric' then value_ok when 'lexical' then true when 'judge' then vf * 2 >= votes else false end as correct,
  case scored_by when 'numeric' then ab and not hedge when 'judge' then va * 2 >= votes else ab end as abstained from d),
f as (select *, case scored_by when 'abstention' then not ab when 'numeric' then not (correct or abstained) when 'judge' then not (fa >= 0.999 or abstained) else false end as hallucinated,
  case scored_by when 'judge' then fa when 'lexical' then 1.0 when 'judge_error' then null else correct::int::double end as faith, case when scored_by = 'judge' then greatest(vf, votes - vf) / votes end as sure from e)
select correct, abstained, hallucinated, scored_by, count(*) as n, round(sum(faith), 4) as faithfulness, round(sum(sure), 4) as self_consistency from f group by 1, 2, 3, 4
""",
    "quality_agreement": "select lang, count(*) filter ((n_chars > 400) = (quality = 1)) as same, count(*) as n from labels join documents using (doc_id) group by 1",
}

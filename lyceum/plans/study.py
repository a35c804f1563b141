"""Queries of the study families: matrix, statistics, questions, sessions, state, rules, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.functions import answers as ans
from lyceum.functions.text import chapter_key, media_type
from lyceum.operators import constraints as rules
from lyceum.operators import matrix, questions, sessions, state, stats
from lyceum.session import prepare, table
from lyceum.streaming import events as stream


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(prepare(spark), sf_dir, name)


# ---- benchmark matrix: an order is an answer (segment as course, priority as arm, nation's region as model), its lines are its score ----


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, customers, nations = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    key = [F.col("c_mktsegment").alias("course"), F.col("n_regionkey").cast("string").alias("model"), F.col("o_orderpriority").alias("arm"), F.col("o_orderkey").cast("string").alias("item_id")]
    answers = rows.select(
        *key, (F.col("o_orderkey") % 7 != 0).alias("answerable"), F.when(F.col("o_orderkey") % 19 == 0, "infra_error").otherwise("ok").alias("status"), F.round(F.col("o_totalprice") / 1e6, 6).alias("cost_usd")
    )
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.round("l_quantity").cast("long")).alias("quantity"))
    scored = rows.where(F.col("o_orderkey") % 11 != 0).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    scores = scored.select(
        *key, F.lit(None).cast("boolean").alias("answerable"), F.when(F.col("o_orderkey") % 13 != 0, F.col("returned") == 0).alias("correct"), F.round(1 - F.col("returned") / F.col("n"), 4).alias("faithfulness"),
        (F.col("quantity") > 150).alias("hallucinated"), F.when(F.col("o_orderkey") % 5 != 0, F.col("quantity") < 60).alias("abstained"), (F.col("o_orderkey") % 23 == 0).alias("judge_error"),
        F.when(F.col("n") == 1, "lexical").otherwise("judge").alias("scored_by"),
    )
    return answers, scores


def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of every cell."""
    return matrix.cells(matrix.merge_rows(*_runs(spark, sf_dir)))


def matrix_merge_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that contradict the contract of the merge, counted by rule."""
    answers, scores = _runs(spark, sf_dir)
    extra = scores.limit(0).unionByName(scores.where(F.col("item_id").cast("long") % 1000 == 3).withColumn("arm", F.lit("NO SUCH ARM")))
    found = matrix.merge_problems(answers, scores.unionByName(extra))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def cost_per_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cost by course and arm, failed runs left out."""
    return matrix.cost_per_question(matrix.merge_rows(*_runs(spark, sf_dir)))


def ragged_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cells of a course answer the same items."""
    return matrix.ragged(matrix.merge_rows(*_runs(spark, sf_dir)))


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that a resumed run still has to make, by course."""
    answers, scores = _runs(spark, sf_dir)
    return matrix.pending(answers, scores, matrix.KEY).groupBy("course").agg(F.count("*").alias("n"))


def rerun_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed orders with the value of their rerun."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 19 == 0).alias("failed"), F.col("o_orderstatus").alias("verdict"))
    again = rows.where(F.col("o_orderkey") % 38 == 0).select("o_orderkey", F.lit(False).alias("failed"), F.lit("rerun").alias("verdict"))
    return matrix.patch_runs(rows, again, ["o_orderkey"], "verdict", "failed").groupBy("verdict", "failed").agg(F.count("*").alias("n"))


def task_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a region's nations with every arm and model, counted."""
    spark = prepare(spark)
    items = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("course"), F.col("n_name").alias("item_id"))
    courses = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("course"))
    arms, models = spark.createDataFrame([("closed",), ("open",)], "arm string"), spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    return matrix.tasks(courses, arms, models, items).groupBy("course", "arm", "model").agg(F.count("*").alias("n"))


# ---- statistics ----


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "source", "lang"), "doc_id")


def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good quality against no toxicity."""
    out = stats.mcnemar_counts(_t(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")
    return out.select("both", "left_only", "right_only", "neither", F.round("chi_square", 6).alias("chi_square"))


def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with its p-value."""
    return stats.mcnemar_counts(_t(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the quality label with a heuristic on the text."""
    heuristic = F.when(F.regexp_count("text", F.lit("[!#$%&*]{2}")) * 20 > F.length("text"), 0).otherwise(1)
    return stats.cohen_kappa(_labels(spark, sf_dir).select("quality", heuristic.alias("guess")), "quality", "guess")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two labels by language."""
    rows = _labels(spark, sf_dir).select("lang", F.col("doc_id").alias("item"), (1 - F.col("toxic")).alias("left"), F.col("quality").alias("right"))
    return stats.bootstrap(rows, ["lang"], "left", "right")


def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentile of event values by type."""
    from lyceum.operators.fusion import nearest_rank

    return nearest_rank(_t(spark, sf_dir, "events"), "value", 0.95, ["event_type"])


def kind_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a rule for roles of turns, and of all together."""
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("unit_id"), F.col("role").alias("kind"), "turn")
    guess = rows.select("unit_id", F.when(F.col("turn") == 0, "system").when(F.col("turn") % 2 == 1, "user").otherwise("assistant").alias("kind"))
    return stats.kind_prf(rows.select("unit_id", "kind"), guess, ["system", "user", "assistant", "tool"])


def page_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labelled documents are among the short ones."""
    gold = _t(spark, sf_dir, "labels").select("doc_id")
    return stats.accounting(gold, _t(spark, sf_dir, "documents").where("n_chars < 3000").select("doc_id"), ["doc_id"])


def convergence_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month at which an event type's share of users settles."""
    e = _t(spark, sf_dir, "events").select("event_type", F.weekofyear("ts").alias("week"), "user_id")
    share = e.groupBy("event_type", "week").agg(F.count_distinct("user_id").alias("n"))
    total = e.groupBy("week").agg(F.count_distinct("user_id").alias("m"))
    return stats.converged_round(share.join(total, "week").select("event_type", "week", F.round(F.col("n") / F.col("m"), 4).alias("share")), ["event_type"], "week", "share", 0.05)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight labels of each stratum, by hash: a sampling operator."""
    rows = _t(spark, sf_dir, "labels")
    order = Window.partitionBy("quality", "toxic").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 8").select("quality", "toxic", "doc_id", "rank")


def csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made safe for a spreadsheet."""
    from lyceum.sources.sinks import csv_safe as safe

    head = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", safe(F.concat(F.element_at(F.array(F.lit("="), F.lit("+"), F.lit("-"), F.lit("@"), F.lit("a")), (F.col("doc_id") % 5 + 1).cast("int")), head)).alias("cell"))


# ---- answers ----


def numeric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number that each document asserts."""
    return _t(spark, sf_dir, "documents").select("doc_id", ans.final_number_of("text").alias("number")).where("number is not null")


def contains_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn repeats the first three words of the turn before it."""
    c = _t(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    gold = F.array_join(F.slice(F.split(before, " "), 1, 3), " ")
    return c.select("conv_id", "turn", "text", gold.alias("gold")).where("gold is not null").select("conv_id", "turn", ans.contains_gold_of("text", "gold").alias("found"))


# ---- questions: a part is a question (type as structure words, size as chapter, brand as source) ----


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(
        p.cast("string").alias("id"), F.concat(F.lit("ch"), F.col("p_size").cast("string")).alias("chapter"), F.when(p % 4 == 0, F.concat(F.lit("phase "), (F.col("p_size") % 9).cast("string"))).alias("phase"),
        F.when(p % 10 != 0, F.col("p_brand")).alias("source_type"), F.split("p_name", " ").alias("knowledge_points"),
        F.element_at(F.array(*map(F.lit, ("choice", "subjective", "code", "true_false", "fill_blank", "riddle"))), (p % 6 + 1).cast("int")).alias("type"),
        F.concat_ws(" ", "p_name", "p_type", F.element_at(F.array(*map(F.lit, ("integral", "prove that", "matrix of a proof", "plain"))), (p % 4 + 1).cast("int"))).alias("question"),
        (p % 5 == 0).alias("requires_assets"), (p % 5 == 1).alias("maybe_requires_assets"), F.when(p % 13 == 0, F.lit(False)).alias("gradable"),
        F.concat_ws("-", (p % 7).cast("string"), (p % 7 + p % 3).cast("string")).alias("answer_pages"), F.when(p % 3 != 0, F.col("p_name")).alias("answer"),
        F.when(p % 6 == 0, F.array(F.lit("A. x"), F.concat(F.lit("B. "), "p_name"))).alias("options"), F.when(p % 8 != 1, F.split("p_type", " ")).alias("keywords"), "p_partkey", "p_size",
    )


def _fields(extra: dict | None = None) -> dict:
    return {c: F.col(c) for c in ("gradable", "source_type", "chapter", "phase", "knowledge_points", "requires_assets", "maybe_requires_assets", "type", "answer_pages")} | {"text": F.col("question")} | (extra or {})


def difficulty_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty and points of every question."""
    bank = _bank(spark, sf_dir).withColumn("chapter_no", questions.numeric_chapter(F.col("chapter"), F.col("phase")))
    rows = bank.crossJoin(F.broadcast(questions.late_cutoff(bank)))
    d, points, _ = questions.difficulty(_fields({"chapter_no": F.col("chapter_no")}), F.col("cutoff"))
    return rows.select("id", d.alias("difficulty"), points.alias("points"), F.array_join(questions.families(F.col("question")), "/").alias("families"))


def late_chapter_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter from which on chapters count as late."""
    return questions.late_cutoff(_bank(spark, sf_dir).withColumn("chapter_no", questions.numeric_chapter(F.col("chapter"), F.col("phase"))))


def question_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two sources and a chapter or phase that need no assets."""
    bank = _bank(spark, sf_dir)
    brands = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23"]
    return bank.where(questions.matches(_fields(), source_types=brands, chapter="7", assets="no")).select("id", "source_type", "chapter", "phase")


def untagged_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that only the missing source type excludes."""
    bank = _bank(spark, sf_dir)
    ok = questions.matches(_fields(), assets="yes")
    return bank.agg(F.count_if(ok & F.col("source_type").isNotNull()).alias("tagged"), F.count_if(ok & F.col("source_type").isNull()).alias("untagged"))


def _state(spark: SparkSession) -> DataFrame:
    rows = [("mistake", "30", "ch9", None, "open"), ("mistake", "31", "ch8", None, "resolved"), ("confusion", None, "ch4", None, None), ("window", None, None, "red", "out_window"), ("window", None, None, "blue", "verified"), ("window", None, None, "steel", None)]
    return prepare(spark).createDataFrame(rows, "part string, id string, chapter string, point string, status string")


def mastery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by mastery: weak ones first from easy to hard, then the others from hard to easy."""
    bank = _bank(spark, sf_dir)
    rows = bank.crossJoin(F.broadcast(questions.mastery(_state(spark))))
    q = {"id": F.col("id"), "chapters": F.array("chapter"), "points": F.col("knowledge_points")} | {c: F.col(c) for c in ("mistake_ids", "trouble", "weak", "strong")}
    rows = rows.select("id", questions.mastery_class(q).alias("class"), (F.col("p_size") % 5 + 1).alias("difficulty"), F.col("p_partkey").alias("position"))
    top = rows.orderBy(*questions.study_order("review")).limit(25)
    return top.select("id", "class", "difficulty")


def mastery_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by class."""
    rows = _bank(spark, sf_dir).crossJoin(F.broadcast(questions.mastery(_state(spark))))
    q = {"id": F.col("id"), "chapters": F.array("chapter"), "points": F.col("knowledge_points")} | {c: F.col(c) for c in ("mistake_ids", "trouble", "weak", "strong")}
    return rows.groupBy(questions.mastery_class(q).alias("class")).agg(F.count("*").alias("n"))


def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why questions are excluded."""
    bank = _bank(spark, sf_dir).withColumn("id", F.when(F.col("p_partkey") % 101 == 0, "101").otherwise(F.col("id")))
    return questions.eligibility(bank).groupBy("reason").agg(F.count("*").alias("n"))


def tainted_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of parts that no returned line has tainted."""
    uses = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("path"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), "student_attempt").otherwise("question_context").alias("role"))
    return questions.untainted(uses).groupBy("path").agg(F.count("*").alias("uses"))


def asset_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of parts, and those that serve both sides."""
    role = F.when(F.col("l_linestatus") == "O", "question_context").when(F.col("l_returnflag") == "A", "worked_solution").otherwise("answer_context")
    out = questions.asset_roles(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), role.alias("role")))
    return out.groupBy(F.array_join("roles", ",").alias("roles"), "conflict").agg(F.count("*").alias("n"))


def bank_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge points of an exported bank, by the number of questions."""
    _, points = questions.bank_table(_bank(spark, sf_dir).select("id", "question", "knowledge_points"))
    return points.groupBy("knowledge_point").agg(F.count("*").alias("n"))


# ---- sessions: a conversation is a session ----


def drift_running_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase of every turn, carried forward from turns that set one."""
    c = _t(spark, sf_dir, "conversations").withColumn("set_phase", F.when(F.length("text") % 3 == 0, F.length("text") % 10))
    return sessions.carry_forward(c, ["conv_id"], ["turn"], "set_phase", 1, "phase").select("conv_id", "turn", F.col("phase").cast("long").alias("phase"))


def snapshot_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct short words that each turn gained and lost against the turn before."""
    c = _t(spark, sf_dir, "conversations").withColumn("items", F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: (F.length(w) > 0) & (F.length(w) < 4))))
    out = sessions.set_changes(c, ["conv_id"], ["turn"], "items")
    return out.select("conv_id", "turn", F.col("added").cast("long").alias("added"), F.col("lost").cast("long").alias("lost"))


def context_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last over first length of a conversation's turns."""
    c = _t(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return sessions.growth(c, ["conv_id"], ["turn"], "n").select("conv_id", F.col("first").cast("long").alias("first_n"), F.col("last").cast("long").alias("last_n"), "ratio")


def drift_invention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority whose customer is known, as asked items that the bank has."""
    asked = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("session"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 9 == 0, 10_000_000).otherwise(0)).alias("id"))
    return sessions.quiz_provenance(asked, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), ["session"])


def threshold_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that break a limit."""
    m = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.max("value"), 3).alias("top"))
    return sessions.check_thresholds(m, ["event_type"], {"n": ("min", 2000.0), "users": ("max", 100.0), "top": ("min", 0.0)})


def question_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that ask, by role."""
    return _t(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(sessions.looks_like_question(F.col("text"))).alias("asking"), F.count("*").alias("n"))


# ---- state ----


def review_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' queue after a new snapshot, by status."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    st = F.element_at(F.array(*map(F.lit, ("open", "applied", "resolved", "in_review", "unrecoverable"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    old = c.where("c_custkey % 3 <> 0").withColumn("status", st)
    new = c.where("c_custkey % 4 <> 0").select("c_custkey", (F.col("balance") + 1).alias("balance"), F.lit("open").alias("status"))
    out = state.reconcile(old, new, "c_custkey")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum((F.round(F.col("balance") * 100)).cast("long")).alias("cents"))


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the price of their last line, by whether it changed."""
    base = _t(spark, sf_dir, "part").select("p_partkey", F.round("p_retailprice", 2).alias("price"))
    changes = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.round("l_extendedprice", 2).alias("price"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    return state.upsert(base, changes, ["p_partkey"], "at")


def ledger_replay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' state after replaying their events; an error deletes."""
    e = _t(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("set")).withColumn("v", F.round("value", 3))
    return state.replay(e, ["user_id"], ["ts", "event_id"], "op", "v").select("user_id", "value", "entries")


def phase_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region in order, each with its successor."""
    return state.next_phase(_t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], "n_nationkey", "n_name").select("n_nationkey", "next_phase")


def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source dealt to batches of eight."""
    out = state.batches(_t(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    return out.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("over").alias("over"))


def issue_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines attributed to a nation by order, by supplier, or not at all."""
    issues = _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, F.col("l_orderkey")).alias("unit_id"), F.col("l_suppkey").alias("source_id"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_partkey") % 5).alias("page"))
    units = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("chapter"))
    supp = _t(spark, sf_dir, "supplier")
    pages = supp.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 5).alias("page"), F.lit("page").alias("chapter"))
    sources = supp.select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").cast("string").alias("chapter"))
    return state.attributed(issues, units, pages, sources).groupBy("chapter").agg(F.count("*").alias("n"))


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user's day as one candidate, blocking if any failed."""
    e = _t(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").alias("day"), "event_type", F.when(F.col("event_type") == "error", "blocking").otherwise("warning").alias("severity"), F.struct("ts", "event_id").alias("at"))
    return state.merged_candidates(e, ["user_id", "day"], "event_type", "severity", "at")


# ---- rules ----


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules over all tables."""
    t = {n: _t(spark, sf_dir, n) for n in ("documents", "labels", "orders", "customer", "lineitem", "nation", "supplier", "part", "pages")}
    parts = [
        rules.unique(t["documents"], "document_id_repeated", "doc_id"), rules.present(t["documents"], "document_text_missing", "doc_id", "text"), rules.allowed(t["documents"], "document_lang_unknown", "doc_id", "lang", ["en", "de", "fr"]),
        rules.holds(t["documents"], "document_length_wrong", "doc_id", F.col("n_chars") == F.length("text")), rules.references(t["labels"], "label_without_document", "doc_id", "doc_id", t["documents"], "doc_id"),
        rules.references(t["orders"], "order_without_customer", "o_orderkey", "o_custkey", t["customer"], "c_custkey"), rules.references(t["lineitem"], "line_without_order", "l_orderkey", "l_orderkey", t["orders"], "o_orderkey"),
        rules.references(t["supplier"], "supplier_without_nation", "s_suppkey", "s_nationkey", t["nation"], "n_nationkey"), rules.holds(t["part"], "part_size_range", "p_partkey", F.col("p_size").between(1, 49)),
        rules.unique(t["pages"], "page_url_repeated", "url"), rules.holds(t["orders"], "order_total_negative", "o_orderkey", F.col("o_totalprice") >= 1000, "warning"),
    ]
    return rules.summary(rules.together(parts)).select("rule", "level", "n")


def readiness_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready, usable with gaps or blocked, from two rules."""
    docs = _t(spark, sf_dir, "documents")
    return rules.readiness(rules.together([rules.unique(docs, "id", "doc_id"), rules.holds(docs, "short", "doc_id", F.col("n_chars") > 50, "warning")]))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the problem that they would have as ids."""
    return _t(spark, sf_dir, "documents").groupBy(rules.stable_id_problem(F.col("text")).alias("problem")).agg(F.count("*").alias("n"))


def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages' URLs by safety and media type."""
    path = F.regexp_replace("url", r"^https?://[^/]*/", "")
    return _t(spark, sf_dir, "pages").groupBy(rules.unsafe_path(path).alias("unsafe"), media_type(F.regexp_replace(path, r"[?#].*$", "")).alias("media")).agg(F.count("*").alias("n"))


def chapter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical chapters of parts' sizes in several notations."""
    p = _t(spark, sf_dir, "part")
    value = F.concat(F.element_at(F.array(*map(F.lit, ("", "ch", "chapter-", "0", "phase ", "x"))), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), chapter_key(value, allow_phase=True).alias("chapter"))


# ---- windows over events: an extension, the reference has none ----


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    out = stream.tumbling(_t(spark, sf_dir, "events"), "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with breaks of six hours."""
    return stream.sessions(_t(spark, sf_dir, "events"), 6 * 3600).select("user_id", "session", "n", "seconds")


def watermarked_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that would come too late for a watermark of a day, by type, in the order of their ids."""
    return stream.late(_t(spark, sf_dir, "events"), 86_400).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


QUERIES = {
    f.__name__: f
    for f in (
        matrix_cells, matrix_merge_problems, cost_per_q, ragged_flag, resume_antijoin, rerun_patch, task_product, mcnemar_counts, mcnemar_p, cohen_kappa, bootstrap_ci, p95_nearest_rank, kind_prf, page_accounting,
        convergence_round, stratified_sample, csv_safe, numeric_extract, contains_gold, difficulty_score, late_chapter_cutoff, question_match, untagged_excluded, mastery_order, mastery_classes,
        eligibility_reasons, tainted_assets, asset_roles, bank_points, drift_running_phase, snapshot_row_diff, context_growth, drift_invention, threshold_failures, question_turns, review_reconcile, manifest_upsert,
        ledger_replay_latest, phase_plan, micro_batches, issue_attribution, merged_candidates, constraint_violations, readiness_state, stable_ids, unsafe_paths, chapter_keys, tumbling_counts, sessionize, watermarked_late,
    )
}

_RUNS = """
base as (select c_mktsegment as course, n_regionkey::varchar as model, o_orderpriority as arm, o_orderkey::varchar as item_id, o_orderkey, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
ans as (select course, model, arm, item_id, o_orderkey % 7 <> 0 as answerable, o_orderkey % 19 = 0 as infra, round(o_totalprice / 1e6, 6) as cost from base),
lines as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as returned, sum(round(l_quantity)::bigint) as quantity from lineitem group by 1),
sc as (select course, model, arm, item_id, case when o_orderkey % 13 <> 0 then returned = 0 end as correct, round(1 - returned / n, 4) as faithfulness, quantity > 150 as hallucinated,
  case when o_orderkey % 5 <> 0 then quantity < 60 end as abstained, o_orderkey % 23 = 0 as judge_error, case when n = 1 then 'lexical' else 'judge' end as scored_by, true as scored
  from base join lines on l_orderkey = o_orderkey where o_orderkey % 11 <> 0),
j as (select a.*, s.scored, s.correct as s_correct, s.faithfulness, s.hallucinated, s.abstained as s_abstained, s.scored_by,
  case when scored then judge_error else answerable and not infra end as failed from ans a left join sc s using (course, model, arm, item_id)),
m as (select *, (answerable and not infra and (failed or s_correct is null)) as undecided from j),
merged as (select *, undecided or failed as judge_error, case when undecided then false else s_correct end as correct,
  case when not answerable and not infra then coalesce(s_abstained, false) else s_abstained end as abstained, answerable and not infra as a, not answerable and not infra as o from m)"""

_BANK = """
bank as (select p_partkey as p, p_partkey::varchar as id, 'ch' || p_size as chapter, case when p_partkey % 4 = 0 then 'phase ' || (p_size % 9) end as phase, case when p_partkey % 10 <> 0 then p_brand end as source_type,
  string_split(p_name, ' ') as kps, list_extract(['choice', 'subjective', 'code', 'true_false', 'fill_blank', 'riddle'], (p_partkey % 6 + 1)::int) as type,
  p_name || ' ' || p_type || ' ' || list_extract(['integral', 'prove that', 'matrix of a proof', 'plain'], (p_partkey % 4 + 1)::int) as question, p_partkey % 5 = 0 as requires_assets, p_partkey % 5 = 1 as maybe,
  case when p_partkey % 13 = 0 then false end as gradable, case when p_partkey % 3 <> 0 then p_name end as answer, p_name, p_size, p_type from part)"""

_MASTERY = """
cls as (select id, p, p_size, case when id = '30' or chapter in ('ch9', 'ch4') or len(list_filter(kps, lambda k: contains(k, 'red') or (k <> '' and contains('red', k)))) > 0 then 'weak'
  when len(list_filter(kps, lambda k: contains(k, 'blue') or (k <> '' and contains('blue', k)) or contains(k, 'steel') or (k <> '' and contains('steel', k)))) > 0 then 'mastered' else 'neutral' end as class from bank)"""

ORACLE = {
    "matrix_cells": f"""with {_RUNS} select course, model, arm, count(*)::bigint as n, count(*) filter (a)::bigint as n_answerable, count(*) filter (o)::bigint as n_oos,
  round(avg(case when a then correct::int end), 4) as correct, round(avg(case when a and not judge_error then faithfulness end), 4) as faithfulness, round(avg(case when a then hallucinated::int end), 4) as hallucination,
  round(avg(case when o then abstained::int end), 4) as abstention_oos, count(*) filter (a and judge_error)::bigint as n_judge_error, count(*) filter (a and scored_by = 'lexical')::bigint as n_lexical,
  count(*) filter (infra)::bigint as n_infra_error, round(sum(cost), 6) as cost_usd from merged group by 1, 2, 3""",
    "matrix_merge_problems": f"""with {_RUNS}, x as (select count(*)::bigint as n from sc where item_id::bigint % 1000 = 3) select 'score_without_answer' as rule, n from x where n > 0
  union all select 'answerable_missing', count(*)::bigint from ans where answerable is null having count(*) > 0""",
    "cost_per_q": f"with {_RUNS} select course, arm, round(avg(case when not infra then cost end), 4) as cost_per_q from merged group by 1, 2",
    "ragged_flag": f"with {_RUNS}, s as (select course, model, arm, list(distinct item_id order by item_id) as items from merged group by 1, 2, 3), r as (select course, count(distinct items) > 1 as ragged from s group by 1) select course, ragged, (select count(distinct item_id) from merged m where m.course = r.course)::bigint as n_items from r",
    "resume_antijoin": f"with {_RUNS} select course, count(*)::bigint as n from ans where not exists (select 1 from sc where sc.item_id = ans.item_id) group by 1",
    "rerun_patch": "select case when o_orderkey % 19 = 0 and o_orderkey % 38 = 0 then 'rerun' else o_orderstatus end as verdict, o_orderkey % 19 = 0 and o_orderkey % 38 <> 0 as failed, count(*)::bigint as n from orders group by 1, 2",
    "task_product": "select n_regionkey as course, arm, model, count(*)::bigint as n from nation, (values ('closed'), ('open')) a(arm), (values ('a'), ('b'), ('c')) m(model) group by 1, 2, 3",
    "mcnemar_counts": """with l as (select quality = 1 as a, toxic = 0 as b from labels), c as (select count(*) filter (a and b)::bigint as both, count(*) filter (a and not b)::bigint as left_only, count(*) filter (not a and b)::bigint as right_only, count(*) filter (not a and not b)::bigint as neither from l)
select *, round(case when left_only + right_only > 0 then pow(greatest(abs(left_only - right_only) - 1, 0), 2) / (left_only + right_only) else 0 end, 6) as chi_square from c""",
    "cohen_kappa": r"""with l as (select quality as a, case when len(regexp_extract_all(text, '[!#$%&*]{2}')) * 20 > length(text) then 0 else 1 end as b from labels join documents using (doc_id)),
t as (select count(*) as n, count(*) filter (a = b) as agree from l), e as (select sum(x.n * y.n) as p from (select a, count(*) as n from l group by 1) x join (select b, count(*) as n from l group by 1) y on x.a = y.b)
select n::bigint as n, round(agree / n, 6) as observed, round(p / (n * n), 6) as expected, round((agree / n - p / (n * n)) / (1 - p / (n * n)), 6) as kappa from t, e""",
    "p95_nearest_rank": "select event_type, quantile_disc(value, 0.95) as percentile from events group by 1",
    "kind_prf": """with c as (select conv_id || '-' || turn as u, role as k, case when turn = 0 then 'system' when turn % 2 = 1 then 'user' else 'assistant' end as g from conversations),
k(kind) as (values ('system'), ('user'), ('assistant'), ('tool')),
d as (select kind, (select count(*) from c where k.kind = c.k and c.g = c.k)::bigint as tp, (select count(*) from c where c.g = k.kind and c.g <> c.k)::bigint as fp, (select count(*) from c where c.k = k.kind and c.g <> c.k)::bigint as fn from k),
a as (select * from d union all select 'micro', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from d)
select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from a""",
    "page_accounting": "with g as (select distinct doc_id from labels), p as (select distinct doc_id from documents where n_chars < 3000), c as (select (select count(*) from g)::bigint as expected, (select count(*) from g join p using (doc_id))::bigint as accounted, (select count(*) from p where doc_id not in (select doc_id from g))::bigint as unexpected) select *, round(coalesce(accounted / nullif(expected, 0), 0), 6) as rate from c",
    "convergence_round": """with e as (select event_type, weekofyear(ts) as week, user_id from events), s as (select event_type, week, count(distinct user_id) as n from e group by 1, 2), t as (select week, count(distinct user_id) as m from e group by 1),
v as (select event_type, week, round(n / m, 4) as share from s join t using (week)), d as (select *, row_number() over w as i, abs(share - lag(share) over w) as d from v window w as (partition by event_type order by week)),
b as (select *, lag(d) over (partition by event_type order by week) as before from d) select event_type, min(case when i >= 3 and d < 0.05 and before < 0.05 then i end)::int as converged from b group by 1""",
    "stratified_sample": "select quality, toxic, doc_id, rank::int as rank from (select *, row_number() over (partition by quality, toxic order by md5(doc_id::varchar), doc_id) as rank from labels) where rank <= 8",
    "csv_safe": r"with c as (select doc_id, list_extract(['=', '+', '-', '@', 'a'], (doc_id % 5 + 1)::int) || text as cell from documents) select doc_id, case when left(cell, 1) in ('=', '+', '-', '@') then '''' || cell else cell end as cell from c",
    "difficulty_score": rf"""with {_BANK}, x as (select *, p_size as no from bank), cut as (select list_extract(l, (floor(len(l) * 2 / 3))::int + 1) as cutoff from (select list(distinct no order by no) as l from x)),
f as (select *, list_filter([case when contains(lower(question), 'integral') then '积分' end, case when contains(lower(question), 'prove that') or contains(lower(question), 'proof') then '证明' end, case when contains(lower(question), 'matrix') then '矩阵' end], lambda t: t is not null) as fam,
  len(list_distinct(list_filter(list_transform(kps, lambda k: trim(k)), lambda k: k <> ''))) as nk from x, cut),
s as (select *, case when nk >= 3 then 2 when nk = 2 then 1 else 0 end + least(len(fam), 2) + requires_assets::int + (p % 3 > 0)::int + (no >= cutoff)::int + (type in ('subjective', 'code'))::int as points from f)
select id, case when points <= 0 then 1 when points = 1 then 2 when points <= 3 then 3 when points <= 5 then 4 else 5 end as difficulty, points::int as points, array_to_string(fam, '/') as families from s""",
    "late_chapter_cutoff": "select list_extract(l, least((floor(len(l) * 2 / 3))::int, len(l) - 1) + 1) as cutoff from (select list(distinct p_size order by p_size) as l from part)",
    "question_match": f"with {_BANK} select id, source_type, chapter, phase from bank where coalesce(gradable, true) and source_type in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23') and (chapter = 'ch7' or phase = 'phase 7') and not requires_assets and not maybe",
    "untagged_excluded": f"with {_BANK} select count(*) filter (source_type is not null)::bigint as tagged, count(*) filter (source_type is null)::bigint as untagged from bank where coalesce(gradable, true) and requires_assets",
    "mastery_order": f"with {_BANK}, {_MASTERY} select id, class, difficulty::int as difficulty from (select *, p_size % 5 + 1 as difficulty from cls) order by case class when 'weak' then 0 when 'neutral' then 1 else 2 end, case when class = 'weak' then difficulty else -difficulty end, p limit 25",
    "mastery_classes": f"with {_BANK}, {_MASTERY} select class, count(*)::bigint as n from cls group by 1",
    "eligibility_reasons": f"""with {_BANK}, b as (select * replace (case when p % 101 = 0 then '101' else id end as id) from bank), c as (select *, count(*) over (partition by id) as copies from b),
r as (select case when copies > 1 then 'duplicate_id' when gradable = false then 'non_gradable' when type = 'riddle' then 'type_invalid'
  when type = 'choice' then case when answer is null then 'choice_answer_missing' else null end
  when type = 'subjective' and p % 8 = 1 then 'subjective_keywords_missing' when type = 'subjective' then null
  when type = 'true_false' then 'true_false_oracle_invalid' when answer is null then 'answer_missing' end as reason from c) select reason, count(*)::bigint as n from r group by 1""",
    "tainted_assets": "select l_partkey as path, count(*)::bigint as uses from lineitem where l_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 49) group by 1",
    "asset_roles": """with u as (select distinct l_partkey as path, case when l_linestatus = 'O' then 'question_context' when l_returnflag = 'A' then 'worked_solution' else 'answer_context' end as role from lineitem),
g as (select path, string_agg(role, ',' order by role) as roles, bool_or(role = 'question_context') and bool_or(role <> 'question_context') as conflict from u group by 1) select roles, conflict, count(*)::bigint as n from g group by 1, 2""",
    "bank_points": f"with {_BANK}, k as (select id, unnest(list_distinct(kps)) as knowledge_point from bank) select knowledge_point, count(*)::bigint as n from k group by 1",
    "drift_running_phase": "select conv_id, turn, coalesce(last_value(case when length(text) % 3 = 0 then length(text) % 10 end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), 1)::bigint as phase from conversations",
    "snapshot_row_diff": """with c as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 0 and length(w) < 4)) as cur from conversations), l as (select *, lag(cur) over (partition by conv_id order by turn) as prev from c)
select conv_id, turn, len(list_filter(cur, lambda x: not list_contains(coalesce(prev, []), x)))::bigint as added, (case when prev is null then 0 else len(list_filter(prev, lambda x: not list_contains(cur, x))) end)::bigint as lost from l""",
    "context_growth": "with c as (select conv_id, arg_min(length(text), turn) as first_n, arg_max(length(text), turn) as last_n from conversations where text is not null group by 1) select conv_id, first_n::bigint as first_n, last_n::bigint as last_n, round(last_n / nullif(first_n, 0), 4) as ratio from c",
    "drift_invention": "with a as (select o_orderpriority as session, o_custkey + case when o_orderkey % 9 = 0 then 10000000 else 0 end as id from orders), g as (select session, count(*)::bigint as items, count(c_custkey)::bigint as bank_backed from a left join customer on id = c_custkey group by 1) select *, items - bank_backed as invented, round((items - bank_backed) / items, 4) as invention_rate from g",
    "threshold_failures": """with m as (select event_type, count(*)::double as n, count(distinct user_id)::double as users, round(max(value), 3)::double as top from events group by 1)
select event_type, 'n' as metric, n as got, 2000.0::double as want, 'min' as side from m where n < 2000 union all select event_type, 'users', users, 100.0, 'max' from m where users > 100 union all select event_type, 'top', top, 0.0, 'min' from m where top < 0""",
    "question_turns": r"select role, count(*) filter (regexp_matches(rtrim(coalesce(text, '')), '[?？]\s*$'))::bigint as asking, count(*)::bigint as n from conversations group by 1",
    "review_reconcile": """with c as (select c_custkey as k, round(c_acctbal, 2) as b, list_extract(['open', 'applied', 'resolved', 'in_review', 'unrecoverable'], (c_custkey % 5 + 1)::int) as st from customer),
r as (select k, case when k % 4 <> 0 then b + 1 else b end as b, case when k % 3 <> 0 and k % 4 <> 0 then st when k % 4 <> 0 then 'open' when st in ('applied', 'resolved', 'unrecoverable') then st else 'superseded' end as status from c where k % 3 <> 0 or k % 4 <> 0)
select status, count(*)::bigint as n, sum(round(b * 100)::bigint)::bigint as cents from r group by 1""",
    "manifest_upsert": "with l as (select l_partkey as k, arg_max(round(l_extendedprice, 2), row(l_shipdate, l_orderkey, l_linenumber)) as price from lineitem group by 1) select p_partkey, coalesce(l.price, round(p_retailprice, 2)) as price from part left join l on k = p_partkey",
    "ledger_replay_latest": """with e as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events),
g as (select user_id, count(*)::bigint as entries, arg_min(case when event_type <> 'error' then round(value, 3) end, r) filter (event_type <> 'error') as value, bool_or(r = 1 and event_type = 'error') as gone from e group by 1) select user_id, value, entries from g where not gone""",
    "phase_plan": "select n_nationkey, lead(n_name) over (partition by n_regionkey order by n_nationkey) as next_phase from nation",
    "micro_batches": "with b as (select doc_id, source, (row_number() over (partition by source order by doc_id) - 1) // 8 as batch from documents) select source, batch::bigint as batch, count(*)::bigint as n, min(doc_id) as first_id, max(batch) >= 512 as over from b group by 1, 2",
    "issue_attribution": """with i as (select case when l_orderkey % 3 = 0 then l_orderkey end as u, l_suppkey as s, case when l_orderkey % 2 = 0 then l_partkey % 5 end as pg from lineitem)
select coalesce(o_orderstatus, case when s % 2 = 0 and s % 5 = pg then 'page' end, s_nationkey::varchar) as chapter, count(*)::bigint as n from i left join orders on u = o_orderkey left join supplier on s = s_suppkey group by 1""",
    "merged_candidates": """with e as (select user_id, dayofyear(ts)::int as day, event_type, min(row(ts, event_id)) as seen_at from events group by 1, 2, 3)
select user_id, day, string_agg(event_type, ' | ' order by seen_at) as event_type, case when bool_or(event_type = 'error') then 'blocking' else 'warning' end as severity from e group by 1, 2""",
    "constraint_violations": """with v as (
  select 'document_id_repeated' as rule, 'error' as level from documents group by doc_id having count(*) > 1
  union all select 'document_text_missing', 'error' from documents where text is null or trim(text) = '' union all select 'document_lang_unknown', 'error' from documents where coalesce(lang not in ('en', 'de', 'fr'), true)
  union all select 'document_length_wrong', 'error' from documents where coalesce(n_chars <> length(text), true) union all select 'label_without_document', 'error' from labels where doc_id not in (select doc_id from documents)
  union all select 'order_without_customer', 'error' from orders where o_custkey not in (select c_custkey from customer) union all select 'line_without_order', 'error' from lineitem where l_orderkey not in (select o_orderkey from orders)
  union all select 'supplier_without_nation', 'error' from supplier where s_nationkey not in (select n_nationkey from nation) union all select 'part_size_range', 'error' from part where p_size not between 1 and 49
  union all select 'page_url_repeated', 'error' from pages group by url having count(*) > 1 union all select 'order_total_negative', 'warning' from orders where o_totalprice < 1000)
select rule, level, count(*)::bigint as n from v group by 1, 2""",
    "readiness_state": "with c as (select (select count(*) from (select doc_id from documents group by 1 having count(*) > 1))::bigint as errors, (select count(*) from documents where coalesce(n_chars <= 50, true))::bigint as warnings) select *, case when errors > 0 then 'blocked' when warnings > 0 then 'usable_with_gaps' else 'ready' end as state from c",
    "tumbling_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*)::bigint as n from events group by 1, 2",
    "sessionize": """with e as (select user_id, ts, event_id, case when epoch_us(ts) - epoch_us(lag(ts) over w) >= 21600000000 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e) select user_id, session::bigint as session, count(*)::bigint as n, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::bigint as seconds from s group by 1, 2""",
    "watermarked_late": "with e as (select event_type, epoch_us(ts) as t, max(epoch_us(ts)) over (partition by event_type order by event_id rows between unbounded preceding and 1 preceding) as seen from events) select event_type, count(*)::bigint as n, count(*) filter (t < seen - 86400000000)::bigint as late from e group by 1",
    "chapter_keys": r"with c as (select p_partkey as id, list_extract(['', 'ch', 'chapter-', '0', 'phase ', 'x'], (p_partkey % 6 + 1)::int) || p_size as v from part) select id, case when left(v, 1) <> 'x' then ltrim(regexp_extract(v, '[0-9]+$'), '0') end as chapter from c",
    "stable_ids": r"""select case when text is null or text = '' then 'empty' when text <> regexp_replace(regexp_replace(text, '^[\s\x{85}\x{a0}]+', ''), '[\s\x{85}\x{a0}]+$', '') then 'padded' when length(text) > 200 then 'too_long'
  when regexp_matches(text, '[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Zl}\p{Zp}]') then 'unprintable' end as problem, count(*) as n from documents group by 1""",
    "unsafe_paths": r"""with p as (select regexp_replace(url, '^https?://[^/]*/', '') as path from pages), e as (select path, lower(regexp_extract(regexp_replace(path, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1)) as ext from p)
select regexp_matches(path, '^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)') as unsafe, case ext when 'pdf' then 'application/pdf' when 'md' then 'text/markdown' when 'markdown' then 'text/markdown' when 'txt' then 'text/plain' when 'csv' then 'text/csv' when 'tsv' then 'text/tab-separated-values'
  when 'html' then 'text/html' when 'png' then 'image/png' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'gif' then 'image/gif' when 'json' then 'application/json' else 'application/octet-stream' end as media, count(*) as n from e group by 1, 2""",
}

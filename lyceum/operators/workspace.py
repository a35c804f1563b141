"""A study workspace as tables: listings, state commands, calibration samples, audits, assembly of pages and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles of assets that are shown with a question, and those that are kept for its solution.
QUESTION_SIDE, ANSWER_SIDE = ("question_context", "figure", "diagram", "table"), ("answer_context", "worked_solution")
# Events that a batch keeps at most; the ordinal of the first question.
DEPENDENCY_EVENTS, FIRST_ORDINAL = 64, 100_000
# Inputs that define a run, in the order of the digest.
RUN_INPUTS = ("references/quiz_bank.json", "study_plan.md", "study_state.json", "study_progress.md")


# ---- listings ----


def figure_pages(pages: DataFrame, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Visual pages (file, page, kinds) of files whose name holds `file`, with `kind` among their kinds."""
    if file is not None:
        pages = pages.where(F.contains(F.lower("file"), F.lit(file.lower())))
    return pages.where(F.array_contains("kinds", kind)) if kind is not None else pages


def figure_counts(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, pages_total, visual, structural_only) of files with visual pages; pages without a kind were found by structure."""
    found = pages.groupBy("file").agg(F.count("*").alias("visual"), F.count_if(F.size("kinds") == 0).alias("structural_only"))
    return found.join(totals, "file", "left").select("file", "pages_total", "visual", "structural_only")


def image_question_counts(bank: DataFrame, suspects: DataFrame) -> DataFrame:
    """(chapter, questions, requires, maybe, suspects); `bank` is (id, chapter, phase, requires_assets, maybe_requires_assets), `suspects` (id, source_layer) of the bank or unlabelled."""
    known = suspects.where(F.col("source_layer").isNull() | (F.col("source_layer") == "quiz_bank")).select("id").distinct().withColumn("suspect", F.lit(True))
    rows = bank.where(F.col("id").isNotNull()).join(known, "id", "left")
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    named = F.coalesce(F.col("chapter").cast("string"), F.col("phase").cast("string"), F.lit("?"))
    return rows.groupBy(named.alias("chapter")).agg(F.count("*").alias("questions"), flag("requires_assets").alias("requires"), flag("maybe_requires_assets").alias("maybe"), flag("suspect").alias("suspects"))


def pending_items(roster: DataFrame, recorded: DataFrame) -> DataFrame:
    """(chapter, total, completed, pending, stale, unexpected, next_id) of a roster (chapter, id, position, revision) beside records (chapter, id, revision).

    An item is completed if a record has its revision, stale if records have others only; a record of no roster item is unexpected.
    """
    best = recorded.groupBy("chapter", "id").agg(F.collect_set("revision").alias("seen"))
    both = roster.join(best, ["chapter", "id"], "full_outer")
    done = F.coalesce(F.array_contains("seen", F.col("revision")), F.lit(False))
    listed = F.col("position").isNotNull()
    open_ = listed & ~done
    return both.groupBy("chapter").agg(
        F.count_if(listed).alias("total"), F.count_if(listed & done).alias("completed"), F.count_if(open_).alias("pending"), F.count_if(open_ & F.col("seen").isNotNull()).alias("stale"),
        F.count_if(~listed).alias("unexpected"), F.min_by(F.when(open_, F.col("id")), F.when(open_, F.col("position"))).alias("next_id"),
    )


def question_assets(questions: DataFrame, assets: DataFrame, tainted: DataFrame) -> DataFrame:
    """(id, why, prompt, answer, complete): paths of either side in order, without students' attempts and tainted ones.

    `questions` is (id, requires_assets, maybe_requires_assets, text_status), `assets` (id, ordinal, path, role, usable).
    A question that needs its picture is complete only if it has prompt assets and all of them can be shown.
    """
    why = F.when(F.coalesce("requires_assets", F.lit(False)), "requires").when(F.coalesce("maybe_requires_assets", F.lit(False)), "maybe").when(F.col("text_status").isin("stub", "page_reference"), F.col("text_status"))
    good = assets.where(F.coalesce(F.col("role"), F.lit("")) != "student_attempt").join(tainted.select("path").distinct(), "path", "left_anti")
    usable, prompt = F.coalesce(F.col("usable"), F.lit(False)), F.col("role").isin(*QUESTION_SIDE)
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ordinal", "path")))), lambda x: x["path"])
    sides = good.groupBy("id").agg(ordered(prompt & usable).alias("prompt"), ordered(F.col("role").isin(*ANSWER_SIDE) & usable).alias("answer"), F.count_if(prompt & ~usable).alias("broken"))
    none = F.array().cast("array<string>")
    rows = questions.join(sides, "id", "left").select("id", why.alias("why"), F.coalesce("prompt", none).alias("prompt"), F.coalesce("answer", none).alias("answer"), F.coalesce("broken", F.lit(0)).alias("broken"))
    return rows.select("id", "why", "prompt", "answer", (F.col("why").isNull() | ((F.size("prompt") > 0) & (F.col("broken") == 0))).alias("complete"))


def page_sides(items: DataFrame) -> DataFrame:
    """(file, page, side) of items (source_file, source_pages, answer_file, answer_pages): a page that serves a prompt anywhere is `prompt`, any other that serves an answer `answer`."""
    prompt = items.select(F.col("source_file").alias("file"), F.explode("source_pages").alias("page")).withColumn("prompt", F.lit(True))
    answer = items.select(F.coalesce("answer_file", "source_file").alias("file"), F.explode("answer_pages").alias("page")).withColumn("prompt", F.lit(False))
    return prompt.unionByName(answer).groupBy("file", "page").agg(F.when(F.bool_or("prompt"), "prompt").otherwise("answer").alias("side"))


# ---- state commands ----


def set_statuses(rows: DataFrame, commands: DataFrame, statuses: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (position, id, status) after commands (seq, id, index, status): each sets all rows of an id, or the one at a 1-based index; the last that names a row holds.

    A command without an id goes by its index. Known words become codes, others stay as they are.
    """
    from lyceum.functions.vocabulary import canonical

    said = commands.withColumn("new", canonical(F.col("status"), statuses, any_case=False)["code"]).withColumn("how", F.struct("seq", "new"))
    by_id = said.where("id is not null").groupBy("id").agg(F.max("how").alias("by_id"))
    by_place = said.where("id is null and index is not null").groupBy(F.col("index").alias("position")).agg(F.max("how").alias("by_place"))
    both = rows.join(by_id, "id", "left").join(by_place, "position", "left")
    return both.select("position", "id", F.coalesce(F.greatest("by_id", "by_place")["new"], "status").alias("status"))


def command_problems(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """(seq, problem) of commands that name no row: no_locator, index_out_of_range or no_such_id."""
    size = rows.agg(F.count("*").alias("n"))
    ids = rows.select("id").where("id is not null").distinct().withColumn("known", F.lit(True))
    both = commands.join(ids, "id", "left").crossJoin(F.broadcast(size))
    problem = F.when(F.col("id").isNotNull(), F.when(F.col("known").isNull(), "no_such_id")).when(F.col("index").isNull(), "no_locator").when(~F.col("index").between(1, F.col("n")), "index_out_of_range")
    return both.select("seq", problem.alias("problem")).where("problem is not null")


def window_transitions(window: DataFrame, commands: DataFrame, statuses: dict[str, tuple[str, ...]]) -> DataFrame:
    """(seq, hits, problem) of commands (seq, point, chapter, status) on a window (point, chapter): a point of several chapters needs one named, an unknown point or status is refused."""
    from lyceum.functions.vocabulary import canonical

    same = (F.col("c.point") == F.col("w.point")) & (F.col("c.chapter").isNull() | (F.col("c.chapter") == F.col("w.chapter")))
    hits = commands.alias("c").join(window.alias("w"), same, "left").groupBy("c.seq", "c.status").agg(F.count("w.point").alias("hits"))
    known = canonical(F.col("status"), statuses, any_case=False)["known"]
    problem = F.when(~known, "status_unknown").when(F.col("hits") == 0, "point_unknown").when(F.col("hits") > 1, "chapter_needed")
    return hits.select("seq", "hits", problem.alias("problem"))


def append_rows(log: DataFrame, entries: DataFrame, status: str) -> DataFrame:
    """A log (position, id, note, status) with entries (seq, id, note) behind it in their order; a blank note is refused."""
    good = entries.where(F.trim(F.coalesce("note", F.lit(""))) != "")
    last = log.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy("seq"))
    new = good.select("id", F.trim("note").alias("note"), F.lit(status).alias("status"), place.alias("k")).crossJoin(F.broadcast(last))
    return log.select("position", "id", "note", "status").unionByName(new.select((F.col("last") + F.col("k")).alias("position"), "id", "note", "status"))


def dependency_events(events: DataFrame, most: int = DEPENDENCY_EVENTS) -> DataFrame:
    """(batch, kept, refused, digest, overflow): events (batch, seq, type, previous, current) that a batch's history keeps, and a digest over them in order.

    A full history refuses what follows instead of forgetting what was before.
    """
    place = F.row_number().over(Window.partitionBy("batch").orderBy("seq"))
    said = F.concat_ws("|", "type", F.coalesce("previous", F.lit("")), F.coalesce("current", F.lit("")))
    rows = events.withColumn("k", place).withColumn("said", said)
    kept = F.col("k") <= most
    line = F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("k", "said")))), lambda x: x["said"])
    return rows.groupBy("batch").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("refused"), F.sha2(F.array_join(line, "\n"), 256).alias("digest"), F.bool_or(~kept).alias("overflow"))


# ---- calibration ----


def calibration_pool(scores: DataFrame, answers: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """Verdicts with their answer and gold item: those of a judge's error are dropped; `gold` has the item's columns by course and item_id."""
    return scores.where(~F.coalesce("judge_error", F.lit(False))).drop("judge_error").join(answers, key).join(gold, ["course", "item_id"])


def pool_problems(scores: DataFrame, answers: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """(problem, n): repeated answers or verdicts, verdicts without an answer or a gold item."""
    good = scores.where(~F.coalesce("judge_error", F.lit(False)))
    parts = [
        ("answer_repeated", answers.groupBy(*key).count().where("count > 1")), ("score_repeated", good.groupBy(*key).count().where("count > 1")),
        ("score_without_answer", good.join(answers.select(*key).distinct(), key, "left_anti")), ("score_without_gold", good.join(gold.select("course", "item_id").distinct(), ["course", "item_id"], "left_anti")),
    ]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def calibration_sample(pool: DataFrame, n: int, seed: str, key: list[str], two_strata: bool = False) -> DataFrame:
    """`n` verdicts of a pool (answerable, right, key) by hash: a third right, a third wrong, the rest unanswerable ones, half of them right; what a stratum lacks comes from the others.

    With `two_strata` half are right and the rest wrong, and nothing is filled up. A stated sample size, so ranks are computed per stratum and only n rows are kept.
    """
    place = F.md5(F.concat_ws("|", F.lit(seed), *key).cast("binary"))
    if two_strata:
        stratum, wanted = F.when(F.col("right"), 0).otherwise(1), [n // 2, n - n // 2]
    else:
        third, rest = n // 3, n - 2 * (n // 3)
        stratum, wanted = F.when(F.col("answerable"), F.when(F.col("right"), 0).otherwise(1)).otherwise(F.when(F.col("right"), 2).otherwise(3)), [third, third, rest // 2, rest - rest // 2]
    limit = F.element_at(F.array(*[F.lit(w) for w in wanted]), F.col("stratum") + 1)
    rows = pool.withColumn("stratum", stratum).withColumn("place", place)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy("place", *key))).where(F.col("rank") <= n)
    rows = rows.withColumn("extra", F.col("rank") > limit)
    if two_strata:
        return rows.where(~F.col("extra")).drop("place", "rank", "extra")
    order = F.row_number().over(Window.orderBy("extra", F.when(F.col("extra"), F.col("place")).otherwise(""), "place", *key))
    return rows.withColumn("at", order).where(F.col("at") <= n).drop("place", "rank", "extra", "at")


def significant(p_value: Column, low: Column, high: Column) -> Column:
    """Whether the test rejects at 5 % and the interval leaves out 0."""
    return F.coalesce((p_value < 0.05) & ((low > 0) | (high < 0)), F.lit(False))


def inputs_digest(files: DataFrame) -> DataFrame:
    """(workspace, digest): one digest of the digests of the inputs that define a run; `files` is (workspace, path, sha256 hex), an input that is missing is marked absent."""
    by_path = F.map_from_entries(F.collect_list(F.struct("path", "sha256")))
    rows = files.where(F.col("path").isin(*RUN_INPUTS)).groupBy("workspace").agg(by_path.alias("held"))
    parts = [F.concat(F.lit(p).cast("binary"), F.coalesce(F.unhex(F.try_element_at("held", F.lit(p))), F.lit("<absent>").cast("binary"))) for p in RUN_INPUTS]
    return rows.select("workspace", F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(*parts), 256), 1, 24)).alias("digest"))


# ---- audits of retrieval runs ----


def fusion_audit(claimed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(query_id, rank, problem): ranks at which a fused list (query_id, rank, doc_id, score) differs from its recomputation."""
    side = lambda rows, p: rows.select("query_id", "rank", *[F.col(c).alias(f"{p}_{c}") for c in ("doc_id", "score")], F.lit(True).alias(p))
    both = side(claimed, "c").join(side(recomputed, "r"), ["query_id", "rank"], "full_outer")
    problem = F.when(F.col("c").isNull(), "missing").when(F.col("r").isNull(), "surplus").when(F.col("c_doc_id") != F.col("r_doc_id"), "doc_id").when(F.col("c_score") != F.col("r_score"), "score")
    return both.select("query_id", "rank", problem.alias("problem")).where("problem is not null")


def index_binding_problems(gold: DataFrame, index: DataFrame) -> DataFrame:
    """(rule, key): labelled units that no document holds, relevant units that an answer's document holds, repeated document ids.

    `gold` is (query_id, relevant array, hard_negative array), `index` (doc_id, kind, unit_ids array).
    """
    units = index.select("kind", F.explode("unit_ids").alias("unit_id"))
    labelled = gold.select(F.explode(F.array_union("relevant", "hard_negative")).alias("unit_id")).distinct()
    relevant = gold.select(F.explode("relevant").alias("unit_id")).distinct()
    tell = lambda rows, rule, key: rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    missing = tell(labelled.join(units.select("unit_id").distinct(), "unit_id", "left_anti"), "unit_not_indexed", "unit_id")
    leaked = tell(relevant.join(units.where("kind = 'answer'").select("unit_id").distinct(), "unit_id", "left_semi"), "answer_side_unit", "unit_id")
    return missing.unionByName(leaked).unionByName(tell(index.groupBy("doc_id").count().where("count > 1"), "doc_id_repeated", "doc_id"))


def gold_problems(gold: DataFrame, courses: DataFrame) -> DataFrame:
    """(rule, key) of gold queries (query_id, course_id, query, answerable, relevant, hard_negative, tags) that break their contract."""
    key = F.col("query_id").cast("string")
    tell = lambda rows, rule: rows.select(F.lit(rule).alias("rule"), key.alias("key"))
    none = F.array().cast("array<string>")
    r, h = F.coalesce("relevant", none), F.coalesce("hard_negative", none)
    rules = [
        ("query_blank", F.trim(F.coalesce("query", F.lit(""))) == ""), ("answerable_without_relevant", F.col("answerable") & (F.size(r) == 0)), ("unanswerable_with_relevant", ~F.col("answerable") & (F.size(r) > 0)),
        ("relevant_and_negative", F.arrays_overlap(r, h)), ("relevant_repeated", F.size(F.array_distinct(r)) < F.size(r)), ("negative_repeated", F.size(F.array_distinct(h)) < F.size(h)), ("tags_repeated", F.size(F.array_distinct(F.coalesce("tags", none))) < F.size(F.coalesce("tags", none))),
    ]
    out = tell(gold.groupBy("query_id").count().where("count > 1"), "query_id_repeated").unionByName(tell(gold.join(courses, "course_id", "left_anti"), "course_unknown"))
    each = gold.select(key.alias("key"), F.explode(F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules]), lambda x: x.isNotNull())).alias("rule"))
    return out.unionByName(each.select("rule", "key"))


def receipt_problems(gold: DataFrame, run: DataFrame) -> DataFrame:
    """(rule, key) of a run (query_id, rank, doc_id, abstain) against its gold queries: the same queries, gapless ranks from 1, no document twice, hits exactly where it doesn't abstain."""
    asked, answered = gold.select("query_id").distinct(), run.select("query_id").distinct()
    tell = lambda rows, rule: rows.select(F.lit(rule).alias("rule"), F.col("query_id").cast("string").alias("key"))
    hits = run.where("rank is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("ranks"), F.count_distinct("doc_id").alias("docs"))
    both = answered.join(hits, "query_id", "left").join(run.groupBy("query_id").agg(F.bool_or("abstain").alias("abstain")), "query_id")
    gaps = both.where("n > 0 and (low <> 1 or high <> n or ranks <> n)")
    return (
        tell(asked.join(answered, "query_id", "left_anti"), "query_missing").unionByName(tell(answered.join(asked, "query_id", "left_anti"), "query_unknown")).unionByName(tell(gaps, "ranks_not_consecutive"))
        .unionByName(tell(both.where("n > 0 and docs < n"), "document_repeated")).unionByName(tell(both.where("abstain <> (n is null)"), "abstain_disagrees"))
    )


# ---- assembly ----


def phase_map(sections: DataFrame) -> DataFrame:
    """(file, page, chapter, phase, chapter_id, phase_id) of the pages of sections (position, chapter, page_keys array<struct<file, page>>); the last section of a page holds."""
    phase = F.row_number().over(Window.orderBy("position"))
    rows = sections.withColumn("phase_no", phase).withColumn("number", F.coalesce(F.col("chapter").cast("int"), F.col("phase_no")))
    pages = rows.select("phase_no", "number", F.explode("page_keys").alias("k")).select(F.replace("k.file", F.lit("\\"), F.lit("/")).alias("file"), F.col("k.page").alias("page"), F.struct("phase_no", "number").alias("s"))
    last = pages.groupBy("file", "page").agg(F.max("s").alias("s"))
    two = lambda n: F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    n, p = F.col("s.number"), F.col("s.phase_no")
    return last.select("file", "page", n.cast("string").alias("chapter"), F.concat(F.lit("Phase "), p.cast("string")).alias("phase"), F.concat(F.lit("ch"), two(n)).alias("chapter_id"), F.concat(F.lit("phase"), two(p)).alias("phase_id"))


def question_ordinal(item_id: Column, index: Column) -> Column:
    """A stable place: from a digest of the id, or from the item's place where it has none."""
    digits = F.substring(F.sha2(item_id.cast("string"), 256), 1, 14)
    blank = item_id.isNull() | (F.trim(item_id.cast("string")) == "")
    return F.when(blank, FIRST_ORDINAL + index * 10).otherwise(FIRST_ORDINAL + F.conv(digits, 16, 10).cast("long") * 2)


def question_text(question: Column, options: Column) -> Column:
    """The prompt with its options as lettered lines."""
    letters = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), F.coalesce(o, F.lit(""))))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    prompt = bare(F.coalesce(question, F.lit("")))
    return bare(F.when(F.size(options) > 0, F.concat(prompt, F.lit("\n"), F.array_join(letters, "\n"))).otherwise(prompt))


def paired_answers(units: DataFrame) -> DataFrame:
    """Questions (unit_id, paired_unit_id) with the answer they are paired with; null where there is no such unit or it is no answer."""
    answers = units.where("kind = 'answer'").select(F.col("unit_id").alias("answer_id"), F.col("text").alias("answer_text"))
    return units.where("kind = 'question'").join(answers, F.col("paired_unit_id") == F.col("answer_id"), "left").select("unit_id", "answer_id", "answer_text")


def conflict_members(units: DataFrame, priorities: DataFrame) -> DataFrame:
    """(unit_id, answer_id, priority_rank, priority_basis): a unit's paired answer and its source's rank for that revision; 0 and `unspecified` without one."""
    both = units.join(paired_answers(units).select("unit_id", "answer_id"), "unit_id", "left").join(priorities, ["source_id", "source_sha256"], "left")
    return both.select("unit_id", "answer_id", F.coalesce("rank", F.lit(0)).alias("priority_rank"), F.coalesce("basis", F.lit("unspecified")).alias("priority_basis"))


def generation_tasks(courses: DataFrame, models: DataFrame, failed: DataFrame, second: str) -> DataFrame:
    """(stage, course, model, arm, item_id): raw files of all courses, then a second course closed-book and with the skill, reruns of failed answers, and last its whole material.

    `courses` is (course, item_id), `failed` (course, model, item_id).
    """
    every = courses.crossJoin(F.broadcast(models))
    of = every.where(F.col("course") == second)
    arm = lambda rows, stage, name: rows.select(F.lit(stage).alias("stage"), "course", "model", F.lit(name).alias("arm"), "item_id")
    return arm(every, 0, "rawfiles").unionByName(arm(of, 1, "closedbook")).unionByName(arm(of, 1, "skill")).unionByName(arm(failed, 2, "material")).unionByName(arm(of, 3, "material"))

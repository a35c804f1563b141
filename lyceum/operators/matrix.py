"""Answers joined with scores, and roll-ups of the benchmark matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["course", "model", "arm", "item_id"]


def merge_problems(answers: DataFrame, scores: DataFrame) -> DataFrame:
    """(rule, course, model, arm, item_id): repeated keys, orphan scores, missing or contradictory `answerable`, unknown status."""
    a = answers.select(*KEY, F.col("answerable").alias("a"), "status")
    s = scores.select(*KEY, F.col("answerable").alias("s"), F.lit(True).alias("scored"))

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), *KEY)

    twice = lambda df: df.groupBy(*KEY).count().where("count > 1")
    both = a.withColumn("answered", F.lit(True)).join(s, KEY, "full_outer")
    found = both.where(F.col("answered"))
    return (
        rule(twice(answers), "answer_repeated")
        .unionByName(rule(twice(scores), "score_repeated"))
        .unionByName(rule(both.where(F.col("answered").isNull()), "score_without_answer"))
        .unionByName(rule(found.where(F.col("a").isNull() & F.col("s").isNull()), "answerable_missing"))
        .unionByName(rule(found.where(F.col("a") != F.col("s")), "answerable_conflict"))
        .unionByName(rule(found.where(~F.coalesce("status", F.lit("ok")).isin("ok", "infra_error")), "status_unknown"))
    )


def merge_rows(answers: DataFrame, scores: DataFrame) -> DataFrame:
    """One row an answer with its score; a finished item without a usable verdict counts against the model."""
    s = scores.select(*KEY, *[F.col(c).alias(f"s_{c}") for c in ("answerable", "correct", "faithfulness", "hallucinated", "abstained", "judge_error", "scored_by")], F.lit(True).alias("scored"))
    rows = answers.join(s, KEY, "left")
    infra = F.coalesce(F.col("status") == "infra_error", F.lit(False))
    answerable = F.coalesce("answerable", "s_answerable")
    failed = F.when(F.col("scored"), F.coalesce("s_judge_error", F.lit(False))).otherwise(answerable & ~infra)
    undecided = answerable & ~infra & (failed | F.col("s_correct").isNull())
    return rows.select(
        *KEY, answerable.alias("answerable"), infra.alias("infra_error"), (undecided | failed).alias("judge_error"),
        F.when(undecided, F.lit(False)).otherwise(F.col("s_correct")).alias("correct"), F.col("s_faithfulness").alias("faithfulness"), F.col("s_hallucinated").alias("hallucinated"),
        F.when(~answerable & ~infra, F.coalesce("s_abstained", F.lit(False))).otherwise(F.col("s_abstained")).alias("abstained"),
        F.col("s_scored_by").alias("scored_by"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
    )


def _cell() -> list[Column]:
    """Counts and rates of one cell; failed runs leave the rates, an empty rate is null."""
    ans, oos = F.col("answerable") & ~F.col("infra_error"), ~F.col("answerable") & ~F.col("infra_error")
    rate = lambda rows, c: F.round(F.avg(F.when(rows, F.col(c).cast("int"))), 4)
    decided = ans & ~F.col("judge_error")
    return [
        F.count("*").alias("n"), F.count_if(ans).alias("n_answerable"), F.count_if(oos).alias("n_oos"), rate(ans, "correct").alias("correct"),
        F.round(F.avg(F.when(decided, F.col("faithfulness"))), 4).alias("faithfulness"), rate(ans, "hallucinated").alias("hallucination"), rate(oos, "abstained").alias("abstention_oos"),
        F.count_if(ans & F.col("judge_error")).alias("n_judge_error"), F.count_if(ans & (F.col("scored_by") == "lexical")).alias("n_lexical"), F.count_if("infra_error").alias("n_infra_error"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    ]


def cells(merged: DataFrame) -> DataFrame:
    return merged.groupBy("course", "model", "arm").agg(*_cell())


def cost_per_question(merged: DataFrame) -> DataFrame:
    """Mean cost of the runs that did not fail; an arm of failed runs only stays with null."""
    return merged.groupBy("course", "arm").agg(F.round(F.avg(F.when(~F.col("infra_error"), F.col("cost_usd"))), 4).alias("cost_per_q"))


def ragged(merged: DataFrame) -> DataFrame:
    """Whether the cells of a course have different sets of items, and how many items it has in all.

    Sets are compared by their size and two sums of hashes, so no cell's items are gathered.
    """
    h = F.xxhash64("item_id")
    items = merged.select("course", "model", "arm", "item_id").distinct()
    marks = items.groupBy("course", "model", "arm").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s"))
    sets = marks.groupBy("course").agg((F.count_distinct(F.struct("n", "x", "s")) > 1).alias("ragged"))
    return sets.join(items.groupBy("course").agg(F.count_distinct("item_id").alias("n_items")), "course")


def tasks(courses: DataFrame, arms: DataFrame, models: DataFrame, items: DataFrame) -> DataFrame:
    """Every item of a course with every arm and model: the lists are small configurations, the items stay where they are."""
    return items.join(F.broadcast(courses), "course").crossJoin(F.broadcast(arms.crossJoin(models)))


def pending(all_tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that a resumed run still has to do."""
    return all_tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def patch_runs(rows: DataFrame, reruns: DataFrame, keys: list[str], value: str, error: str) -> DataFrame:
    """Failed rows replaced by their rerun where there is one."""
    again = reruns.select(*keys, F.col(value).alias("_value"), F.col(error).alias("_error"))
    use = F.col(error) & F.col("_error").isNotNull()
    out = rows.join(again, keys, "left")
    return out.withColumn(value, F.when(use, F.col("_value")).otherwise(F.col(value))).withColumn(error, F.when(use, F.col("_error")).otherwise(F.col(error))).drop("_value", "_error")


def arm_means(scored: DataFrame) -> DataFrame:
    """Rates of each arm from scored answers (arm, answerable, answer_type, faithfulness, hallucinated, correct, abstained); an empty rate is null."""
    ok, numeric = F.col("answerable"), F.col("answer_type") == "numeric"
    rate = lambda cond, c: F.round(F.avg(F.when(cond, F.col(c).cast("double"))), 6)
    return scored.groupBy("arm").agg(
        F.count("*").alias("n"), rate(ok, "faithfulness").alias("faithfulness"), F.round(F.avg(F.col("hallucinated").cast("double")), 6).alias("hallucination"),
        rate(ok, "correct").alias("correctness"), rate(ok & numeric, "correct").alias("numeric_accuracy"), rate(~ok, "abstained").alias("abstention"),
    )


def course_summary(merged: DataFrame) -> DataFrame:
    """One row a course: its cells, models, arms, items, answers that failed, and its whole cost, failed runs included."""
    return merged.groupBy("course").agg(
        F.count_distinct("model", "arm").alias("cells"), F.count_distinct("model").alias("models"), F.count_distinct("arm").alias("arms"), F.count_distinct("item_id").alias("n_items"),
        F.count_if("infra_error").alias("failed"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("total_cost_usd"),
    )


def traced_recall(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(model, arm, n_traced, n_hit, n_untraced, recall): whether the files that a run opened (item_id, model, arm, files) hold the chapter of the item's source (item_id, source_file, answerable).

    Items that can't be answered or name no chapter have no right chapter and don't count.
    """
    from lyceum.functions.vocabulary import chapter_of

    gold = items.where(F.coalesce("answerable", F.lit(True))).select("item_id", chapter_of(F.col("source_file")).alias("chapter")).where("chapter is not null")
    opened = F.transform(F.coalesce("files", F.array().cast("array<string>")), chapter_of)
    rows = answers.join(gold, "item_id").withColumn("traced", F.coalesce(F.size("files") > 0, F.lit(False))).withColumn("hit", F.coalesce(F.array_contains(opened, F.col("chapter")), F.lit(False)))
    out = rows.groupBy("model", "arm").agg(F.count_if("traced").alias("n_traced"), F.count_if(F.col("traced") & F.col("hit")).alias("n_hit"), F.count_if(~F.col("traced")).alias("n_untraced"))
    return out.withColumn("recall", F.round(F.try_divide("n_hit", "n_traced"), 4))

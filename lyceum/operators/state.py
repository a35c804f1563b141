"""Persistent state as mergeable tables: reconcile, upsert, replay, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Statuses that end an issue.
TERMINAL = ("applied", "resolved", "unrecoverable", "superseded")


def reconcile(existing: DataFrame, incoming: DataFrame, key: str, status: str = "status") -> DataFrame:
    """A detector's snapshot merged into the queue.

    A known issue takes the new content and keeps its status, a new one enters as it is, a vanished
    one is superseded unless it had ended.
    """
    rest = [c for c in incoming.columns if c not in (key, status)]
    old = existing.select(key, *[F.col(c).alias(f"o_{c}") for c in (*rest, status)], F.lit(True).alias("o_"))
    new = incoming.select(key, *[F.col(c).alias(f"n_{c}") for c in (*rest, status)], F.lit(True).alias("n_"))
    both = old.join(new, key, "full_outer")
    content = [F.when(F.col("n_"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in rest]
    now = F.when(F.col("o_") & F.col("n_"), F.col(f"o_{status}")).when(F.col("n_"), F.col(f"n_{status}")).when(F.col(f"o_{status}").isin(*TERMINAL), F.col(f"o_{status}")).otherwise("superseded")
    return both.select(key, *content, now.alias(status))


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The base with the last change of each key; unchanged keys stay."""
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*[c for c in base.columns if c not in key]), order).alias("r"))
    both = base.select(*key, F.struct(*[c for c in base.columns if c not in key]).alias("b")).join(last, key, "full_outer")
    return both.select(*key, F.coalesce("r", "b").alias("r")).select(*key, "r.*")


def upsert_conflicts(base: DataFrame, changes: DataFrame, key: str, other: str) -> DataFrame:
    """Changes whose `other` column already belongs to a different key."""
    b = base.select(F.col(key).alias("held_by"), F.col(other).alias("_o"))
    return changes.join(b, F.col(other) == F.col("_o")).where(F.col(key) != F.col("held_by")).select(key, other, "held_by")


def replay(ledger: DataFrame, by: list[str], order: list[str], op: str, value: str) -> DataFrame:
    """State after an append-only ledger: the last `set` of each key, unless a later `delete` removed it; with the number of entries."""
    at = F.struct(*order)
    out = ledger.groupBy(*by).agg(F.max_by(op, at).alias("last_op"), F.max_by(F.when(F.col(op) != "delete", F.col(value)), F.when(F.col(op) != "delete", at)).alias("value"), F.count("*").alias("entries"))
    return out.where(F.col("last_op") != "delete")


def window_add(window: DataFrame, point: str, chapter: str | None, status: str) -> DataFrame:
    """Rows (point, chapter, status) after an entry: a missing chapter on either side matches any and is filled in.

    More than one match is an error, as the caller must say which is meant.
    """
    same = (F.col("point") == point) & (F.col("chapter").isNull() | F.lit(chapter is None) | F.col("chapter").eqNullSafe(F.lit(chapter)))
    n = window.where(same).count()
    if n > 1:
        raise ValueError(f"{point!r} is listed in {n} chapters")
    if not n:
        return window.unionByName(window.sparkSession.createDataFrame([(point, chapter, status)], "point string, chapter string, status string"))
    return window.select("point", F.when(same, F.coalesce(F.lit(chapter), F.col("chapter"))).otherwise(F.col("chapter")).alias("chapter"), F.when(same, F.lit(status)).otherwise(F.col("status")).alias("status"))


def next_phase(plan: DataFrame, by: list[str], order: str, phase: str) -> DataFrame:
    """Each phase of a plan with the one that may follow it."""
    return plan.withColumn("next_phase", F.lead(phase).over(Window.partitionBy(*by).orderBy(order)))


def batches(pages: DataFrame, by: list[str], order: list[str], size: int = 8, most: int = 512) -> DataFrame:
    """Pages dealt to consecutive batches of at most `size`; `over` marks batches beyond the limit of a session."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return pages.withColumn("batch", F.floor(n / size)).withColumn("over", F.col("batch") >= most)


def latest_status(entries: DataFrame, key: list[str], order: list[str], status: str) -> DataFrame:
    """The last status of each key."""
    return entries.groupBy(*key).agg(F.max_by(status, F.struct(*order)).alias(status))


def attributed(issues: DataFrame, units: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues with the chapter of their unit, else of their page, else of their source if it has one chapter only."""
    one = sources.groupBy("source_id").agg(F.min("chapter").alias("s_chapter"), F.count_distinct("chapter").alias("n")).where("n = 1").drop("n")
    out = issues.join(units.select("unit_id", F.col("chapter").alias("u_chapter")), "unit_id", "left")
    out = out.join(pages.select("source_id", "page", F.col("chapter").alias("p_chapter")), ["source_id", "page"], "left").join(one, "source_id", "left")
    return out.withColumn("chapter", F.coalesce("u_chapter", "p_chapter", "s_chapter")).drop("u_chapter", "p_chapter", "s_chapter")


def merged_candidates(candidates: DataFrame, keys: list[str], text: str, severity: str, order: str) -> DataFrame:
    """One row a key: blocking if any is, and the distinct texts in order of arrival joined by ` | `."""
    first = candidates.groupBy(*keys, text).agg(F.min(order).alias("_at"))
    texts = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", text))), lambda x: x[text]), " | ").alias(text))
    worst = candidates.groupBy(*keys).agg(F.when(F.bool_or(F.col(severity) == "blocking"), "blocking").otherwise("warning").alias(severity))
    return worst.join(texts, keys)

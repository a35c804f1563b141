"""Replay of session transcripts: carry-forward, snapshots, growth, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(turns: DataFrame, by: list[str], order: list[str], value: str, default: object, into: str) -> DataFrame:
    """The last value that was set, or the default before any."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(into, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def set_changes(snapshots: DataFrame, by: list[str], order: list[str], items: str) -> DataFrame:
    """How many entries each snapshot gained and lost against the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(items).over(w)
    none = F.array().cast(snapshots.schema[items].dataType)
    return snapshots.withColumn("added", F.size(F.array_except(items, F.coalesce(before, none)))).withColumn("lost", F.when(before.isNull(), 0).otherwise(F.size(F.array_except(before, items))))


def window_changes(before: Column, now: Column) -> tuple[Column, Column]:
    """(added, lost) of entries `point@chapter`; an entry that only got its chapter is the same one.

    Exact entries match first. Then an entry without a chapter takes one entry of its point that has
    one. Entries are distinct, so for each point the number of such pairs is the lesser of the two counts.
    """
    gone, new = F.array_except(before, now), F.array_except(now, before)
    loose = F.filter(gone, lambda x: F.endswith(x, F.lit("@")))
    point = lambda x: F.regexp_replace(x, "@[^@]*$", "@")
    filled = F.size(F.filter(loose, lambda x: F.exists(new, lambda y: point(y) == x)))
    return F.size(new) - filled, F.size(gone) - filled


def growth(turns: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """First, last and ratio (four places) of a measure over a session."""
    at = F.struct(*order)
    out = turns.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return out.withColumn("ratio", F.round(F.try_divide(F.col("last"), F.col("first")), 4))


def quiz_provenance(asked: DataFrame, bank: DataFrame, by: list[str]) -> DataFrame:
    """Asked items, those the bank has, those it lacks and their share; `asked` has (by, id)."""
    rows = asked.join(bank.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    out = rows.groupBy(*by).agg(F.count("*").alias("items"), F.count("known").alias("bank_backed"))
    return out.withColumn("invented", F.col("items") - F.col("bank_backed")).withColumn("invention_rate", F.round(F.try_divide("invented", "items"), 4))


def check_thresholds(metrics: DataFrame, by: list[str], rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, metric, got, want, side) of every broken rule; rules are metric -> (min or max, limit)."""
    names = list(rules)
    long = metrics.unpivot(by, [F.col(m).cast("double").alias(m) for m in names], "metric", "got")
    table = metrics.sparkSession.createDataFrame([(m, s, float(v)) for m, (s, v) in rules.items()], "metric string, side string, want double")
    broken = F.when(F.col("side") == "min", F.col("got") < F.col("want")).otherwise(F.col("got") > F.col("want"))
    return long.join(F.broadcast(table), "metric").where(F.coalesce(broken, F.lit(True))).select(*by, "metric", "got", "want", "side")


def looks_like_question(text: Column) -> Column:
    return F.rtrim(F.coalesce(text, F.lit(""))).rlike(r"[?？]\s*$")


def anchors(headings: DataFrame, by: list[str], order: str, slug: str) -> DataFrame:
    """Slugs made unique by -1, -2 ... in the order of the headings."""
    n = F.row_number().over(Window.partitionBy(*by, slug).orderBy(order)) - 1
    return headings.withColumn("anchor", F.when(n > 0, F.concat_ws("-", slug, n.cast("string"))).otherwise(F.col(slug)))


def snapshots(turns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Which snapshot of a turn counts (`source`: state, view or none), its phase, whether the view was written against the state (`view_edit`) and whether the turn can't be judged (`malformed`).

    `turns` has state_phase and view_phase (null without a snapshot), state_written and view_written.
    The state counts as soon as it was seen; from then on a view that is written alone, or that
    shows another phase than the state of the same turn, is an edit by hand.
    """
    has_state, has_view = F.col("state_phase").isNotNull(), F.col("view_phase").isNotNull()
    touched = has_state | F.coalesce("state_written", F.lit(False))
    view = has_view | F.coalesce("view_written", F.lit(False))
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.max(touched.cast("int")).over(so_far) == 1
    rows = turns.withColumn("_known", known)
    source = F.when(has_state, "state").when(has_view & ~F.col("_known"), "view")
    malformed = (has_view & F.coalesce("state_written", F.lit(False)) & ~has_state) | (has_state & F.coalesce("view_written", F.lit(False)) & ~has_view)
    edited = (F.col("_known") & view & ~touched) | F.coalesce(F.col("state_phase") != F.col("view_phase"), F.lit(False))
    return rows.select(*by, *order, source.alias("source"), F.when(has_state, F.col("state_phase")).when(source == "view", F.col("view_phase")).alias("phase"), edited.alias("view_edit"), malformed.alias("malformed"))

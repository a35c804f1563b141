"""Scores of extracted units against gold: chapters, pairs, provenance, visuals, leaks, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.operators.stats import prf

# Sides that a question must not show.
LEAKING_ROLES, LEAKING_KINDS = ("answer_context", "worked_solution", "student_attempt"), ("answer", "speaker_notes")


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def agreement(gold: DataFrame, predicted: DataFrame, field: str, *, skip_null: bool) -> DataFrame:
    """One row: right, total and accuracy of a field of units (unit_id); a unit that wasn't found is wrong."""
    rows = gold.where(F.col(field).isNotNull()) if skip_null else gold
    both = rows.select("unit_id", F.col(field).alias("want")).join(predicted.select("unit_id", F.col(field).alias("got"), F.lit(True).alias("found")), "unit_id", "left")
    right = F.col("found") & F.col("want").eqNullSafe(F.col("got"))
    out = both.agg(F.count_if(F.coalesce(right, F.lit(False))).alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def pair_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: counts, precision, recall and F1 of a set of pairs."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    c = g.join(p, keys, "full_outer").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return c.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def visual_recall(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: units that need a picture, and those found with one that isn't a student's."""
    need = gold.where("requires_visual").select("unit_id")
    ok = predicted.where(F.col("requires_visual") & F.col("asset_role").isNotNull() & (F.col("asset_role") != "student_attempt") & F.col("asset_path").isNotNull() & F.col("asset_sha256").isNotNull())
    out = need.join(ok.select("unit_id", F.lit(True).alias("ok")), "unit_id", "left").agg(F.count("ok").alias("recovered"), F.count("*").alias("total"))
    return out.withColumn("recall", ratio(F.col("recovered"), F.col("total")))


def leaks(predicted: DataFrame) -> DataFrame:
    """Units of the answer side that a question shows."""
    side = F.coalesce(F.col("asset_role").isin(*LEAKING_ROLES), F.lit(False)) | F.col("kind").isin(*LEAKING_KINDS)
    return predicted.where(F.col("exposed_in_question") & side).select("unit_id")


def retrieval_scores(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: queries, recall at 1 and 5, mean reciprocal rank; `gold` is (query_id, relevant), `ranked` (query_id, units). Each query is rounded before the mean."""
    rows = gold.join(ranked, "query_id", "left")
    n = F.size("relevant")
    at = lambda k: F.round(F.coalesce(F.size(F.array_intersect(F.slice("units", 1, k), "relevant")), F.lit(0)) / n, 6)
    places = F.filter(F.transform("units", lambda u, i: F.when(F.array_contains("relevant", u), i + 1)), lambda i: i.isNotNull())
    out = rows.agg(
        F.count("*").alias("queries"), F.coalesce(F.round(F.avg(at(1)), 6), F.lit(0.0)).alias("recall_at_1"), F.coalesce(F.round(F.avg(at(5)), 6), F.lit(0.0)).alias("recall_at_5"),
        F.coalesce(F.round(F.avg(F.coalesce(1 / F.get(places, F.lit(0)), F.lit(0.0))), 6), F.lit(0.0)).alias("mrr"),
    )
    return out


def math_readiness(chapters: DataFrame, fields: DataFrame) -> DataFrame:
    """(chapter, status, reasons, formulas, substitutions, symbols, spans) of chapters (chapter, wiki, manifest, local_risk, global_risk).

    `manifest` is valid, invalid or missing, `wiki` the chapter's text, and the risks are open
    reviews. `fields` (chapter, field, text) are the strings of a manifest. Damaged evidence needs
    recovery, and never passes for a chapter without mathematics.
    """
    from lyceum.functions.mathtext import spans_of

    said = fields.withColumn("spans", F.size(spans_of("text")))
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    count = lambda name: F.count_if(filled & (F.col("field") == name))
    found = said.groupBy("chapter").agg(count("latex").alias("formulas"), count("substitution").alias("substitutions"), count("symbol").alias("symbols"), F.sum("spans").alias("spans"))
    both = chapters.join(found, "chapter", "left")
    valid = F.col("manifest") == "valid"
    n = lambda c: F.when(valid, F.coalesce(c, F.lit(0))).otherwise(0)
    reasons = F.array(
        F.when(F.col("manifest") == "invalid", "chapter_teaching_manifest_invalid"), F.when(F.col("manifest") == "missing", "chapter_teaching_manifest_missing"), F.when(F.col("wiki").isNull(), "chapter_wiki_missing_or_ambiguous"),
        F.when(F.col("wiki").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "unsafe_control_text"), F.when(F.contains("wiki", F.lit("\ufffd")), "unicode_replacement_text"),
        F.when(F.col("local_risk") > 0, "chapter_source_recovery_pending"), F.when(F.col("global_risk") > 0, "unbound_high_risk_review_pending"),
    )
    reasons = F.array_sort(F.filter(reasons, lambda r: r.isNotNull()))
    any_math = n("formulas") + n("substitutions") + n("symbols") + n("spans") > 0
    return both.select(
        "chapter", F.when(F.size(reasons) > 0, "needs_recovery").when(any_math, "standard").otherwise("none").alias("status"), reasons.alias("reasons"),
        *[n(c).cast("long").alias(c) for c in ("formulas", "substitutions", "symbols", "spans")],
    )

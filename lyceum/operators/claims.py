"""Claims that quote content units, checked against the live units and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which kind of unit a role may cite.
ROLE_KIND = {"formula_evidence": "formula", "question_evidence": "question", "answer_evidence": "answer"}


def located(proposals: DataFrame, units: DataFrame) -> DataFrame:
    """Proposals (claim_id, unit_id, quote, start) with the code-point span of their quote, or the problem: the quote must occur, and once if no start is given."""
    rows = proposals.join(units.select("unit_id", F.col("text").alias("payload")), "unit_id", "left")
    at = F.instr("payload", F.col("quote"))
    again = F.position("quote", "payload", at + 1) > 0  # overlapping ones count
    given = F.col("start").isNotNull()
    there = F.substring("payload", F.col("start") + 1, F.length("quote")) == F.col("quote")
    problem = (
        F.when(F.col("payload").isNull() | (F.col("payload") == ""), "payload_missing").when(F.trim(F.coalesce("quote", F.lit(""))) == "", "quote_blank").when(given & ~there, "quote_not_at_start")
        .when(~given & (at == 0), "quote_absent").when(~given & again, "quote_ambiguous")
    )
    first = F.when(given, F.col("start")).otherwise(at - 1)
    return rows.select("claim_id", "unit_id", "quote", F.when(problem.isNull(), first).alias("start"), F.when(problem.isNull(), first + F.length("quote")).alias("end"), problem.alias("problem"))


def verify(claims: DataFrame, units: DataFrame, sources: DataFrame, tainted: DataFrame) -> DataFrame:
    """(claim_id, problem): the first rule that a claim breaks, null if it holds.

    `claims` is (claim_id, unit_id, source_id, source_sha256, payload_sha256, role, quote, start),
    `units` (unit_id, source_id, kind, asset_role, asset_path, text), `sources` (source_id, sha256),
    `tainted` (path).
    """
    u = units.select("unit_id", F.col("source_id").alias("u_source"), F.col("kind").alias("u_kind"), F.col("asset_role").alias("u_role"), F.col("asset_path").alias("path"), F.col("text").alias("payload"))
    bad = tainted.select("path").distinct().withColumn("taint", F.lit(True))
    rows = claims.join(u, "unit_id", "left").join(sources.select("source_id", F.col("sha256").alias("live")), "source_id", "left").join(bad, "path", "left")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_KIND.items() for x in kv]), F.col("role"))
    problem = (
        F.when(F.col("u_source").isNull(), "unit_missing").when(F.col("u_source") != F.col("source_id"), "unit_stale").when(F.col("live").isNull(), "source_missing")
        .when(F.col("live") != F.col("source_sha256"), "source_stale").when(F.sha2("payload", 256) != F.col("payload_sha256"), "payload_changed")
        .when(F.substring("payload", F.col("start") + 1, F.length("quote")) != F.col("quote"), "quote_changed").when(F.col("u_role") == "student_attempt", "student_attempt")
        .when(F.col("taint"), "tainted_asset").when(kind.isNotNull() & (kind != F.col("u_kind")), "role_mismatch")
    )
    return rows.select("claim_id", problem.alias("problem"))

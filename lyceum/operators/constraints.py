"""Data rules: each rule is a filter that gives (rule, level, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(rows: DataFrame, rule: str, key: Column, level: str = "error") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), key.cast("string").alias("key"))


def unique(rows: DataFrame, rule: str, key: str) -> DataFrame:
    return violation(rows.groupBy(key).count().where("count > 1"), rule, F.col(key))


def present(rows: DataFrame, rule: str, key: str, column: str) -> DataFrame:
    return violation(rows.where(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")), rule, F.col(key))


def allowed(rows: DataFrame, rule: str, key: str, column: str, values: list) -> DataFrame:
    return violation(rows.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))), rule, F.col(key))


def holds(rows: DataFrame, rule: str, key: str, condition: Column, level: str = "error") -> DataFrame:
    return violation(rows.where(~F.coalesce(condition, F.lit(False))), rule, F.col(key), level)


def references(rows: DataFrame, rule: str, key: str, column: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference has no target; a null reference refers to nothing and passes."""
    held = rows.where(F.col(column).isNotNull()).join(target.select(F.col(target_key).alias("_target")).distinct(), F.col(column) == F.col("_target"), "left_anti")
    return violation(held, rule, F.col(key))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule", "level").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def readiness(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings and ready, usable_with_gaps or blocked."""
    out = violations.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return out.withColumn("state", F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "usable_with_gaps").otherwise("ready"))


def stable_id_problem(value: Column) -> Column:
    """Why an id is not stable: empty, padded, too long, or with characters that aren't printed."""
    return (
        F.when(value.isNull() | (value == ""), "empty")
        .when(value != F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), "padded")
        .when(F.length(value) > 200, "too_long")
        .when(value.rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]"), "unprintable")
    )


def unsafe_path(path: Column) -> Column:
    """Absolute paths, drive letters, back slashes and steps upwards."""
    return path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)")

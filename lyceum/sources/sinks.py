"""Sinks: spreadsheet-safe cells, JSON lines, ledgers, and a small relational export."""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_safe(cell: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def write_csv(df: DataFrame, path: str) -> None:
    cells = [csv_safe(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes]
    df.select(*cells).write.option("header", True).mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept; the commit protocol makes the write all or nothing."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


# The kinds of runs that a ledger takes.
KINDS = ("live_smoke", "benchmark", "drift", "behavior_smoke", "retrieval_gate")


def ledger_problem(e: dict[str, Column]) -> Column:
    """Why an entry isn't one for the ledger."""
    return (
        F.when(e["run_id"].isNull() | (F.trim(e["run_id"]) == ""), "run_id_missing")
        .when(~F.coalesce(e["kind"].isin(*KINDS), F.lit(False)), "kind_unknown")
        .when(F.coalesce(e["cost_usd"] < 0, F.lit(False)), "cost_negative")
        .when(~F.coalesce(e["created_at"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.lit(False)), "created_at_malformed")
    )


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append entries; a malformed one is an error and nothing is written."""
    bad = entries.withColumn("problem", ledger_problem({c: F.col(c) for c in entries.columns})).where("problem is not null").select("run_id", "problem").take(3)
    if bad:
        raise ValueError(f"entries refused: {bad}")
    entries.write.mode("append").parquet(path)


def export_sqlite(questions: DataFrame, points: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """Two tables in one local file, for banks of at most `limit` rows; another kind of file is not replaced."""
    target = Path(path)
    if target.exists() and target.read_bytes()[:16] != b"SQLite format 3\x00":
        raise ValueError(f"{path} is not a database")
    for df in (questions, points):
        if df.limit(limit + 1).count() > limit:
            raise ValueError(f"more than {limit} rows")
    target.unlink(missing_ok=True)
    with sqlite3.connect(path) as db:
        for name, df in (("questions", questions), ("knowledge_points", points)):
            db.execute(f"create table {name} ({', '.join(df.columns)})")
            db.executemany(f"insert into {name} values ({', '.join('?' * len(df.columns))})", [tuple(r) for r in df.collect()])
    db.close()

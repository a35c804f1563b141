"""Append-only ledgers replayed onto a base: patches of units, decisions on conflicts, states of batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Conflicts that block, and the order of a batch's states.
BLOCKING = ("answer_mismatch", "boolean_mismatch", "numeric_mismatch", "formula_mismatch")
BATCH_STATES = ("planned", "visual_ready", "taught")
UNIT = ["unit_id", "kind", "text", "chapter_id", "phase_id", "asset_role", "paired_unit_id"]
UNIT_SCHEMA = ", ".join(f"{c} string" for c in UNIT)


def unit_digest(u: dict) -> str:
    return hashlib.sha256("\x1f".join("" if u[c] is None else str(u[c]) for c in UNIT).encode()).hexdigest()


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """One unit after its operations in order; an operation that doesn't fit changes nothing and is reported."""
    state: dict | None = None
    changed, problems = 0, []
    for r in rows.sort_values("seq").astype(object).to_dict("records"):
        r = {k: None if v is None or v != v else v for k, v in r.items()}
        given, op, new = {c: r[c] for c in UNIT}, r["op"], None
        if op == "base":
            state = given
            continue
        if op == "add_unit":
            new = given if state is None else state
            problems += ["add_collides"] if state not in (None, given) else []
        elif state is None:
            problems.append(f"{op}_without_unit")
            continue
        elif op == "replace_unit":
            stale = r["expected_sha256"] != unit_digest(state)
            problems += ["replace_stale"] if stale else []
            new = state if stale else given
        elif op == "assign_chapter":
            new = state | {c: r[c] for c in ("chapter_id", "phase_id")}
        elif op == "classify_asset":
            new = state | {"asset_role": r["asset_role"]}
        elif op in ("pair_question", "pair_answer"):
            fits = state["kind"] == op.removeprefix("pair_")
            problems += [] if fits else ["pair_kind"]
            new = state | {"paired_unit_id": r["paired_unit_id"]} if fits else state
        else:
            problems.append("operation_unknown")
            continue
        changed += new != state
        state = new
    last = state or dict.fromkeys(UNIT)
    unit_id = rows["unit_id"].iloc[0]
    return pd.DataFrame([[unit_id, *[last[c] for c in UNIT[1:]], state is not None, changed, ",".join(problems)]], columns=[*UNIT, "exists", "changed", "problems"])


def replay(units: DataFrame, operations: DataFrame) -> DataFrame:
    """Units after a ledger of operations (seq, op, unit columns, expected_sha256): whether each exists, how often it changed, and what didn't fit.

    Operations: add_unit, replace_unit (bound to the digest of what it replaces), assign_chapter,
    classify_asset, and pair_qa, whose two units must be a question and an answer. A pairing is split
    into one row for each of its units, so units fold apart from each other.
    """
    cols = ["seq", "op", *UNIT, "expected_sha256"]
    ops = operations.where("op <> 'pair_qa'").select(*cols)
    pairs = operations.where("op = 'pair_qa'")
    other = lambda op, own, mate: pairs.select("seq", F.lit(op).alias("op"), F.col(own).alias("unit_id"), *[F.lit(None).cast("string").alias(c) for c in UNIT[1:-1]], F.col(mate).alias("paired_unit_id"), F.lit(None).cast("string").alias("expected_sha256"))
    base = units.select(F.lit(-1).cast("long").alias("seq"), F.lit("base").alias("op"), *UNIT, F.lit(None).cast("string").alias("expected_sha256"))
    rows = base.unionByName(ops).unionByName(other("pair_question", "unit_id", "paired_unit_id")).unionByName(other("pair_answer", "paired_unit_id", "unit_id"))
    return rows.groupBy("unit_id").applyInPandas(_fold, UNIT_SCHEMA + ", exists boolean, changed long, problems string")


def overlay(conflicts: DataFrame, patches: DataFrame) -> DataFrame:
    """Conflicts (conflict_id, kind, issue_id) with the status that applied patches (issue_id, patch_id, op, status, reason) give them.

    A resolved one keeps both sides, which a blocking kind doesn't allow; other operations leave it open. `problem` names what is refused.
    """
    done = patches.where("status = 'applied'")
    last = done.groupBy("issue_id").agg(F.count("*").alias("n"), F.min(F.struct("patch_id", "op", "reason")).alias("p"))
    rows = conflicts.join(last, "issue_id", "left")
    op, blocking = F.col("p.op"), F.col("kind").isin(*BLOCKING)
    problem = F.when(F.col("n") > 1, "several_patches").when((op == "mark_resolved") & blocking, "blocking_needs_correction")
    status = F.when(problem.isNotNull() | op.isNull(), "unresolved").when(op == "mark_resolved", "resolved_keep_both").when(op == "mark_unrecoverable", "unrecoverable").otherwise("unresolved")
    return rows.select("conflict_id", "kind", status.alias("status"), F.when(status != "unresolved", F.col("p.patch_id")).alias("patch_id"), problem.alias("problem"))


def conflict_reviews(conflicts: DataFrame, units: DataFrame) -> DataFrame:
    """One row for each source of an open conflict (conflict_id, kind, left_id, right_id): its units, pages and severity."""
    each = conflicts.select("conflict_id", "kind", F.explode(F.array("left_id", "right_id")).alias("unit_id")).join(units.select("unit_id", "source", "page"), "unit_id")
    severity = F.when(F.first("kind").isin(*BLOCKING), "blocking").otherwise("warning")
    return each.groupBy("conflict_id", "source").agg(severity.alias("severity"), F.array_sort(F.collect_set("unit_id")).alias("targets"), F.array_sort(F.collect_set("page")).alias("pages"))


def batch_states(events: DataFrame) -> DataFrame:
    """The state of each batch from events (batch, seq, state), which must follow the order of states one by one; `skipped` counts events that don't."""

    place = F.array_position(F.array(*map(F.lit, BATCH_STATES)), F.col("state")).cast("int") - 1
    history = F.transform(F.array_sort(F.collect_list(F.struct("seq", place.alias("place")))), lambda x: x["place"])
    start = F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("skipped"))
    follows = lambda now, step: F.coalesce(step == now["place"] + 1, F.lit(False))
    step = lambda now, s: F.struct(F.when(follows(now, s), s).otherwise(now["place"]).alias("place"), (now["skipped"] + F.when(follows(now, s), 0).otherwise(1)).alias("skipped"))
    done = events.groupBy("batch").agg(F.aggregate(history, start, step).alias("end"))
    return done.select("batch", F.get(F.array(*map(F.lit, BATCH_STATES)), F.col("end.place")).alias("state"), F.col("end.skipped").alias("skipped"))

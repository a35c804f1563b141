"""Promotion gate of a retrieval backend: enough evidence, paired effects, three-state decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.operators.stats import bootstrap_interval, mcnemar_exact

# The limits; overrides may only tighten them.
LIMITS = {
    "min_total_queries": 180, "min_answerable_queries": 120, "min_oos_queries": 40, "min_courses": 3, "min_answerable_per_course": 30, "min_queries_per_critical_slice": 20,
    "baseline_recall_at_5_floor": 0.90, "baseline_slice_floor": 0.85, "min_delta_recall_at_5": 0.05, "candidate_recall_at_5_floor": 0.92, "candidate_slice_floor": 0.85, "max_slice_regression": 0.02,
    "max_mrr_regression": 0.01, "max_false_accepts": 0, "max_hard_negative_intrusion_at_5": 0.05, "max_p95_latency_ms": 500.0, "max_latency_multiple": 10.0, "max_index_size_multiple": 10.0,
    "max_index_bytes_per_100k_docs": 1 << 30, "min_top5_stability": 0.99, "max_p_value": 0.05, "reranker_min_delta_mrr": 0.05, "reranker_min_delta_recall_at_1": 0.05,
}
INSUFFICIENT, NO_GO, GO = "INSUFFICIENT_EVIDENCE", "NO_GO", "GO_OPTIONAL"


def limits(overrides: dict[str, float] | None = None) -> dict[str, float]:
    """The limits with overrides; one that is unknown or loosens a limit is an error."""
    out = dict(LIMITS)
    for name, value in (overrides or {}).items():
        if name not in out:
            raise ValueError(f"unknown limit {name}")
        looser = value > out[name] if name.startswith("max_") else value < out[name]
        if looser:
            raise ValueError(f"{name} may only be tightened")
        out[name] = value
    return out


def sufficiency(gold: DataFrame, slices: list[str], lim: dict[str, float]) -> list[str]:
    """Why a gold set (query_id, course_id, answerable, tags) can't carry a decision; its counts by course and tag come to the driver, not its queries."""
    total, answerable = gold.agg(F.count("*"), F.count_if("answerable")).first()
    courses = {r["course_id"]: r["count"] for r in gold.where("answerable").groupBy("course_id").count().collect()}
    tags = {r["tag"]: r["count"] for r in gold.where("answerable").select(F.explode(F.array_distinct("tags")).alias("tag")).where(F.col("tag").isin(slices)).groupBy("tag").count().collect()}
    found = {
        "too_few_total_queries": total < lim["min_total_queries"], "too_few_answerable_queries": answerable < lim["min_answerable_queries"], "too_few_near_miss_oos_queries": total - answerable < lim["min_oos_queries"],
        "too_few_courses": len(courses) < lim["min_courses"], "course_answerable_floor_not_met": any(n < lim["min_answerable_per_course"] for n in courses.values()),
        "critical_slice_floor_not_met": any(tags.get(s, 0) < lim["min_queries_per_critical_slice"] for s in slices),
    }
    return [name for name, fails in found.items() if fails]


def slice_recall(metrics: DataFrame, gold: DataFrame) -> DataFrame:
    """(tag, queries, recall_5) of answerable queries."""
    each = metrics.join(gold.select("query_id", F.explode(F.array_distinct("tags")).alias("tag")), "query_id").where("answerable")
    return each.groupBy("tag").agg(F.count("*").alias("queries"), F.round(F.avg("recall_5"), 6).alias("recall_5"))


def compare(baseline: DataFrame, candidate: DataFrame, resamples: int = 5000, seed: int = 20260714) -> dict:
    """Paired effects of two tables of query metrics over the same answerable queries: a gold set has hundreds."""
    cols = ("recall_1", "recall_5", "reciprocal_rank", "hit_1", "hit_5")
    both = baseline.where("answerable").select("query_id", *[F.col(c).alias(f"b_{c}") for c in cols]).join(candidate.where("answerable").select("query_id", *cols), "query_id", "full_outer")
    rows = both.orderBy("query_id").collect()
    if any(r[c] is None or r[f"b_{c}"] is None for r in rows for c in cols):
        raise ValueError("the runs don't cover the same queries")
    out = {}
    for c in ("recall_1", "recall_5", "reciprocal_rank"):
        delta, lo, hi = bootstrap_interval([r[f"b_{c}"] for r in rows], [r[c] for r in rows], resamples, seed)
        out[c] = {"delta": round(delta, 6), "low": round(lo, 6), "high": round(hi, 6)}
    for c in ("hit_1", "hit_5"):
        out[f"{c}_p"] = mcnemar_exact(sum(r[f"b_{c}"] > r[c] for r in rows), sum(r[f"b_{c}"] < r[c] for r in rows))
    return out


def operability(base: dict, cand: dict, lim: dict[str, float]) -> list[str]:
    """Limits on latency, index size and stability that a candidate breaks."""
    per = cand["index_size_bytes"] * 100_000 / cand["indexed_docs"] if cand["indexed_docs"] else 0
    found = {
        "candidate_p95_latency_too_high": cand["p95_latency_ms"] > lim["max_p95_latency_ms"],
        "candidate_latency_multiple_too_high": 0 < base["p95_latency_ms"] * lim["max_latency_multiple"] < cand["p95_latency_ms"],
        "candidate_index_size_multiple_too_high": 0 < base["index_size_bytes"] * lim["max_index_size_multiple"] < cand["index_size_bytes"],
        "candidate_index_bytes_per_100k_docs_too_high": per > lim["max_index_bytes_per_100k_docs"], "candidate_top5_stability_too_low": cand["top5_stability"] < lim["min_top5_stability"],
    }
    return [name for name, fails in found.items() if fails]


def decide(missing: list[str], base: dict | None, cand: dict | None, effects: dict | None, slices: list[str], lim: dict[str, float]) -> tuple[str, list[str]]:
    """(decision, reasons). `base` and `cand` have kind, recall_5, intrusion, false_accepts, missing, slices (tag to recall) and resources."""
    if missing:
        return INSUFFICIENT, missing
    if base is None or cand is None:
        return INSUFFICIENT, ["baseline_receipt_missing" if base is None else "candidate_receipt_missing"]
    if base["kind"] != "bm25":
        return NO_GO, ["baseline_is_not_bm25"]
    reranks = cand["kind"] == "reranker"
    if not reranks and base["recall_5"] >= lim["baseline_recall_at_5_floor"] and all(base["slices"].get(s, 0) >= lim["baseline_slice_floor"] for s in slices):
        return NO_GO, ["bm25_adequate_no_heavy_backend_needed"]
    if not reranks and cand["kind"] not in ("rrf", "hybrid"):
        return NO_GO, ["candidate_kind_is_experiment_only"]
    found = {
        "candidate_missing_query_results": cand["missing"] > 0, "candidate_oos_false_accepts": cand["false_accepts"] > lim["max_false_accepts"],
        "candidate_hard_negative_intrusion_too_high": cand["intrusion"] > lim["max_hard_negative_intrusion_at_5"], "candidate_hard_negative_intrusion_regressed": cand["intrusion"] > base["intrusion"] + 1e-12,
    }
    for s in slices:
        b, c = base["slices"].get(s), cand["slices"].get(s)
        found[f"critical_slice_missing:{s}"] = b is None or c is None
        found[f"candidate_slice_below_floor:{s}"] = c is not None and b is not None and c < lim["candidate_slice_floor"]
        found[f"candidate_slice_regressed:{s}"] = c is not None and b is not None and c < b - lim["max_slice_regression"]
    failed = [name for name, fails in found.items() if fails] + operability(base["resources"], cand["resources"], lim)
    one, five, mrr = effects["recall_1"], effects["recall_5"], effects["reciprocal_rank"]
    if reranks:
        more = {
            "reranker_recall_at_1_gain_too_small": one["delta"] < lim["reranker_min_delta_recall_at_1"], "reranker_recall_at_1_ci_not_positive": one["low"] <= 0,
            "reranker_mrr_gain_too_small": mrr["delta"] < lim["reranker_min_delta_mrr"], "reranker_mrr_ci_not_positive": mrr["low"] <= 0,
            "reranker_hit_at_1_not_significant": effects["hit_1_p"] >= lim["max_p_value"], "reranker_recall_at_5_regressed": cand["recall_5"] < base["recall_5"],
        }
    else:
        more = {
            "candidate_recall_at_5_gain_too_small": five["delta"] < lim["min_delta_recall_at_5"], "candidate_recall_at_5_ci_not_positive": five["low"] <= 0,
            "candidate_hit_at_5_not_significant": effects["hit_5_p"] >= lim["max_p_value"], "candidate_recall_at_5_below_floor": cand["recall_5"] < lim["candidate_recall_at_5_floor"],
            "candidate_mrr_regressed": mrr["delta"] < -lim["max_mrr_regression"],
        }
    failed += [name for name, fails in more.items() if fails]
    return (NO_GO, failed) if failed else (GO, ["reranker_passed_optional_gate" if reranks else "hybrid_passed_optional_gate"])

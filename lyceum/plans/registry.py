"""Named queries over the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lyceum.plans import corpus, materials, reports, rules, study, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus.QUERIES, **materials.QUERIES, **study.QUERIES, **workspace.QUERIES, **rules.QUERIES, **reports.QUERIES}
ORACLE: dict[str, str] = {**corpus.ORACLE, **materials.ORACLE, **study.ORACLE, **workspace.ORACLE, **rules.ORACLE, **reports.ORACLE}

#: The query that the smoke check runs.
flagship = corpus.bm25_topk

"""Queries of reports and bookkeeping: arms, courses, traced recall, identities of units, windows, collisions, notebooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lyceum.operators import chunking, duplicates, extraction, matrix, sessions, state
from lyceum.plans import study
from lyceum.plans.workspace import _pick, _sql_pick
from lyceum.session import prepare, table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(prepare(spark), sf_dir, name)


def arm_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of orders as scored answers, by priority."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("arm"), (k % 6 != 0).alias("answerable"), F.when(k % 4 == 0, "numeric").otherwise("factual").alias("answer_type"), F.when(k % 9 != 0, (k % 5) / 4.0).alias("faithfulness"), (k % 7 == 0).alias("hallucinated"),
        (k % 3 != 0).alias("correct"), (k % 10 < 8).alias("abstained"),
    )
    return matrix.arm_means(rows)


def course_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses of the benchmark matrix in one row each."""
    return matrix.course_summary(matrix.merge_rows(*study._runs(spark, sf_dir)))


def traced_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether orders' lines, as opened files, hold the chapter of the order."""
    items = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 8 != 0, F.concat(F.lit("notes/ch0"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(".md"))).otherwise("notes/readme.md").alias("source_file"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(False)).alias("answerable"))
    files = F.collect_list(F.when(F.col("l_linenumber") > 1, F.concat(F.lit("lec_"), (F.col("l_partkey") % 12).cast("string"), F.lit("/x.md"))))
    runs = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(files.alias("files"))
    answers = runs.select(F.col("l_orderkey").alias("item_id"), _pick(("a", "b"), F.col("l_orderkey")).alias("model"), _pick(("skill", "rawfiles", "closedbook"), F.col("l_orderkey")).alias("arm"), "files")
    return matrix.traced_recall(answers, items)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("conv_id"), F.col("turn")
    said = F.when(k % 2 == 0, F.concat(F.lit("q"), (c % 6).cast("string"))).otherwise(F.concat(F.lit("a "), (c % 4).cast("string")))
    return _t(spark, sf_dir, "conversations").select(
        (c * 100 + k).alias("unit_id"), F.when(k % 2 == 0, "question").otherwise("answer").alias("kind"), said.alias("text"), F.concat(F.lit("ch"), (c % 2 + 1).cast("string")).alias("chapter_id"), F.when(c % 5 == 0, "ai_supplemented").otherwise("material").alias("provenance"),
        F.when(c % 3 == 0, "p.png").alias("asset_path"), F.when(c % 3 == 0, "figure").alias("asset_role"), F.lit(None).cast("string").alias("asset_sha256"), F.when((k % 2 == 0) & (c % 7 != 0), c * 100 + k + 1).alias("paired_unit_id"),
    )


def unit_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of turns that are one unit: equal text, asset, pairing and compatibility."""
    rows = duplicates.identities(_units(spark, sf_dir))
    return rows.groupBy("block", "fingerprint").agg(F.count("*").alias("n"), F.min("unit_id").alias("first_id")).where("n > 1").select("n", "first_id")


def compatibility_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by compatibility key."""
    return duplicates.identities(_units(spark, sf_dir)).groupBy("block").agg(F.count("*").alias("n"))


def window_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a window that came and went, where one that only got its chapter stays."""
    c = F.col("c_custkey")
    entry = lambda p, ch: F.concat(F.lit("p"), p.cast("string"), F.lit("@"), ch)
    before = F.array(entry(c % 4, F.when(c % 3 == 0, "ch1").otherwise("")), entry(c % 4 + 4, F.lit("ch2")), entry(c % 5 + 10, F.lit("")))
    now = F.array(entry(c % 4, F.when(c % 2 == 0, "ch1").otherwise("ch3")), entry(c % 8 + 4, F.lit("ch2")), entry(c % 6 + 10, F.when(c % 7 == 0, "").otherwise("ch5")))
    added, lost = sessions.window_changes(F.array_distinct(before), F.array_distinct(now))
    return _t(spark, sf_dir, "customer").select("c_custkey", added.cast("long").alias("added"), lost.cast("long").alias("lost"))


def manifest_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose path another source already holds."""
    base = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"))
    changes = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("source_id"), F.concat(F.lit("f"), (F.col("p_partkey") % 130).cast("string")).alias("path"))
    return state.upsert_conflicts(base, changes, "source_id", "path").groupBy("source_id", "path", "held_by").agg(F.count("*").alias("n"))


def latest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last kind of event of every user."""
    return state.latest_status(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@F.pandas_udf(ArrayType(StructType([StructField("id", StringType()), StructField("title", StringType()), StructField("line", IntegerType()), StructField("lines", IntegerType())])))
def _entries(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("id", "title", "line", "lines"), e, strict=True)) for e in chunking.notebook_entries(t)])


def notebook_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of notebook chapters made of documents, with a fenced example in the first."""
    d = F.col("doc_id").cast("string")
    note = F.concat(F.lit("before\n## [#a"), d, F.lit("] First\n~~~~\n## [#no] in a fence\n~~~\n~~~~\n## [#b"), d, F.lit("]\n"), F.regexp_replace("text", "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", " "))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.explode(_entries(note)).alias("e"))
    return rows.select("doc_id", "e.id", "e.title", "e.line", "e.lines")


def session_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users' events by the snapshot that counts, and edits of the view."""
    e, u = F.col("event_id"), F.col("user_id")
    turns = _t(spark, sf_dir, "events").select(
        u.alias("session"), e.alias("turn"), F.when((e % 5 == 0) & (u % 4 != 0), (e % 3).cast("int")).alias("state_phase"), F.when(e % 2 == 0, (e % 3 + F.when(e % 20 == 0, 1).otherwise(0)).cast("int")).alias("view_phase"), (e % 7 == 0).alias("state_written"), (e % 3 == 0).alias("view_written")
    )
    out = sessions.snapshots(turns, ["session"], ["turn"])
    return out.groupBy("session", "source", "view_edit", "malformed").agg(F.count("*").alias("n"), F.max("phase").alias("phase"))


FIELDS = ("cost $x^2$ and", "shown $$\\frac{a}{b}$$ ok $y$", "plain", " ", "$open")


def math_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chapters, whose lines are the strings of a manifest."""
    p = F.col("p_partkey")
    wiki = F.when(p % 11 != 0, F.concat(F.lit("text\t\n"), F.when(p % 13 == 0, "\x01").otherwise(""), F.when(p % 17 == 0, "\ufffd").otherwise("")))
    chapters = _t(spark, sf_dir, "part").select(p.alias("chapter"), _pick(("valid", "valid", "valid", "invalid", "missing"), p).alias("manifest"), wiki.alias("wiki"), (p % 19 == 0).cast("int").alias("local_risk"), (p % 23 == 0).cast("int").alias("global_risk"))
    k = F.col("l_orderkey")
    fields = _t(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("chapter"), _pick(("latex", "substitution", "symbol", "explanation"), k).alias("field"), _pick(FIELDS, k).alias("text"))
    out = extraction.math_readiness(chapters, fields)
    return out.withColumn("reasons", F.array_join("reasons", ","))


QUERIES = {f.__name__: f for f in (arm_means, course_summary, traced_recall, unit_identities, compatibility_blocks, window_matches, manifest_collisions, latest_statuses, notebook_entries, session_snapshots, math_readiness)}

_UNITS_SQL = """
u as (select conv_id * 100 + turn as unit_id, turn % 2 = 0 as q, case when turn % 2 = 0 then 'q' || (conv_id % 6) else 'a ' || (conv_id % 4) end as text, 'ch' || lpad((conv_id % 2 + 1)::varchar, 2, '0') as chapter, conv_id % 5 = 0 as ai, conv_id % 3 = 0 as asset,
  case when turn % 2 = 0 and conv_id % 7 <> 0 then conv_id * 100 + turn + 1 end as paired from conversations),
f as (select u.*, case when not u.q then '-' when u.paired is null then 'unpaired' when a.unit_id is null then 'missing:' || u.paired else a.text || a.asset::varchar end as pairing from u left join u a on a.unit_id = u.paired and not a.q)
"""

ORACLE = {
    "arm_means": """
with r as (select o_orderpriority as arm, o_orderkey as k, o_orderkey % 6 <> 0 as ok from orders)
select arm, count(*) as n, round(avg(case when ok and k % 9 <> 0 then (k % 5) / 4.0::double end), 6) as faithfulness, round(avg((k % 7 = 0)::int), 6) as hallucination, round(avg(case when ok then (k % 3 <> 0)::int end), 6) as correctness,
  round(avg(case when ok and k % 4 = 0 then (k % 3 <> 0)::int end), 6) as numeric_accuracy, round(avg(case when not ok then (k % 10 < 8)::int end), 6) as abstention from r group by 1
""",
    "course_summary": """
with b as (select c_mktsegment as course, n_regionkey as model, o_orderpriority as arm, o_orderkey as k, round(o_totalprice / 1e6, 6) as cost from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select course, count(distinct (model, arm)) as cells, count(distinct model) as models, count(distinct arm) as arms, count(distinct k) as n_items, count(*) filter (k % 19 = 0) as failed, round(sum(cost), 4) as total_cost_usd from b group by 1
""",
    "traced_recall": f"""
with g as (select o_orderkey as k, o_orderkey % 9 + 1 as chapter from orders where o_orderkey % 5 <> 0 and o_orderkey % 8 <> 0),
a as (select l_orderkey as k, count(*) filter (l_linenumber > 1) as n, list(l_partkey % 12) filter (l_linenumber > 1) as seen from lineitem group by 1),
j as (select {_sql_pick(("a", "b"), "k")} as model, {_sql_pick(("skill", "rawfiles", "closedbook"), "k")} as arm, n, coalesce(list_contains(seen, chapter), false) as hit from g join a using (k))
select model, arm, count(*) filter (n > 0) as n_traced, count(*) filter (n > 0 and hit) as n_hit, count(*) filter (n = 0) as n_untraced, round(count(*) filter (n > 0 and hit) / nullif(count(*) filter (n > 0), 0), 4) as recall from j group by 1, 2
""",
    "unit_identities": f"with {_UNITS_SQL} select count(*) as n, min(unit_id) as first_id from f group by q, text, chapter, ai, asset, pairing having count(*) > 1",
    "compatibility_blocks": f"""with {_UNITS_SQL} select '{{"chapter_id":"' || chapter || '","kind_family":"' || case when q then 'question' else 'answer' end || '","provenance_class":"' || case when ai then 'ai_supplemented' else 'source_backed' end || '","source_side":"' || case when q then 'prompt' else 'answer' end || '"}}' as block, count(*) as n from f group by 1""",
    "window_matches": """
with c as (select c_custkey as c, list_distinct(['p' || (c_custkey % 4) || '@' || case when c_custkey % 3 = 0 then 'ch1' else '' end, 'p' || (c_custkey % 4 + 4) || '@ch2', 'p' || (c_custkey % 5 + 10) || '@']) as b,
  list_distinct(['p' || (c_custkey % 4) || '@' || case when c_custkey % 2 = 0 then 'ch1' else 'ch3' end, 'p' || (c_custkey % 8 + 4) || '@ch2', 'p' || (c_custkey % 6 + 10) || '@' || case when c_custkey % 7 = 0 then '' else 'ch5' end]) as w from customer),
d as (select c, list_filter(b, lambda x: not list_contains(w, x)) as gone, list_filter(w, lambda x: not list_contains(b, x)) as new from c),
e as (select *, len(list_filter(gone, lambda x: x like '%@' and list_contains(list_transform(new, lambda y: regexp_replace(y, '@[^@]*$', '@')), x))) as filled from d)
select c as c_custkey, len(new) - filled as added, len(gone) - filled as lost from e
""",
    "manifest_collisions": "select p_partkey % 50 as source_id, 'f' || (p_partkey % 130) as path, p_partkey % 130 as held_by, count(*) as n from part where p_partkey % 130 in (select s_suppkey from supplier) and p_partkey % 130 <> p_partkey % 50 group by 1, 2, 3",
    "latest_statuses": "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1",
    "notebook_entries": r"""
with t as (select doc_id, regexp_replace(text, '[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', ' ', 'g') as t from documents), n as (select doc_id, len(string_split(t, chr(10))) - case when t like '%' || chr(10) or t = '' then 1 else 0 end as n from t)
select doc_id, 'a' || doc_id as id, 'First' as title, 1 as line, 5 as lines from n union all select doc_id, 'b' || doc_id, 'b' || doc_id, 6, (n + 1)::int from n
""",
    "session_snapshots": """
with t as (select user_id as session, event_id as turn, case when event_id % 5 = 0 and user_id % 4 <> 0 then event_id % 3 end as st, case when event_id % 2 = 0 then event_id % 3 + case when event_id % 20 = 0 then 1 else 0 end end as vw, event_id % 7 = 0 as sw, event_id % 3 = 0 as ww from events),
k as (select *, max((st is not null or sw)::int) over (partition by session order by turn rows unbounded preceding) = 1 as known from t),
r as (select session, case when st is not null then 'state' when vw is not null and not known then 'view' end as source, case when st is not null then st when vw is not null and not known then vw end as phase,
  (known and (vw is not null or ww) and not (st is not null or sw)) or coalesce(st <> vw, false) as view_edit, (vw is not null and sw and st is null) or (st is not null and ww and vw is null) as malformed from k)
select session, source, view_edit, malformed, count(*) as n, max(phase)::int as phase from r group by 1, 2, 3, 4
""",
    "math_readiness": f"""
with f as (select l_partkey as chapter, l_orderkey % 4 as kind, list_extract([1, 2, 0, 0, 0], (l_orderkey % 5 + 1)::int) as spans, l_orderkey % 5 <> 3 as filled from lineitem where l_partkey % 3 <> 0),
g as (select chapter, count(*) filter (kind = 0 and filled) as a, count(*) filter (kind = 1 and filled) as b, count(*) filter (kind = 2 and filled) as c, sum(spans) as d from f group by 1),
j as (select p_partkey as chapter, p_partkey % 5 < 3 as valid, case when p_partkey % 5 < 3 then coalesce(a, 0) else 0 end as a, case when p_partkey % 5 < 3 then coalesce(b, 0) else 0 end as b, case when p_partkey % 5 < 3 then coalesce(c, 0) else 0 end as c, case when p_partkey % 5 < 3 then coalesce(d, 0) else 0 end as d,
  array_to_string(list_sort(list_filter([case when p_partkey % 5 = 3 then 'chapter_teaching_manifest_invalid' end, case when p_partkey % 5 = 4 then 'chapter_teaching_manifest_missing' end, case when p_partkey % 11 = 0 then 'chapter_wiki_missing_or_ambiguous' end,
    case when p_partkey % 11 <> 0 and p_partkey % 13 = 0 then 'unsafe_control_text' end, case when p_partkey % 11 <> 0 and p_partkey % 17 = 0 then 'unicode_replacement_text' end, case when p_partkey % 19 = 0 then 'chapter_source_recovery_pending' end,
    case when p_partkey % 23 = 0 then 'unbound_high_risk_review_pending' end], lambda x: x is not null)), ',') as reasons from part left join g on chapter = p_partkey)
select chapter, case when reasons <> '' then 'needs_recovery' when a + b + c + d > 0 then 'standard' else 'none' end as status, reasons, a::bigint as formulas, b::bigint as substitutions, c::bigint as symbols, d::bigint as spans from j
""",
}

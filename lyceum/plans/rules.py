"""Queries of the workspace rules: customers are workspaces, and other tables give their files, notes and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.operators import validators as v
from lyceum.plans.workspace import _pick, _sql_pick
from lyceum.session import prepare, table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(prepare(spark), sf_dir, name)


def structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required files of workspaces, of which orders give one each."""
    w = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace"), (F.col("c_custkey") % 4 == 0).alias("light"))
    k = F.col("o_orderkey")
    files = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace"), _pick(("references/wiki", "references/quiz_bank.json", "study_plan.md", "study_progress.md", "extra.md"), k).alias("path"), k)
    kind = F.when((F.col("path") == "references/wiki") == (F.col("o_orderkey") % 7 != 0), "directory").otherwise("file")
    files = files.groupBy("workspace", "path").agg(F.min("o_orderkey").alias("o_orderkey")).select("workspace", "path", kind.alias("kind"), (F.col("o_orderkey") % 11 == 0).alias("link"), (F.col("o_orderkey") % 13 == 0).alias("escapes"))
    return v.counted(v.structure(w, files))


def index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that indexes bind, against those that exist."""
    k = F.col("o_orderkey")
    w = F.col("o_custkey").alias("workspace")
    name = F.when(k % 5 == 0, "references/terms.json").otherwise(F.concat(F.lit("f"), (k % 20).cast("string")))
    digest = lambda c: F.sha2(c.cast("string"), 256)
    files = _t(spark, sf_dir, "orders").where(k % 9 != 0).groupBy(w, name.alias("path")).agg(F.max(k).alias("k")).select("workspace", "path", digest(F.col("k")).alias("sha256"), (F.col("k") % 17 == 0).alias("link"))
    bound = _t(spark, sf_dir, "orders").where((k % 10 != 5) & (k % 3 != 1)).groupBy(w, name.alias("file")).agg(F.max(k).alias("k")).select("workspace", "file", F.when(F.col("k") % 23 == 0, "zz").otherwise(digest(F.col("k"))).alias("sha256"))
    return v.counted(v.index_integrity(bound, files))


def wiki_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of a wiki folder, with names of all sorts."""
    p = F.col("page_id")
    name = F.concat(_pick(("ch", "../x", "a b", "第", "ok-"), p), p.cast("string"), F.when(p % 6 != 0, ".md").otherwise(".txt"))
    rows = _t(spark, sf_dir, "pages").select((p % 9).alias("workspace"), name.alias("name"), F.when(p % 8 == 0, "directory").otherwise("file").alias("kind"), (p % 10 == 0).alias("link"), F.when(p % 12 == 1, F.concat(F.lit("\x00"), "html")).otherwise(F.col("html")).alias("text"))
    return v.counted(v.wiki_entries(rows))


MATHS = ("see \\frac{1}{2}", "well $\\frac{1}{2}$ set", "plain", "path C:\\alpha\\x", "and \\sin x")


def raw_math_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes, each with a line of one notation or another before its last."""
    d = F.col("doc_id")
    note = F.concat(F.regexp_replace("text", r"\\", "/"), F.lit("\n"), _pick(MATHS, d), F.lit("\nend"))
    rows = _t(spark, sf_dir, "documents").select((d % 7).alias("workspace"), F.concat(F.lit("notebook/"), d.cast("string"), F.lit(".md")).alias("path"), note.alias("text"))
    return v.raw_math(rows).select("workspace", "rule", "key")


def roster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as retained items, against what is taught and asked now."""
    p = F.col("p_partkey")
    parts = _t(spark, sf_dir, "part")
    base = parts.select((p % 5).alias("workspace"), F.col("p_size").alias("chapter"), p.alias("id"))
    now = parts.where("p_partkey % 6 <> 0").select((p % 5).alias("workspace"), (F.col("p_size") + F.when(p % 14 == 1, 1).otherwise(0)).alias("chapter"), p.alias("id"))
    asked = _t(spark, sf_dir, "lineitem").where("l_partkey % 4 = 0").select((F.col("l_partkey") % 5).alias("workspace"), F.col("l_partkey").alias("id"))
    return v.counted(v.roster(base, now, asked))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    first, last = (c % 3 + 1).cast("string"), (c % 4 + 3).cast("string")
    text = F.concat(F.lit("intro 阶段 99\n# 阶段"), first, F.lit("\n- Phase "), last, F.lit("\n| 第 2 阶段 |\nPhase 50 of nothing"))
    return _t(spark, sf_dir, "customer").where("c_custkey % 8 <> 0").select(c.alias("workspace"), text.alias("text"))


def progress_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress notes against plans."""
    c = F.col("c_custkey")
    text = F.concat(F.when(c % 5 == 0, "notes\n").otherwise("疑难点\n"), F.lit("当前断点：阶段 "), (c % 7).cast("string"))
    return v.counted(v.progress_view(_t(spark, sf_dir, "customer").select(c.alias("workspace"), text.alias("text")), _plans(spark, sf_dir)))


def state_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States, their entries and checklists against plans."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    states = _t(spark, sf_dir, "customer").select(c.alias("workspace"), F.when(c % 9 != 0, (c % 8).cast("int")).alias("current_phase"))
    entries = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace"), _pick(("mistake_archive", "confusion_log", "knowledge_window"), k).alias("field"), k.alias("position"), F.when(k % 7 == 0, " ").when(k % 7 != 1, F.col("o_orderstatus")).alias("note"))
    checks = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("workspace"), F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("text"))
    return v.counted(v.study_state(states, entries, checks, _plans(spark, sf_dir)))


def cheat_sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as bullets that lead to suppliers' notes."""
    s, k, n = F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    target = F.when(n == 1, F.lit(None).cast("string")).otherwise(F.concat(_pick(("notebook/", "references/wiki/", "mistakes/", "notebook/../"), k), s.cast("string"), F.lit(".md")))
    bullets = _t(spark, sf_dir, "lineitem").select((k % 10).alias("workspace"), (k * 10 + n).alias("line"), target.alias("target"), F.when(n % 3 != 0, F.concat(F.lit("a"), (s % 6).cast("string"))).alias("anchor"))
    every = F.explode(F.array(*[F.lit(x).cast("long") for x in range(10)])).alias("workspace")
    notes = _t(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(every, F.concat(F.lit("notebook/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), "s_suppkey")
    files = notes.unionByName(notes.withColumn("path", F.replace("path", F.lit("notebook/"), F.lit("references/wiki/")))).unionByName(notes.where("s_suppkey % 2 = 0").withColumn("path", F.replace("path", F.lit("notebook/"), F.lit("mistakes/"))))
    heads = files.where("s_suppkey % 3 <> 0").select("workspace", "path", F.concat(F.lit("a"), (F.col("s_suppkey") % 6).cast("string")).alias("anchor"))
    return v.counted(v.cheat_sheet(bullets, files.select("workspace", "path"), heads))


def page_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as page records, their lines as elements."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    q = F.col("l_quantity")
    element = F.struct(
        _pick(("text", "table", "formula", "figure", "poem"), k + n).alias("kind"), (F.row_number().over(_by_order()) - 1 + F.when(k % 19 == 0, 1).otherwise(0)).cast("long").alias("ordinal"),
        F.when(n % 2 == 0, F.array(q, q, q + 1, F.when(k % 29 == 0, q - 1).otherwise(q + 1))).alias("bbox"), F.when(n % 3 == 0, F.concat(F.lit("x"), F.col("l_partkey").cast("string"))).alias("asset"), F.when((n % 3 == 0) | (k % 31 == 0), F.lit("figure")).alias("asset_role"),
        F.when((n % 3 == 0) & (k % 37 == 0), F.lit("beef")).alias("asset_sha256"), F.when(k % 41 == 0, "guess").otherwise("ocr").alias("method"), (F.col("l_discount") * F.when(k % 43 == 0, 100).otherwise(1)).alias("confidence"),
    )
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", element.alias("e"))
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("e"), lambda a, b: (a["ordinal"] - b["ordinal"]).cast("int")).alias("elements"))
    used = F.array_distinct(F.filter(F.transform("elements", lambda x: x["asset"]), lambda a: a.isNotNull()))
    o = F.col("l_orderkey")
    rows = made.select(
        (o % 3).alias("workspace"), F.when(o % 47 == 0, "../f").otherwise(F.concat(F.lit("f"), (o % 50).cast("string"))).alias("file"), o.alias("position"), (F.floor(o / 50) + F.when(o % 53 == 0, -3).otherwise(1)).alias("page"), "elements",
        F.when(o % 59 == 0, F.concat(used, F.array(F.lit("more")))).otherwise(used).alias("embedded_assets"),
    )
    return v.counted(v.page_records(rows))


def _by_order():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


NAMES = ("auto", " Core", "docling", "Min-ERU", "magic-pdf", "word", None)


def adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of adapters, with and without a local backend."""
    found = v.adapter(_pick(NAMES, F.col("o_orderkey")), F.col("o_custkey") % 2 == 0)
    return _t(spark, sf_dir, "orders").select(found.alias("a")).groupBy("a.adapter", "a.problem").agg(F.count("*").alias("n"))


def _said(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def evaluation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as units of suppliers' pages, orders as pairs and lists, against the contract of an evaluation."""
    s, p, k = F.col("s_suppkey"), F.col("l_partkey"), F.col("l_orderkey")
    sources = _t(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 3").select((s - F.when(s % 20 == 1, 1).otherwise(0)).alias("source_id"), F.sequence(F.lit(1), (s % 5 + 3).cast("int")).alias("pages"))
    unit = F.concat_ws("-", k, p)
    units = _t(spark, sf_dir, "lineitem").select(
        unit.alias("unit_id"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("page"), _pick(("question", "answer", "text", "riddle"), p).alias("kind"), _pick(("material", "ai_recovered", "hearsay"), k).alias("provenance"),
        F.when(p % 2 == 0, "figure").alias("asset_role"), F.when(p % 100 == 7, "beef").alias("asset_sha256"), (k % 4 == 0).alias("exposed"),
    )
    two = F.concat_ws("-", k, F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")))
    pairs = _t(spark, sf_dir, "lineitem").select(unit.alias("question_id"), two.alias("answer_id"))
    lists = _t(spark, sf_dir, "lineitem").groupBy((k - F.when(k % 500 == 2, 1).otherwise(0)).alias("query_id"), k).agg(F.collect_list(F.concat(unit, F.when((k % 90 == 0) & (F.col("l_linenumber") == 1), "x").otherwise(""))).alias("unit_ids")).select("query_id", "unit_ids")
    return _said(v.evaluation_contract(sources, units, pairs, lists))


def fact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name as groups, chained by candidates, with conflicts, against each other."""
    p = F.col("p_partkey")
    g = F.floor(p / 4)
    parts = _t(spark, sf_dir, "part")
    edge = lambda a, b, cond: parts.where(cond).select((p * 10 + b).alias("candidate_id"), (g * 4 + a).alias("left_id"), (g * 4 + b).alias("right_id"), F.when(g % 7 == 0, "near").otherwise("exact").alias("match_kind"), F.when(p % 50 == 1, "other").otherwise(g.cast("string")).alias("fingerprint"), (p % 60 == 2).alias("disputed"))
    chain = edge(0, 1, p % 4 == 1).unionByName(edge(1, 2, (p % 4 == 2) & (g % 9 != 0))).unionByName(edge(2, 3, p % 4 == 3))
    every = edge(0, 2, (p % 4 == 0) & (g % 2 == 1)).unionByName(edge(0, 3, (p % 4 == 1) & (g % 2 == 1) & (g % 11 != 0))).unionByName(edge(1, 3, (p % 4 == 2) & (g % 2 == 1)))
    again = edge(1, 0, (p % 4 == 1) & (g % 40 == 0)).withColumn("candidate_id", F.col("candidate_id") + 100_000_000)
    candidates = chain.unionByName(every).unionByName(again)
    members = parts.select((g - F.when(p % 300 == 5, 1).otherwise(0)).alias("group_id"), p.alias("unit_id"), F.when(g % 2 == 0, "exact_auto").otherwise("reviewed_near").alias("derivation"), g.cast("string").alias("fingerprint"))
    members = members.unionByName(members.where("unit_id % 400 = 6").withColumn("group_id", F.lit(-1).cast("long")))
    conflicts = chain.where("candidate_id % 3 = 0").select(
        F.col("candidate_id").alias("conflict_id"), (F.col("candidate_id") + F.when(F.col("candidate_id") % 27 == 0, 5).otherwise(0)).alias("candidate_id"), (F.col("left_id") + F.when(F.col("candidate_id") % 33 == 0, 4000).otherwise(0)).alias("left_id"), "right_id",
        _pick(("unresolved", "resolved_not_conflict", "superseded"), F.col("candidate_id") / 3).alias("status"),
    )
    return _said(v.fact_graph(candidates, members, conflicts))


def teaching_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as teaching examples with all sorts of scopes and paths."""
    p = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    examples = _t(spark, sf_dir, "part").select(
        (p % 6).alias("workspace"), F.when(p % 101 == 0, " pad").when(p % 97 == 0, F.lit("same")).otherwise(p.cast("string")).alias("id"), _pick(("paired_problem", "worked_example", "worked_example", "lecture", None), p).alias("role"),
        F.when(p % 5 == 0, F.lit(None)).when(p % 7 == 0, "intro").when(p % 11 == 0, "0").otherwise(F.concat(F.lit("ch"), size)).alias("chapter"), F.when(p % 3 == 0, F.concat(F.lit("phase "), F.when(p % 9 == 0, "12").otherwise(size))).when(p % 13 == 0, "x").alias("phase"),
        F.when(p % 17 == 0, " ").otherwise(F.col("p_name")).alias("question"), F.when(p % 19 == 0, "../out.pdf").when(p % 23 != 0, "lec/a.pdf").alias("source_file"), F.when(p % 29 == 0, "").when(p % 31 == 0, "C:x").when(p % 2 == 0, "b.pdf").alias("answer_file"),
    )
    return v.counted(v.teaching_examples(examples))


def derivation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' sums that were persisted, some of them tampered with, against their derivation."""
    rebuilt = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
    k = F.col("l_orderkey")
    kept = rebuilt.where(k % 17 != 0).withColumn("n", F.col("n") + F.when(k % 19 == 0, 1).otherwise(0))
    more = kept.where(k % 23 == 0).withColumn("l_orderkey", k + 10**8)
    return v.derivation_differences(kept.unionByName(more), rebuilt, ["l_orderkey"], ["n", "s"]).groupBy("problem").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


QUERIES = {f.__name__: f for f in (evaluation_rules, fact_rules, teaching_rules, derivation_rules, structure_rules, index_rules, wiki_rules, raw_math_rules, roster_rules, progress_rules, state_rules, cheat_sheet_rules, page_record_rules, adapters)}

_PLAN_SQL = """
pl as (select c_custkey as workspace, unnest([c_custkey % 3 + 1, c_custkey % 4 + 3, 2]) as phase from customer where c_custkey % 8 <> 0), ph as (select workspace, list(distinct phase) as phases from pl group by 1)
"""
_COUNTED = "select rule, level, count(*) as n, count(distinct workspace) as workspaces, min(key) as first_key from r group by 1, 2"

ORACLE = {
    "structure_rules": f"""
with f as (select o_custkey as workspace, {_sql_pick(("references/wiki", "references/quiz_bank.json", "study_plan.md", "study_progress.md", "extra.md"), "o_orderkey")} as path, min(o_orderkey) as k from orders group by 1, 2),
g as (select *, case when (path = 'references/wiki') = (k % 7 <> 0) then 'directory' else 'file' end as kind, k % 11 = 0 or k % 13 = 0 as bad from f), n(path, wanted) as (values ('references/wiki', 'directory'), ('references/quiz_bank.json', 'file'), ('study_plan.md', 'file'), ('study_progress.md', 'file')),
j as (select c_custkey as workspace, n.path, wanted, kind, coalesce(bad, false) as bad, c_custkey % 4 = 0 and n.path <> 'study_progress.md' as optional from customer, n left join g on g.workspace = c_custkey and g.path = n.path),
r as (select workspace, path as key, 'leads_out' as rule, 'error' as level from j where bad union all select workspace, path, 'required_missing', 'error' from j where not bad and coalesce(kind <> wanted, true) and not optional) {_COUNTED}
""",
    "index_rules": f"""
with o as (select o_custkey as workspace, o_orderkey as k, case when o_orderkey % 5 = 0 then 'references/terms.json' else 'f' || (o_orderkey % 20) end as file from orders),
f as (select workspace, file, max(k) as k from o where k % 9 <> 0 group by 1, 2), b as (select workspace, file, max(k) as k from o where k % 10 <> 5 and k % 3 <> 1 group by 1, 2),
j as (select b.workspace, b.file, b.k, b.k % 23 <> 0 as formed, f.k as fk, f.k % 17 = 0 as link from b left join f using (workspace, file)),
r as (select workspace, file as key, 'digest_malformed' as rule, 'error' as level from j where not formed union all select workspace, file, 'file_missing', 'error' from j where formed and fk is null union all select workspace, file, 'file_linked', 'error' from j where formed and link
  union all select workspace, file, 'stale_index', 'error' from j where formed and not link and fk <> k
  union all select workspace, file, 'layer_not_bound', 'error' from f where file = 'references/terms.json' and workspace in (select workspace from b) and (workspace, file) not in (select (workspace, file) from b)) {_COUNTED}
""",
    "wiki_rules": rf"""
with e as (select page_id % 9 as workspace, page_id as p, {_sql_pick(("ch", "../x", "a b", "第", "ok-"), "page_id")} || page_id || case when page_id % 6 <> 0 then '.md' else '.txt' end as name from pages),
r as (select workspace, name as key, 'wiki_link' as rule, 'error' as level from e where p % 10 = 0 union all select workspace, name, 'wiki_folder', 'error' from e where p % 10 <> 0 and p % 8 = 0
  union all select workspace, name, 'wiki_name_unsafe', 'error' from e where p % 10 <> 0 and p % 8 <> 0 and not regexp_matches(name, '^[\w.\-]+\.md$') union all select workspace, name, 'wiki_nul', 'warning' from e where p % 10 <> 0 and p % 8 <> 0 and p % 12 = 1) {_COUNTED}
""",
    "raw_math_rules": "select doc_id % 7 as workspace, 'raw_math' as rule, 'notebook/' || doc_id || '.md:' || (length(text) - length(replace(text, chr(10), '')) + 2) as key from documents where doc_id % 5 in (0, 4)",
    "roster_rules": f"""
with p as (select p_partkey as id, p_partkey % 5 as workspace, p_partkey % 6 = 0 as gone, p_partkey % 14 = 1 as moved, p_partkey % 4 = 0 and p_partkey in (select l_partkey from lineitem) as quiz from part),
r as (select workspace, id::varchar as key, 'teaching_missing' as rule, 'error' as level from p where gone union all select workspace, id::varchar, 'quiz_is_no_substitute', 'error' from p where gone and quiz union all select workspace, id::varchar, 'chapter_changed', 'error' from p where not gone and moved) {_COUNTED}
""",
    "progress_rules": f"""
with {_PLAN_SQL}, j as (select c_custkey as workspace, c_custkey % 7 as now, phases from customer left join ph on ph.workspace = c_custkey),
r as (select workspace, now::varchar as key, 'points_section_missing' as rule, 'warning' as level from j where workspace % 5 = 0 union all select workspace, now::varchar, 'phase_not_planned', 'warning' from j where phases is not null and not list_contains(phases, now)) {_COUNTED}
""",
    "state_rules": f"""
with {_PLAN_SQL}, j as (select c_custkey as workspace, case when c_custkey % 9 <> 0 then c_custkey % 8 end as now, phases from customer left join ph on ph.workspace = c_custkey),
r as (select workspace, coalesce(now::varchar, '') as key, 'phase_invalid' as rule, 'error' as level from j where coalesce(now < 1, true) union all select workspace, now::varchar, 'phase_not_planned', 'error' from j where now >= 1 and phases is not null and not list_contains(phases, now)
  union all select o_custkey, case when o_orderkey % 3 = 0 then 'mistake_archive:' else 'confusion_log:' end || o_orderkey, 'note_missing', 'error' from orders where o_orderkey % 3 < 2 and o_orderkey % 7 < 2
  union all select n_regionkey, n_nationkey::varchar, 'checklist_text_missing', 'error' from nation where n_nationkey % 4 = 0) {_COUNTED}
""",
    "cheat_sheet_rules": f"""
with b as (select l_orderkey % 10 as workspace, l_orderkey * 10 + l_linenumber as line, l_suppkey as s, l_linenumber = 1 as bare, l_orderkey % 4 as f, l_linenumber % 3 <> 0 as anchored, {_sql_pick(("notebook/", "references/wiki/", "mistakes/", "notebook/../"), "l_orderkey")} || l_suppkey || '.md' as target from lineitem),
h as (select *, s % 5 <> 0 and s < (select count(*) from supplier) and (f < 2 or (f = 2 and s % 2 = 0)) as held from b),
r as (select workspace, line::varchar as key, 'no_source' as rule, 'error' as level from h where bare union all select workspace, line || ':' || target, 'climbs_out', 'error' from h where not bare and f = 3
  union all select workspace, line || ':' || target, 'target_missing', 'error' from h where not bare and f < 3 and not held union all select workspace, line || ':' || target, 'anchor_missing', 'error' from h where not bare and f in (0, 2) and held and anchored and s % 3 = 0) {_COUNTED}
""",
    "page_record_rules": f"""
with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i from lineitem),
e as (select l_orderkey as o, count(*) filter ((l_orderkey + l_linenumber) % 5 = 4) as poems, count(*) filter (l_linenumber % 2 = 0) as boxes, count(*) filter (l_linenumber % 3 = 0) as assets, count(*) filter (l_linenumber % 3 <> 0) as bare, count(*) filter (l_discount * 100 > 1) as sure from l group by 1),
p as (select *, case when o % 47 = 0 then '../f' else 'f' || (o % 50) end as file, o // 50 + case when o % 53 = 0 then -3 else 1 end as page, o % 3 as workspace from e),
q as (select *, file || ':' || o as key, count(*) over (partition by workspace, file, page) as times, lag(page) over (partition by workspace, file order by o) as before from p),
r as (select workspace, key, 'error' as level, unnest(list_filter([case when o % 47 = 0 then 'file_path' end, case when page < 1 then 'page_number' end, case when times > 1 then 'page_repeated' end, case when before > page then 'pages_descend' end, case when poems > 0 then 'element_kind' end,
  case when o % 19 = 0 then 'element_ordinal' end, case when o % 29 = 0 and boxes > 0 then 'element_bbox' end, case when o % 31 = 0 and bare > 0 then 'asset_role' end, case when o % 37 = 0 and assets > 0 then 'asset_digest' end, case when o % 41 = 0 then 'element_method' end,
  case when o % 43 = 0 and sure > 0 then 'element_confidence' end, case when o % 59 = 0 then 'embedded_assets' end], lambda x: x is not null)) as rule from q) {_COUNTED}
""",
    "adapters": f"""
with a as (select {_sql_pick(("core", "core", "docling", "mineru", "mineru", None, None), "o_orderkey")} as found, o_orderkey % 7 = 6 as nameless, o_custkey % 2 = 0 as backend from orders),
p as (select *, case when nameless then 'name_not_text' when backend and found in ('docling', 'mineru') then 'heavy_needs_remote' when backend and found is null then 'backend_only_for_core' when found is null then 'adapter_unknown' end as problem from a)
select case when problem is null then found end as adapter, problem, count(*) as n from p group by 1, 2
""",
    "evaluation_rules": """
with s as (select s_suppkey - case when s_suppkey % 20 = 1 then 1 else 0 end as source_id, s_suppkey from supplier where s_suppkey % 10 <> 3),
u as (select l_orderkey || '-' || l_partkey as id, l_suppkey as src, l_linenumber as page, l_partkey as p, l_orderkey as k, l_extendedprice as x, l_partkey % 4 as kind from lineitem),
k1 as (select distinct id, kind from u), pr as (select id as q, k || '-' || lead(p) over (partition by k order by p, page, src, x) as a0, k from u), pa as (select q, coalesce(a0, k::varchar) as a from pr),
l as (select k - case when k % 500 = 2 then 1 else 0 end as q, k, list(id || case when k % 90 = 0 and page = 1 then 'x' else '' end) as ids from u group by 1, 2), r as (
  select 'source_unknown' as rule, id as key from u where src not in (select source_id from s)
  union all select 'page_not_accounted', id from u where src in (select source_id from s) and page > (select min(s.s_suppkey % 5 + 3) from s where s.source_id = u.src)
  union all select 'kind_unknown', id from u where kind = 3 union all select 'provenance_unknown', id from u where k % 3 = 2 union all select 'asset_digest_malformed', id from u where p % 100 = 7
  union all select 'exposed_without_role', id from u where k % 4 = 0 and p % 2 = 1 and kind <> 1
  union all select 'source_repeated', source_id::varchar from s group by source_id having count(*) > 1 union all select 'unit_repeated', id from u group by id having count(*) > 1
  union all select 'pair_repeated', q || '>' || a from pa group by q, a having count(*) > 1 union all select 'pair_question', q || '>' || a from pa left join k1 on k1.id = q where coalesce(kind <> 0, true) union all select 'pair_answer', q || '>' || a from pa left join k1 on k1.id = a where coalesce(kind <> 1, true)
  union all select 'query_repeated', q::varchar from l group by q having count(*) > 1 union all select 'listed_twice', q::varchar from l where len(list_distinct(ids)) < len(ids)
  union all select distinct 'listed_unknown', q::varchar from (select q, unnest(ids) as id from l) where id not in (select id from u))
select rule, count(*) as n, min(key) as first_key from r group by 1
""",
    "fact_rules": """
with p as (select p_partkey as p, p_partkey // 4 as g from part),
e(i, a, b) as (values (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 0, 2), (5, 0, 3), (6, 1, 3), (7, 1, 0)),
c as (select p * 10 + b + case when i = 7 then 100000000 else 0 end as id, g * 4 + a as l, g * 4 + b as r, least(g * 4 + a, g * 4 + b) as x, greatest(g * 4 + a, g * 4 + b) as y, g % 7 = 0 as near, p % 50 = 1 as other, p % 60 = 2 as disputed, i, g from p, e
  where case i when 1 then p % 4 = 1 when 2 then p % 4 = 2 and g % 9 <> 0 when 3 then p % 4 = 3 when 4 then p % 4 = 0 and g % 2 = 1 when 5 then p % 4 = 1 and g % 2 = 1 and g % 11 <> 0 when 6 then p % 4 = 2 and g % 2 = 1 else p % 4 = 1 and g % 40 = 0 end),
m0 as (select g - case when p % 300 = 5 then 1 else 0 end as grp, p as u, g % 2 = 0 as auto, g as fp from p), m as (select * from m0 union all select -1, u, auto, fp from m0 where u % 400 = 6),
n as (select c.*, a.grp, a.auto, a.fp from c join m a on a.u = c.x join m b on b.u = c.y and b.grp = a.grp),
f as (select id, case when id % 27 = 0 then id + 5 else id end as cand, case when id % 33 = 0 then l + 4000 else l end as l, r, (id // 3) % 3 as st from c where i < 4 and id % 3 = 0),
ex as (select grp, x, y from n where auto and not near union select grp, y, x from n where auto and not near),
z as (with recursive w as (select grp, u as s, u as t from m where auto union select w.grp, w.s, ex.y from w join ex on ex.grp = w.grp and ex.x = w.t) select grp, s, min(t) as label from w group by 1, 2), q as (
  select 'pair_repeated' as rule, x || '-' || y as key from c group by x, y having count(*) > 1 union all select 'groups_overlap', u::varchar from m group by u having count(distinct grp) > 1
  union all select 'edge_not_exact', id::varchar from n where auto and near union all select 'fingerprint_differs', id::varchar from n where auto and not near and (other or g <> fp)
  union all select 'group_not_connected', grp::varchar from z group by grp having count(distinct label) > 1
  union all select 'group_lacks_pairs', s.grp::varchar from (select grp, count(distinct u) as k from m where not auto group by 1) s left join (select grp, count(distinct (x, y)) as d from n where not auto group by 1) t using (grp) where coalesce(d, 0) < k * (k - 1) / 2
  union all select 'dispute_not_waived', id::varchar from n where not auto and disputed and id not in (select cand from f where st = 1)
  union all select 'candidate_unknown', id::varchar from f where cand not in (select id from c) union all select 'members_differ', f.id::varchar from f join c on c.id = f.cand where c.x <> least(f.l, f.r) or c.y <> greatest(f.l, f.r)
  union all select 'conflict_inside_group', f.id::varchar from f join m a on a.u = f.l join m b on b.u = f.r and b.grp = a.grp where st = 0)
select rule, count(*) as n, min(key) as first_key from q group by 1
""",
    "derivation_rules": """
with d as (select l_orderkey as k from lineitem group by 1), r as (select 'not_persisted' as problem, k from d where k % 17 = 0 union all select 'differs', k from d where k % 17 <> 0 and k % 19 = 0 union all select 'not_derived', k + 100000000 from d where k % 17 <> 0 and k % 23 = 0)
select problem, count(*) as n, min(k) as first_key from r group by 1
""",
    "teaching_rules": f"""
with t as (select p_partkey as p, p_partkey % 6 as workspace, case when p_partkey % 101 = 0 then ' pad' when p_partkey % 97 = 0 then 'same' else p_partkey::varchar end as id, p_partkey % 5 = 0 as no_chapter,
  case when p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_size < 1 then null else p_size end as c, case when p_partkey % 3 = 0 then case when p_partkey % 9 = 0 then 12 when p_size >= 1 then p_size end end as ph, p_partkey % 3 = 0 or p_partkey % 13 = 0 as has_phase from part),
u as (select *, count(*) over (partition by workspace, id) as times from t),
r as (select workspace, id as key, 'error' as level, unnest(list_filter([case when id = ' pad' then 'id_unstable' end, case when id <> ' pad' and times > 1 then 'id_repeated' end, case when p % 5 in (3, 4) then 'role_unknown' end, case when not no_chapter and c is null then 'chapter_not_a_number' end,
  case when has_phase and ph is null then 'phase_not_a_number' end, case when no_chapter and not has_phase then 'scope_missing' end, case when c <> ph then 'scope_conflict' end, case when p % 17 = 0 then 'question_missing' end, case when p % 23 = 0 and p % 19 <> 0 then 'source_missing' end,
  case when p % 19 = 0 then 'source_unsafe' end, case when p % 29 = 0 or p % 31 = 0 then 'answer_source_unsafe' end], lambda x: x is not null)) as rule from u) {_COUNTED}
""",
}

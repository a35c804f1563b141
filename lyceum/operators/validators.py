"""Rules of a study workspace over its tables; each gives (workspace, rule, level, key) rows, so rule groups unite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import mathtext

# What a workspace must hold, and what a light one may lack.
REQUIRED = (("references/wiki", "directory"), ("references/quiz_bank.json", "file"), ("study_plan.md", "file"), ("study_progress.md", "file"))
LIGHT_LACKS = ("references/wiki", "references/quiz_bank.json", "study_plan.md")
# Layers that an index must bind once they exist; names of wiki files; hex digests.
BOUND_LAYERS = ("references/teaching_examples.json", "references/terms.json")
SAFE_WIKI, DIGEST = r"^[\w.\-]+\.md$", "^[0-9a-f]{64}$"
# Kinds of page elements, ways of extraction, roles of assets.
ELEMENT_KINDS = ("title", "heading", "text", "list", "table", "formula", "figure", "diagram", "caption", "code", "speaker_notes", "question", "answer", "other")
METHODS = ("native", "heuristic", "ocr", "vision", "manual", "ai_recovered")
ASSET_ROLES = ("question_context", "answer_context", "worked_solution", "student_attempt", "figure", "diagram", "table", "source_page", "other")
# What names a phase in a line of a plan, and which lines count.
PLAN_LINE, PLAN_PHASE = r"^\s*(?:#|\||[-*]\s|\d+\s*[.)、）])", r"阶段\s*(\d+)|第\s*(\d+)\s*阶段|[Pp]hase\s*(\d+)"
CURRENT_PHASE = r"(?s)当前[^#]*?阶段\s*(\d+)"
# Adapters by the names that they answer to, and those that take no local backend.
ADAPTERS = {"auto": "core", "core": "core", "docling": "docling", "mineru": "mineru", "magicpdf": "mineru"}


def _tell(rows: DataFrame, rule: str, key: Column, level: str = "error") -> DataFrame:
    return rows.select("workspace", F.lit(rule).alias("rule"), F.lit(level).alias("level"), key.cast("string").alias("key"))


def _each(rows: DataFrame, key: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass over rows for many conditions."""
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, cond in rules]), lambda r: r.isNotNull())
    return rows.select("workspace", F.explode(found).alias("r"), key.cast("string").alias("key")).select("workspace", "r.rule", "r.level", "key")


def structure(workspaces: DataFrame, files: DataFrame) -> DataFrame:
    """Required entries of workspaces (workspace, light) among files (workspace, path, kind, link, escapes): missing ones, and those that lead out."""
    spark = workspaces.sparkSession
    wanted = spark.createDataFrame(list(REQUIRED), "path string, wanted string")
    both = workspaces.crossJoin(F.broadcast(wanted)).join(files, ["workspace", "path"], "left")
    out = F.coalesce("link", F.lit(False)) | F.coalesce("escapes", F.lit(False))
    optional = F.col("light") & F.col("path").isin(*LIGHT_LACKS)
    return _each(both, F.col("path"), [("leads_out", "error", out), ("required_missing", "error", ~out & ~F.coalesce(F.col("kind") == F.col("wanted"), F.lit(False)) & ~optional)])


def index_integrity(bound: DataFrame, files: DataFrame) -> DataFrame:
    """Files that an index binds (workspace, file, sha256) against those that exist (workspace, path, sha256, link), and layers that it should bind."""
    live = files.select("workspace", F.col("path").alias("file"), F.col("sha256").alias("now"), "link")
    both = bound.join(live, ["workspace", "file"], "left")
    formed = F.coalesce(F.col("sha256").rlike(DIGEST), F.lit(False))
    rules = _each(both, F.col("file"), [
        ("digest_malformed", "error", ~formed), ("file_missing", "error", formed & F.col("now").isNull()), ("file_linked", "error", formed & F.col("link")), ("stale_index", "error", formed & ~F.col("link") & (F.col("now") != F.col("sha256"))),
    ])
    layers = files.where(F.col("path").isin(*BOUND_LAYERS)).select("workspace", F.col("path").alias("file"))
    indexed = bound.select("workspace").distinct()
    return rules.unionByName(_tell(layers.join(indexed, "workspace").join(bound.select("workspace", "file"), ["workspace", "file"], "left_anti"), "layer_not_bound", F.col("file")))


def wiki_entries(entries: DataFrame) -> DataFrame:
    """Entries of a wiki folder (workspace, name, kind, link, text): links, folders, unsafe names, NUL bytes."""
    plain = ~F.col("link") & (F.col("kind") == "file")
    return _each(entries, F.col("name"), [
        ("wiki_link", "error", F.col("link")), ("wiki_folder", "error", ~F.col("link") & (F.col("kind") == "directory")), ("wiki_name_unsafe", "error", plain & ~F.col("name").rlike(SAFE_WIKI)), ("wiki_nul", "warning", plain & F.contains("text", F.lit("\x00"))),
    ])


def raw_math(notes: DataFrame) -> DataFrame:
    """Notes (workspace, path, text) with a command outside of formulas, by the first line that has one."""
    lines = notes.where(F.contains("text", F.lit("\\"))).select("workspace", "path", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    found = lines.where(F.contains("said", F.lit("\\"))).where(mathtext.bare_command_of("said").isNotNull()).groupBy("workspace", "path").agg((F.min("line") + 1).alias("line"))
    return _tell(found, "raw_math", F.concat_ws(":", "path", "line"), "warning")


def roster(baseline: DataFrame, teaching: DataFrame, quiz: DataFrame) -> DataFrame:
    """A retained roster (workspace, chapter, id) against teaching items (workspace, chapter, id): a quiz item (workspace, id) is no substitute."""
    now = teaching.select("workspace", "id", F.col("chapter").alias("now"))
    asked = quiz.select("workspace", "id").distinct().withColumn("quiz", F.lit(True))
    both = baseline.join(now, ["workspace", "id"], "left").join(asked, ["workspace", "id"], "left")
    gone = F.col("now").isNull()
    return _each(both, F.col("id"), [("teaching_missing", "error", gone), ("quiz_is_no_substitute", "error", gone & F.col("quiz")), ("chapter_changed", "error", F.col("now") != F.col("chapter"))])


def plan_phases(plans: DataFrame) -> DataFrame:
    """(workspace, phase): the phases that headings, rows and items of a plan (workspace, text) name."""
    lines = plans.select("workspace", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(PLAN_LINE))
    said = lines.select("workspace", F.explode(F.regexp_extract_all("line", F.lit(PLAN_PHASE), F.lit(0))).alias("said"))
    return said.select("workspace", F.regexp_extract("said", r"\d+", 0).cast("int").alias("phase")).where("phase >= 1").distinct()


def progress_view(progress: DataFrame, plans: DataFrame) -> DataFrame:
    """Progress notes (workspace, text): a section for open points, and a current phase that the plan has."""
    known = plan_phases(plans).groupBy("workspace").agg(F.collect_set("phase").alias("phases"))
    now = F.regexp_extract("text", CURRENT_PHASE, 1).try_cast("int")
    rows = progress.withColumn("now", now).join(known, "workspace", "left")
    section = F.contains("text", F.lit("疑难点")) | F.contains(F.lower("text"), F.lit("confusion"))
    return _each(rows, F.coalesce(F.col("now").cast("string"), F.lit("")), [("points_section_missing", "warning", ~section), ("phase_not_planned", "warning", ~F.array_contains("phases", F.col("now")))])


def cheat_sheet(bullets: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """Bullets (workspace, line, target, anchor; a row for each link, target null without one) must lead to files (workspace, path) and, in notebooks, to headings (workspace, path, anchor)."""
    held = files.select("workspace", F.col("path").alias("target")).distinct().withColumn("held", F.lit(True))
    heads = anchors.select("workspace", F.col("path").alias("target"), "anchor").distinct().withColumn("head", F.lit(True))
    rows = bullets.join(held, ["workspace", "target"], "left").join(heads, ["workspace", "target", "anchor"], "left")
    linked, climbs = F.col("target").isNotNull(), F.col("target").rlike(r"(^|/)\.\.(/|$)")
    own = F.col("target").rlike("^(notebook|mistakes)/")
    return _each(rows, F.concat_ws(":", F.col("line"), F.col("target")), [
        ("no_source", "error", ~linked), ("climbs_out", "error", climbs), ("target_missing", "error", linked & ~climbs & F.col("held").isNull()),
        ("anchor_missing", "error", F.col("held") & ~climbs & own & (F.coalesce("anchor", F.lit("")) != "") & F.col("head").isNull()),
    ])


def study_state(states: DataFrame, rows: DataFrame, checklist: DataFrame, plans: DataFrame) -> DataFrame:
    """States (workspace, current_phase), their entries (workspace, field, position, note) and checklists (workspace, position, text) against the plan."""
    known = plan_phases(plans).groupBy("workspace").agg(F.collect_set("phase").alias("phases"))
    now = F.col("current_phase")
    valid = F.coalesce(now >= 1, F.lit(False))
    phase = _each(states.join(known, "workspace", "left"), F.coalesce(now.cast("string"), F.lit("")), [("phase_invalid", "error", ~valid), ("phase_not_planned", "error", valid & ~F.array_contains("phases", now))])
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    notes = rows.where(F.col("field").isin("mistake_archive", "confusion_log") & blank("note"))
    return phase.unionByName(_tell(notes, "note_missing", F.concat_ws(":", "field", "position"))).unionByName(_tell(checklist.where(blank("text")), "checklist_text_missing", F.col("position")))


def page_records(pages: DataFrame) -> DataFrame:
    """Page records (workspace, file, position, page, elements array<struct<kind, ordinal, bbox array<double>, asset, asset_role, asset_sha256, method, confidence>>, embedded_assets array<string>) that break their contract."""
    e = "elements"
    some = lambda test: F.exists(e, lambda x: F.coalesce(test(x), F.lit(False)))
    box = lambda x: x["bbox"]
    bad_box = lambda x: box(x).isNotNull() & ((F.size(box(x)) != 4) | F.exists(box(x), lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))) | (F.get(box(x), F.lit(2)) < F.get(box(x), F.lit(0))) | (F.get(box(x), F.lit(3)) < F.get(box(x), F.lit(1))))
    used = F.array_distinct(F.filter(F.transform(e, lambda x: x["asset"]), lambda a: a.isNotNull()))
    given = F.col("embedded_assets")
    own = Window.partitionBy("workspace", "file")
    rows = pages.withColumn("times", F.count("*").over(own.partitionBy("workspace", "file", "page"))).withColumn("before", F.lag("page").over(own.orderBy("position")))
    unsafe = F.col("file").isNull() | (F.col("file") == "") | F.col("file").rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)")
    return _each(rows, F.concat_ws(":", "file", "position"), [
        ("file_path", "error", unsafe), ("page_number", "error", ~F.coalesce(F.col("page") >= 1, F.lit(False))), ("page_repeated", "error", F.col("times") > 1), ("pages_descend", "error", F.col("before") > F.col("page")),
        ("element_kind", "error", some(lambda x: ~F.coalesce(x["kind"].isin(*ELEMENT_KINDS), F.lit(False)))), ("element_ordinal", "error", ~F.coalesce(F.transform(e, lambda x: x["ordinal"]) == F.transform(e, lambda x, i: i.cast("long")), F.lit(False))),
        ("element_bbox", "error", some(bad_box)), ("asset_role", "error", some(lambda x: x["asset_role"].isNotNull() & (~x["asset_role"].isin(*ASSET_ROLES) | x["asset"].isNull()))),
        ("asset_digest", "error", some(lambda x: x["asset_sha256"].isNotNull() & (~x["asset_sha256"].rlike(DIGEST) | x["asset"].isNull()))), ("element_method", "error", some(lambda x: x["method"].isNotNull() & ~x["method"].isin(*METHODS))),
        ("element_confidence", "error", some(lambda x: x["confidence"].isNotNull() & ~x["confidence"].between(0, 1))),
        ("embedded_assets", "error", (F.size(given) != F.size(F.array_distinct(given))) | (F.size(F.array_except(given, used)) > 0) | (F.size(F.array_except(used, given)) > 0)),
    ])


def adapter(name: Column, has_backend: Column) -> Column:
    """(adapter, problem): which adapter a name means; heavy ones take no local backend."""
    said = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit(""))
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in ADAPTERS.items() for x in kv]), said)
    problem = F.when(name.isNull(), "name_not_text").when(has_backend & found.isin("docling", "mineru"), "heavy_needs_remote").when(has_backend & found.isNull(), "backend_only_for_core").when(found.isNull(), "adapter_unknown")
    return F.struct(F.when(problem.isNull(), found).alias("adapter"), problem.alias("problem"))


def counted(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule", "level").agg(F.count("*").alias("n"), F.count_distinct("workspace").alias("workspaces"), F.min("key").alias("first_key"))


# Kinds that an extraction is scored on, where units may come from, and kinds of the answer side.
EVALUATED_KINDS = ("title", "heading", "text", "list", "table", "formula", "figure", "diagram", "caption", "code", "speaker_notes", "question", "answer", "other")
PROVENANCE = ("material", "ai_recovered", "ai_supplemented")
CLOSED_CONFLICTS = ("resolved_not_conflict", "superseded")


def _rule(rows: DataFrame, rule: str, key: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluation_contract(sources: DataFrame, units: DataFrame, pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(rule, key) of gold or predicted units that break their contract.

    `sources` is (source_id, pages array), `units` (unit_id, source_id, page, kind, provenance,
    asset_role, asset_sha256, exposed), `pairs` (question_id, answer_id), `lists` (query_id, unit_ids array).
    """
    held = sources.select("source_id", "pages").dropDuplicates(["source_id"]).withColumn("known", F.lit(True))
    rows = units.join(held, "source_id", "left")
    known = F.coalesce("known", F.lit(False))
    conditions = [
        ("source_unknown", ~known), ("page_not_accounted", known & ~F.coalesce(F.array_contains("pages", F.col("page")), F.lit(False))), ("kind_unknown", ~F.coalesce(F.col("kind").isin(*EVALUATED_KINDS), F.lit(False))),
        ("provenance_unknown", ~F.coalesce(F.col("provenance").isin(*PROVENANCE), F.lit(False))), ("asset_digest_malformed", ~F.col("asset_sha256").rlike(DIGEST)),
        ("exposed_without_role", F.col("exposed") & F.col("asset_role").isNull() & ~F.col("kind").isin("answer", "speaker_notes")),
    ]
    each = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in conditions]), lambda r: r.isNotNull()))
    own = rows.select(each.alias("rule"), F.col("unit_id").cast("string").alias("key"))
    kinds = units.select("unit_id", "kind").dropDuplicates(["unit_id"])
    pair_key = F.concat_ws(">", "question_id", "answer_id")
    ends = pairs.join(kinds.select(F.col("unit_id").alias("question_id"), F.col("kind").alias("qk")), "question_id", "left").join(kinds.select(F.col("unit_id").alias("answer_id"), F.col("kind").alias("ak")), "answer_id", "left")
    listed = lists.select("query_id", F.explode("unit_ids").alias("unit_id"))
    return _union([
        own, _rule(sources.groupBy("source_id").count().where("count > 1"), "source_repeated", F.col("source_id")), _rule(units.groupBy("unit_id").count().where("count > 1"), "unit_repeated", F.col("unit_id")),
        _rule(pairs.groupBy("question_id", "answer_id").count().where("count > 1"), "pair_repeated", pair_key), _rule(ends.where(~F.coalesce(F.col("qk") == "question", F.lit(False))), "pair_question", pair_key),
        _rule(ends.where(~F.coalesce(F.col("ak") == "answer", F.lit(False))), "pair_answer", pair_key), _rule(lists.groupBy("query_id").count().where("count > 1"), "query_repeated", F.col("query_id")),
        _rule(lists.where(F.size(F.array_distinct("unit_ids")) < F.size("unit_ids")), "listed_twice", F.col("query_id")), _rule(listed.join(kinds, "unit_id", "left_anti").select("query_id").distinct(), "listed_unknown", F.col("query_id")),
    ])


def _split_groups(members: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(group_id): groups whose members (group_id, unit_id) their edges (group_id, a, b) do not connect; the least unit spreads along the edges."""
    from lyceum.session import stored

    both = stored(edges.select("group_id", "a", "b").unionByName(edges.select("group_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, total = stored(members.select("group_id", "unit_id", F.col("unit_id").alias("label"))), None
    for _ in range(rounds):
        near = both.join(labels.select("group_id", F.col("unit_id").alias("a"), "label"), ["group_id", "a"]).groupBy("group_id", F.col("b").alias("unit_id")).agg(F.min("label").alias("near"))
        labels = stored(labels.join(near, ["group_id", "unit_id"], "left").select("group_id", "unit_id", F.least("label", F.coalesce("near", "label")).alias("label")))
        now = labels.agg(F.sum(F.xxhash64("group_id", "unit_id", "label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return labels.groupBy("group_id").agg(F.count_distinct("label").alias("n")).where("n > 1").select("group_id")


def fact_graph(candidates: DataFrame, members: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(rule, key) of facts that contradict each other.

    `candidates` is (candidate_id, left_id, right_id, match_kind, fingerprint, disputed), `members`
    (group_id, unit_id, derivation, fingerprint), `conflicts` (conflict_id, candidate_id, left_id,
    right_id, status). Equality is transitive, so an exact group needs edges that connect it; a
    reviewed one needs an edge for every pair of its members, which is counted, not listed.
    """
    pair = candidates.select("candidate_id", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "match_kind", "fingerprint", "disputed")
    side = lambda c: members.select(F.col("unit_id").alias(c), F.col("group_id").alias(f"g_{c}"), *([F.col("derivation"), F.col("fingerprint").alias("group_fingerprint")] if c == "a" else []))
    inside = pair.join(side("a"), "a").join(side("b"), "b").where("g_a = g_b").withColumn("group_id", F.col("g_a"))
    exact, reviewed = inside.where("derivation = 'exact_auto'"), inside.where("derivation <> 'exact_auto'")
    sizes = members.where("derivation <> 'exact_auto'").groupBy("group_id").agg(F.count_distinct("unit_id").alias("n"))
    edges = reviewed.where("match_kind in ('exact', 'near')").groupBy("group_id").agg(F.count_distinct("a", "b").alias("edges"))
    lacking = sizes.join(edges, "group_id", "left").where(F.coalesce("edges", F.lit(0)) < F.col("n") * (F.col("n") - 1) / 2)
    known = conflicts.join(pair.select("candidate_id", "a", "b"), "candidate_id", "left")
    fits = (F.col("a") == F.least("left_id", "right_id")) & (F.col("b") == F.greatest("left_id", "right_id"))
    open_ = conflicts.where(~F.col("status").isin(*CLOSED_CONFLICTS))
    held = lambda c: members.select(F.col("unit_id").alias(c), F.col("group_id").alias(f"of_{c}"))
    closed_in = open_.join(held("left_id"), "left_id").join(held("right_id"), "right_id").where("of_left_id = of_right_id")
    waived = conflicts.where("status = 'resolved_not_conflict'").select("candidate_id").distinct()
    return _union([
        _rule(pair.groupBy("a", "b").count().where("count > 1"), "pair_repeated", F.concat_ws("-", "a", "b")), _rule(members.groupBy("unit_id").agg(F.count_distinct("group_id").alias("n")).where("n > 1"), "groups_overlap", F.col("unit_id")),
        _rule(exact.where("match_kind <> 'exact'"), "edge_not_exact", F.col("candidate_id")), _rule(exact.where("match_kind = 'exact' and fingerprint <> group_fingerprint"), "fingerprint_differs", F.col("candidate_id")),
        _rule(_split_groups(members.where("derivation = 'exact_auto'"), exact.where("match_kind = 'exact'")), "group_not_connected", F.col("group_id")), _rule(lacking, "group_lacks_pairs", F.col("group_id")),
        _rule(reviewed.where("disputed").join(waived, "candidate_id", "left_anti"), "dispute_not_waived", F.col("candidate_id")), _rule(known.where("a is null"), "candidate_unknown", F.col("conflict_id")),
        _rule(known.where(F.col("a").isNotNull() & ~fits), "members_differ", F.col("conflict_id")), _rule(closed_in, "conflict_inside_group", F.col("conflict_id")),
    ])


def derivation_differences(persisted: DataFrame, rebuilt: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, problem): rows that were persisted but are not derived, that are derived but were not persisted, or that differ."""
    side = lambda rows, p: rows.select(*key, F.struct(*values).alias(p))
    both = side(persisted, "p").join(side(rebuilt, "r"), key, "full_outer")
    problem = F.when(F.col("p").isNull(), "not_persisted").when(F.col("r").isNull(), "not_derived").when(~F.col("p").eqNullSafe(F.col("r")), "differs")
    return both.select(*key, problem.alias("problem")).where("problem is not null")


# Roles of teaching examples.
TEACHING_ROLES = ("paired_problem", "worked_example")


def teaching_examples(examples: DataFrame) -> DataFrame:
    """Teaching examples (workspace, id, role, chapter, phase, question, source_file, answer_file) that can't be reached chapter by chapter.

    An example needs a stable id of its own, a known role, a chapter or phase that is a number (and
    the same one where both are given), a question, and paths that stay inside.
    """
    from lyceum.functions.text import chapter_key
    from lyceum.operators.constraints import stable_id_problem, unsafe_path

    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    number = lambda c: F.when(given(c), chapter_key(F.col(c), allow_phase=True).try_cast("int"))
    positive = lambda c: F.when(number(c) >= 1, number(c))
    rows = examples.withColumn("times", F.count("*").over(Window.partitionBy("workspace", "id"))).withColumn("_c", positive("chapter")).withColumn("_p", positive("phase"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    sound = stable_id_problem(F.col("id")).isNull()
    scoped = given("chapter") | given("phase")
    return _each(rows, F.coalesce("id", F.lit("")), [
        ("id_unstable", "error", ~sound), ("id_repeated", "error", sound & (F.col("times") > 1)), ("role_unknown", "error", ~F.coalesce(F.col("role").isin(*TEACHING_ROLES), F.lit(False))),
        ("chapter_not_a_number", "error", given("chapter") & F.col("_c").isNull()), ("phase_not_a_number", "error", given("phase") & F.col("_p").isNull()), ("scope_missing", "error", ~scoped),
        ("scope_conflict", "error", F.col("_c") != F.col("_p")), ("question_missing", "error", blank("question")), ("source_missing", "error", blank("source_file")),
        ("source_unsafe", "error", ~blank("source_file") & unsafe_path(F.col("source_file"))), ("answer_source_unsafe", "error", F.col("answer_file").isNotNull() & (blank("answer_file") | unsafe_path(F.col("answer_file")))),
    ])

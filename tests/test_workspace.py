import random

import pytest
from lyceum.functions import vocabulary as words
from lyceum.operators import chunking, duplicates, fusion, matrix, sessions, stats, validators, workspace
from pyspark.sql import functions as F


def test_pending_items_need_their_own_revision(spark):
    roster = spark.createDataFrame([("1", "a", 0, "r1"), ("1", "b", 1, "r1"), ("1", "c", 2, None)], "chapter string, id string, position int, revision string")
    recorded = spark.createDataFrame([("1", "a", "r1"), ("1", "a", "r0"), ("1", "b", "r0"), ("1", "x", "r9")], "chapter string, id string, revision string")
    r = workspace.pending_items(roster, recorded).first()
    assert (r.total, r.completed, r.pending, r.stale, r.unexpected, r.next_id) == (3, 1, 2, 1, 1, "b")
    assert workspace.pending_items(roster.limit(0), recorded.limit(0)).count() == 0


def test_prompt_assets_must_all_be_shown(spark):
    asked = spark.createDataFrame([("q", True, False, None), ("p", False, False, None), ("s", False, False, "stub")], "id string, requires_assets boolean, maybe_requires_assets boolean, text_status string")
    assets = spark.createDataFrame(
        [("q", 2, "b", "figure", True), ("q", 1, "a", "question_context", True), ("q", 3, "c", "worked_solution", True), ("q", 4, "t", "figure", True), ("q", 5, "d", "student_attempt", True), ("s", 1, "x", "figure", False)],
        "id string, ordinal int, path string, role string, usable boolean",
    )
    got = {r.id: r for r in workspace.question_assets(asked, assets, spark.createDataFrame([("t",)], "path string")).collect()}
    assert (got["q"].why, got["q"].prompt, got["q"].answer, got["q"].complete) == ("requires", ["a", "b"], ["c"], True)
    assert got["p"].complete and got["p"].prompt == [] and (got["s"].why, got["s"].complete) == ("stub", False)


def test_page_that_serves_a_prompt_anywhere_is_not_deferred(spark):
    items = spark.createDataFrame([("f", [1, 2], None, [2, 3]), ("f", None, "g", [1]), ("g", [1], None, None)], "source_file string, source_pages array<int>, answer_file string, answer_pages array<int>")
    assert {(r.file, r.page): r.side for r in workspace.page_sides(items).collect()} == {("f", 1): "prompt", ("f", 2): "prompt", ("f", 3): "answer", ("g", 1): "prompt"}


def test_commands_by_id_and_place(spark):
    rows = spark.createDataFrame([(1, "a", "to_review"), (2, "a", "to_review"), (3, None, "to_review")], "position long, id string, status string")
    commands = spark.createDataFrame([(1, "a", None, "已复盘"), (2, None, 2, "corrected"), (3, None, 3, " odd "), (4, "zz", None, "x"), (5, None, 9, "x"), (6, None, None, "x")], "seq int, id string, index long, status string")
    got = {r.position: r.status for r in workspace.set_statuses(rows, commands, words.ROW_STATUSES).collect()}
    assert got == {1: "reviewed", 2: "corrected", 3: "odd"}
    assert {r.seq: r.problem for r in workspace.command_problems(rows, commands).collect()} == {4: "no_such_id", 5: "index_out_of_range", 6: "no_locator"}


def test_window_commands_refuse_what_is_not_clear(spark):
    window = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", None)], "point string, chapter string")
    commands = spark.createDataFrame([(1, "p", None, "verified"), (2, "p", "2", "在窗口"), (3, "z", None, "verified"), (4, "q", None, "nonsense"), (5, "q", None, "out_window")], "seq int, point string, chapter string, status string")
    assert {r.seq: r.problem for r in workspace.window_transitions(window, commands, words.WINDOW_STATUSES).collect()} == {1: "chapter_needed", 2: None, 3: "point_unknown", 4: "status_unknown", 5: None}


def test_full_histories_refuse(spark):
    e = spark.createDataFrame([("b", k, "t", None, "x") for k in range(5)], "batch string, seq int, type string, previous string, current string")
    r = workspace.dependency_events(e, most=3).first()
    assert (r.kept, r.refused, r.overflow) == (3, 2, True)


def test_calibration_sample_fills_up_short_strata(spark):
    pool = spark.createDataFrame([(str(k), k % 10 != 0, k % 2 == 0) for k in range(100)], "item_id string, answerable boolean, right boolean")
    rows = workspace.calibration_sample(pool, 60, "s", ["item_id"]).collect()
    assert len(rows) == len({r.item_id for r in rows}) == 60
    assert sum(not r.answerable for r in rows) == 10  # both strata of ten are short, as all of theirs are right
    assert len(workspace.calibration_sample(pool, 60, "s", ["item_id"], two_strata=True).collect()) == 60
    assert workspace.calibration_sample(pool.limit(0), 6, "s", ["item_id"]).count() == 0


@pytest.mark.parametrize(("said", "code", "known"), [(" 零基础从头讲 ", "from_scratch", True), ("FILL GAPS", "fill_gaps", True), ("odd", "odd", False), (None, "", False)])
def test_canonical_words(spark, said, code, known):
    r = spark.createDataFrame([(said,)], "w string").select(words.canonical(F.col("w"), words.MODES).alias("c")).first().c
    assert (r.code, r.known) == (code, known)


def test_notebook_entries_heed_fences():
    text = "intro\n## [#a] One\n```\n## [#x] no\n~~~\n```\n##  [#b]\nbody"
    assert chunking.notebook_entries(text) == [("a", "One", 1, 5), ("b", "b", 6, 2)]
    assert chunking.notebook_entries(None) == []
    with pytest.raises(ValueError):
        chunking.notebook_entries("```\nopen")


def test_identities_tell_pairings_apart(spark):
    base = {"chapter_id": "ch01", "provenance": "material", "asset_path": None, "asset_role": None, "asset_sha256": None}
    rows = [("q1", "question", "same", "a1"), ("q2", "question", "same", "a2"), ("q3", "question", "same", "a3"), ("q4", "question", "same", None), ("q5", "question", "same", "gone"), ("a1", "answer", "x", None), ("a2", "answer", " x ", None), ("a3", "answer", "y", None)]
    units = spark.createDataFrame([(i, k, t, *base.values(), p) for i, k, t, p in rows], "unit_id string, kind string, text string, chapter_id string, provenance string, asset_path string, asset_role string, asset_sha256 string, paired_unit_id string")
    got = {r.unit_id: (r.block, r.fingerprint) for r in duplicates.identities(units).collect()}
    assert got["q1"] == got["q2"] and got["a1"] == got["a2"]
    assert len({got[q] for q in ("q1", "q3", "q4", "q5")}) == 4


def test_blocks_of_vectors_match_one_block(spark, monkeypatch):
    rows = [(k, [float((k * 7 + j * 3) % 11 - 5) for j in range(4)]) for k in range(60)] + [(90, None), (91, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = frame.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, fusion.dense_top_k(frame, asked, 3).collect()))
    monkeypatch.setattr(fusion, "ROW_BLOCK", 7)
    monkeypatch.setattr(fusion, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, fusion.dense_top_k(frame, asked, 3).collect())) == whole and len(whole) == 36


def test_traced_recall_counts_untraced_runs_apart(spark):
    items = spark.createDataFrame([("i", "ch2.md", True), ("j", "x.md", True), ("k", "ch3.md", False)], "item_id string, source_file string, answerable boolean")
    runs = spark.createDataFrame([("i", "m", "a", ["ch2.md"]), ("i", "m", "a", ["ch3.md"]), ("i", "m", "a", []), ("i", "m", "a", None), ("j", "m", "a", ["x.md"]), ("k", "m", "a", ["ch3.md"])], "item_id string, model string, arm string, files array<string>")
    r = matrix.traced_recall(runs, items).first()
    assert (r.n_traced, r.n_hit, r.n_untraced, r.recall) == (2, 1, 2, 0.5)


def plain_interval(left, right, resamples, seed):
    rng, n, found = random.Random(seed), len(left), []
    for _ in range(resamples):
        at = [rng.randrange(n) for _ in range(n)]
        found.append(sum(right[i] for i in at) / n - sum(left[i] for i in at) / n)
    found.sort()
    return found[int(0.025 * resamples)], found[int(0.975 * resamples) - 1]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 333])
def test_bootstrap_draws_as_the_plain_generator_does(n):
    rng = random.Random(n)
    left, right = [rng.random() for _ in range(n)], [float(rng.random() < 0.7) for _ in range(n)]
    _, lo, hi = stats.bootstrap_interval(left, right, 400, 12_345)
    assert (lo, hi) == pytest.approx(plain_interval(left, right, 400, 12_345), abs=1e-9)
    assert stats.bootstrap_interval(left, right, 300, 5)[1:] == pytest.approx(stats.bootstrap_interval(left, right, 300, 5, statistic=lambda xs: sum(xs) / len(xs))[1:], abs=1e-9)


def test_snapshots_follow_the_state_once_it_was_seen(spark):
    rows = [("s", 0, None, 1, False, True), ("s", 1, 2, 2, True, True), ("s", 2, None, 3, False, True), ("s", 3, 3, 2, True, True), ("s", 4, None, 4, True, True), ("v", 0, None, 1, False, True)]
    got = sessions.snapshots(spark.createDataFrame(rows, "session string, turn int, state_phase int, view_phase int, state_written boolean, view_written boolean"), ["session"], ["turn"]).collect()
    by = {(r.session, r.turn): (r.source, r.phase, r.view_edit, r.malformed) for r in got}
    assert by["s", 0] == by["v", 0] == ("view", 1, False, False)
    assert [by["s", k] for k in range(1, 5)] == [("state", 2, False, False), (None, None, True, False), ("state", 3, True, False), (None, None, False, True)]


def rules(df):
    return sorted((r.rule, r.key) for r in df.collect())


def test_structure_and_index_rules(spark):
    w = spark.createDataFrame([(1, False), (2, True)], "workspace int, light boolean")
    files = spark.createDataFrame([(1, "study_plan.md", "file", True, False), (1, "references/wiki", "file", False, False), (1, "study_progress.md", "file", False, False)], "workspace int, path string, kind string, link boolean, escapes boolean")
    assert rules(validators.structure(w, files)) == [("leads_out", "study_plan.md"), ("required_missing", "references/quiz_bank.json"), ("required_missing", "references/wiki"), ("required_missing", "study_progress.md")]
    bound = spark.createDataFrame([(1, "a", "0" * 64), (1, "b", "1" * 64), (1, "c", "x"), (1, "d", "2" * 64)], "workspace int, file string, sha256 string")
    live = spark.createDataFrame([(1, "a", "0" * 64, False), (1, "b", "9" * 64, False), (1, "references/terms.json", "3" * 64, False)], "workspace int, path string, sha256 string, link boolean")
    assert rules(validators.index_integrity(bound, live)) == [("digest_malformed", "c"), ("file_missing", "d"), ("layer_not_bound", "references/terms.json"), ("stale_index", "b")]


def test_plan_phases_come_from_structure_only(spark):
    plans = spark.createDataFrame([(1, "阶段 9 in prose\n# 阶段 01\n| 第 3 阶段 |\n2) Phase 2\n- phase 0")], "workspace int, text string")
    assert sorted(r.phase for r in validators.plan_phases(plans).collect()) == [1, 2, 3]
    notes = spark.createDataFrame([(1, "疑难点\n当前 阶段 5"), (2, "当前 阶段 5")], "workspace int, text string")
    assert rules(validators.progress_view(notes, plans)) == [("phase_not_planned", "5"), ("points_section_missing", "5")]


def test_cheat_sheet_links(spark):
    bullets = spark.createDataFrame([(1, 1, "notebook/a.md", "h"), (1, 2, "notebook/a.md", "no"), (1, 3, None, None), (1, 4, "notebook/../x.md", None), (1, 5, "references/wiki/w.md", "any"), (1, 6, "notebook/b.md", None)], "workspace int, line int, target string, anchor string")
    files = spark.createDataFrame([(1, "notebook/a.md"), (1, "references/wiki/w.md")], "workspace int, path string")
    heads = spark.createDataFrame([(1, "notebook/a.md", "h")], "workspace int, path string, anchor string")
    assert [r[0] for r in rules(validators.cheat_sheet(bullets, files, heads))] == ["anchor_missing", "climbs_out", "no_source", "target_missing"]


@pytest.mark.parametrize(("name", "backend", "want"), [("Magic-PDF", False, ("mineru", None)), ("docling", True, (None, "heavy_needs_remote")), ("word", True, (None, "backend_only_for_core")), ("word", False, (None, "adapter_unknown")), ("AUTO ", True, ("core", None)), (None, False, (None, "name_not_text"))])
def test_adapters(spark, name, backend, want):
    r = spark.createDataFrame([(name, backend)], "n string, b boolean").select(validators.adapter(F.col("n"), F.col("b")).alias("a")).first().a
    assert (r.adapter, r.problem) == want


def test_teaching_examples_need_one_scope(spark):
    rows = [(1, "a", "worked_example", "ch3", "phase 3", "q", "f.pdf", None), (1, "b", "worked_example", "3", "4", "q", "f.pdf", None), (1, "c", "x", None, "", " ", "/abs", " "), (1, "d", "paired_problem", "intro", None, "q", None, "ok.pdf"), (1, None, "paired_problem", "1", None, "q", "f", None)]
    df = spark.createDataFrame(rows, "workspace int, id string, role string, chapter string, phase string, question string, source_file string, answer_file string")
    assert rules(validators.teaching_examples(df)) == [
        ("answer_source_unsafe", "c"), ("chapter_not_a_number", "d"), ("id_unstable", ""), ("question_missing", "c"), ("role_unknown", "c"), ("scope_conflict", "b"), ("scope_missing", "c"), ("source_missing", "d"), ("source_unsafe", "c"),
    ]

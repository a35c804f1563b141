import hashlib

import pytest
from lyceum.functions import mathtext, vocabulary
from lyceum.operators import claims, extraction, gate, ledger, pages, questions
from pyspark.sql import functions as F


def test_math_spans_and_hazards():
    assert mathtext.spans("a $x^2$ b $$y\nz$$ \\$5 $open") == [(2, 7), (10, 17)]
    assert mathtext.spans("no $line\nbreak$") == []
    assert mathtext.raw_notation("x^2") == "raw_superscript" and mathtext.raw_notation("p_0 = 1") == "raw_subscript"
    assert mathtext.raw_notation("$x^2$ and `y_1` and C:\\a_1\\b") is None
    assert mathtext.bare_command(r"use \alpha") == r"\alpha" and mathtext.bare_command(r"$\alpha$ \alphabet") is None


def test_layout_hazards(spark):
    df = spark.createDataFrame([("= 4\n9, x",), ("=\nn of m\nX\ni",), ("= 4 9",)], "t string")
    assert [r[0] for r in df.select(mathtext.layout_hazard(F.col("t"))).collect()] == ["stacked_fraction_flattened", "vertical_operator_flattened", None]


def test_vocabulary(spark):
    df = spark.createDataFrame([("bad LaTeX here", "x/ch02/lecture05.md"), ("?", "notes.md")], "m string, p string")
    assert [tuple(r) for r in df.select(vocabulary.message_code(F.col("m")), vocabulary.chapter_of(F.col("p"))).collect()] == [("formula_or_math", 5), ("other", None)]
    log = '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Read","input":{"file_path":"a"}},{"type":"text"}]}}\nbroken\n{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Grep","input":{"pattern":"ch9","path":"d"}},{"type":"tool_use","name":"Read","input":{"file_path":"a"}}]}}'
    assert spark.createDataFrame([(log,)], "t string").select(vocabulary.opened_files(F.col("t"))).first()[0] == ["a", "d"]


@pytest.mark.parametrize(
    ("text", "images", "drawings", "want"),
    [("a paragraph, comfortable", 0, 0, (False, [])), ("the graph", 0, 0, (True, ["graph"])), ("plain", 1, 0, (True, [])), ("plain", 0, 4, (True, [])), ("a      b\nc      d\ne      f", 0, 0, (True, ["table"])), ("如图所示", 0, 0, (True, ["figure"])), ("Fig. 3", None, None, (True, ["figure"]))],
)
def test_visual_pages(spark, text, images, drawings, want):
    has, kinds = pages.classify_page(F.col("t"), F.lit(images).cast("int"), F.lit(drawings).cast("int"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(has, kinds).first()) == want


@pytest.mark.parametrize(("text", "as_text", "as_page"), [("shade the region shown below", True, True), ("draw the graph", False, True), ("see the table of contents", False, False), ("define a set", False, False)])
def test_asset_cues(spark, text, as_text, as_page):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(pages.needs_assets(F.col("t"), F.lit(False)), pages.needs_assets(F.col("t"), F.lit(True))).first()) == (as_text, as_page)


def test_problems_and_solutions(spark):
    rows = [("a", 1, "Example 1.1 Problem\nq\nExample 1.2 ..... 9"), ("a", 2, "Example 1.1 Solution\nQuiz 2.1"), ("b", 1, "Quiz 2.1 Solution"), ("c", 1, "Quiz 3.1\n"), ("d", 1, "Quiz 3.1\nQuiz 3.1 Solution\nExample 9.9 Answer")]
    found = pages.markers(spark.createDataFrame(rows, "file string, page int, text string"))
    got = {(r.kind, r.chapter, r.num, r.file): (r.answer_file, r.answer_page, r.ambiguous) for r in pages.paired(found).collect()}
    assert got == {("example", 1, 1, "a"): ("a", 2, False), ("quiz", 2, 1, "a"): ("b", 1, False), ("quiz", 3, 1, "c"): (None, None, True), ("quiz", 3, 1, "d"): ("d", 1, True)}
    assert [tuple(r) for r in pages.orphan_solutions(found).collect()] == [("example", 9, 9)]


def test_columns(spark):
    boxes = [("f", 1, x, x + 40.0, y, y + 10.0) for x in (0.0, 60.0) for y in (0.0, 12.0)] + [("f", 2, 0.0, 100.0, float(y), y + 10.0) for y in range(0, 60, 12)]
    got = {r.page: r.multi_column for r in pages.columns_hint(spark.createDataFrame(boxes, "file string, page int, x0 double, x1 double, y0 double, y1 double")).collect()}
    assert got == {1: True, 2: False}


def test_claims(spark):
    units = spark.createDataFrame([("u", "s", "text", None, "p", "one two one"), ("f", "s", "formula", "student_attempt", "p", "x=1")], "unit_id string, source_id string, kind string, asset_role string, asset_path string, text string")
    said = spark.createDataFrame([(1, "u", "two", None), (2, "u", "one", None), (3, "u", "one", 8), (4, "u", "one", 1), (5, "u", "zip", None), (6, "gone", "x", None)], "claim_id int, unit_id string, quote string, start int")
    assert {r.claim_id: (r.start, r.end, r.problem) for r in claims.located(said, units).collect()} == {
        1: (4, 7, None), 2: (None, None, "quote_ambiguous"), 3: (8, 11, None), 4: (None, None, "quote_not_at_start"), 5: (None, None, "quote_absent"), 6: (None, None, "payload_missing"),
    }
    sha = hashlib.sha256(b"one two one").hexdigest()
    rows = [(1, "u", "s", "v", sha, "concept_evidence", "two", 4), (2, "u", "s", "old", sha, "concept_evidence", "two", 4), (3, "u", "s", "v", "bad", "concept_evidence", "two", 4), (4, "u", "s", "v", sha, "formula_evidence", "two", 4), (5, "f", "s", "v", hashlib.sha256(b"x=1").hexdigest(), "formula_evidence", "x", 0)]
    got = claims.verify(spark.createDataFrame(rows, "claim_id int, unit_id string, source_id string, source_sha256 string, payload_sha256 string, role string, quote string, start int"), units, spark.createDataFrame([("s", "v")], "source_id string, sha256 string"), spark.createDataFrame([], "path string"))
    assert {r.claim_id: r.problem for r in got.collect()} == {1: None, 2: "source_stale", 3: "payload_changed", 4: "role_mismatch", 5: "student_attempt"}


def run_of(kind, recall, **more):
    return {"kind": kind, "recall_5": recall, "intrusion": 0.0, "false_accepts": 0, "missing": 0, "slices": {"s": recall}, "resources": {"p95_latency_ms": 10.0, "index_size_bytes": 10, "indexed_docs": 100, "top5_stability": 1.0}} | more


def test_gate_has_three_answers():
    lim = gate.limits()
    good = {"recall_1": {"delta": 0.1, "low": 0.05, "high": 0.2}, "recall_5": {"delta": 0.2, "low": 0.1, "high": 0.3}, "reciprocal_rank": {"delta": 0.1, "low": 0.05, "high": 0.2}, "hit_1_p": 0.001, "hit_5_p": 0.001}
    assert gate.decide(["too_few_courses"], None, None, None, ["s"], lim)[0] == gate.INSUFFICIENT
    assert gate.decide([], run_of("bm25", 0.95), run_of("rrf", 0.99), good, ["s"], lim) == (gate.NO_GO, ["bm25_adequate_no_heavy_backend_needed"])
    assert gate.decide([], run_of("bm25", 0.7), run_of("rrf", 0.95), good, ["s"], lim) == (gate.GO, ["hybrid_passed_optional_gate"])
    assert gate.decide([], run_of("bm25", 0.7), run_of("dense", 0.95), good, ["s"], lim)[1] == ["candidate_kind_is_experiment_only"]
    assert "candidate_slice_below_floor:s" in gate.decide([], run_of("bm25", 0.7), run_of("rrf", 0.8), good, ["s"], lim)[1]
    assert gate.decide([], run_of("bm25", 0.95), run_of("reranker", 0.95), good, ["s"], lim)[0] == gate.GO
    with pytest.raises(ValueError):
        gate.limits({"min_courses": 1})


def test_gate_sufficiency_and_effects(spark):
    gold = spark.createDataFrame([(i, f"c{i % 3}", i % 4 != 0, ["s"]) for i in range(200)], "query_id long, course_id string, answerable boolean, tags array<string>")
    assert gate.sufficiency(gold, ["s"], gate.limits()) == []
    assert "too_few_total_queries" in gate.sufficiency(gold.limit(10), ["s"], gate.limits())
    metrics = gold.select("query_id", "answerable", *[F.lit(0.0).alias(c) for c in ("recall_1", "recall_5", "reciprocal_rank")], F.lit(0).alias("hit_1"), F.lit(0).alias("hit_5"))
    better = metrics.withColumn("recall_5", F.lit(1.0)).withColumn("hit_5", F.lit(1))
    effects = gate.compare(metrics, better, resamples=50)
    assert effects["recall_5"] == {"delta": 1.0, "low": 1.0, "high": 1.0} and effects["hit_5_p"] < 1e-6 and effects["hit_1_p"] == 1.0


def test_extraction_scores(spark):
    gold = spark.createDataFrame([(1, ["u1", "u2"]), (2, ["u3"])], "query_id long, relevant array<string>")
    ranked = spark.createDataFrame([(1, ["x", "u1"])], "query_id long, units array<string>")
    r = extraction.retrieval_scores(gold, ranked).first()
    assert tuple(r) == (2, 0.0, 0.25, 0.25)


def unit(**c):
    return dict.fromkeys(ledger.UNIT) | c


def test_patches_fold_in_order(spark):
    base = unit(unit_id="q", kind="question", text="old")
    ops = [
        (1, "assign_chapter", unit(unit_id="q", chapter_id="ch01", phase_id="p1"), None), (2, "replace_unit", unit(unit_id="q", kind="question", text="no"), "stale"),
        (3, "replace_unit", unit(unit_id="q", kind="question", text="new"), ledger.unit_digest(base | {"chapter_id": "ch01", "phase_id": "p1"})), (4, "add_unit", unit(unit_id="a", kind="answer", text="x"), None),
        (5, "pair_qa", unit(unit_id="q", paired_unit_id="a"), None), (6, "classify_asset", unit(unit_id="gone", asset_role="r"), None),
    ]
    rows = [(seq, op, *[u[c] for c in ledger.UNIT], sha) for seq, op, u, sha in ops]
    got = ledger.replay(spark.createDataFrame([tuple(base[c] for c in ledger.UNIT)], ledger.UNIT_SCHEMA), spark.createDataFrame(rows, f"seq long, op string, {ledger.UNIT_SCHEMA}, expected_sha256 string"))
    by = {r.unit_id: r for r in got.collect()}
    assert (by["q"].text, by["q"].paired_unit_id, by["q"].changed, by["q"].problems) == ("new", "a", 3, "replace_stale")
    assert (by["a"].paired_unit_id, by["a"].exists) == ("q", True) and (by["gone"].exists, by["gone"].problems) == (False, "classify_asset_without_unit")


def test_batches_follow_their_states(spark):
    e = [("a", 1, "planned"), ("a", 2, "visual_ready"), ("a", 3, "taught"), ("b", 1, "taught"), ("b", 2, "planned"), ("b", 3, "taught")]
    assert {r.batch: (r.state, r.skipped) for r in ledger.batch_states(spark.createDataFrame(e, "batch string, seq int, state string")).collect()} == {"a": ("taught", 0), "b": ("planned", 2)}


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Which is right?\nA. one\nB. two", "choice"), ("Treat these\nA. one\nB. two", "subjective"), ("Which?\nA. one\nC. two", "subjective"), ("Fill in x ____ y", "fill_blank"), ("Answer: ____", "subjective"), ("____", "subjective"), ("Prove it.", "subjective")],
)
def test_question_types(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(questions.question_type(F.col("t"))[0]).first()[0] == kind


OPTIONS = "A. one\nB. two"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Which?\nA. one\nmore of it\nB. two\nExplain your answer", ("choice", ["A. one more of it", "B. two"])), ("Which?\nA. one\n\nnot more\nB. two", ("choice", ["A. one", "B. two"])),
        ("选一个：A. 对的 B. 错的", ("choice", ["A. 对的", "B. 错的"])), ("Which is it? A. foo, B. bar Explain why", ("choice", ["A. foo", "B. bar"])), ("Which? A. e.g. one B.", ("subjective", None)),
        ("Let x __ y", ("subjective", None)), ("Let x ___ y", ("fill_blank", None)), ("Solution:\nx ___ y", ("subjective", None)), ("Write in the box below ___", ("subjective", None)), ("Fill in the blank below ____", ("fill_blank", None)),
        ("(5 pts) ____", ("subjective", None)), ("Answer the following: f(x)= ____", ("fill_blank", None)), (None, ("subjective", None)),
    ],
)
def test_classified_questions(text, want):
    assert questions.classify_question(text) == want


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        ("Which?\n" + OPTIONS, "B. because", ("choice", ["A. one", "B. two"], "B")), ("Which?\n" + OPTIONS, "a long proof", ("subjective", None, "a long proof")), ("Parts:\n" + OPTIONS, "1. B", ("choice", ["A. one", "B. two"], "B")),
        ("Parts:\n" + OPTIONS, "1. C", ("subjective", None, "1. C")), ("x is ____ now", "Answer: LIFO", ("fill_blank", None, "LIFO")), ("Prove it", None, ("subjective", None, None)), ("Which?\nA. B. Smith\nB. two", "B. Smith", ("choice", ["A. B. Smith", "B. two"], "A")),
    ],
)
def test_typed_items(question, answer, want):
    assert questions.typed_item(question, answer) == want


@pytest.mark.parametrize(("answer", "letter"), [("Answer: B", "B"), ("1) b", "B"), ("B because it is", "B"), ("two.", "B"), ("C", None), ("Solution set", None), ("(A)", "A")])
def test_choice_letters(spark, answer, letter):
    df = spark.createDataFrame([(answer, ["A. one", "B. two"])], "a string, o array<string>")
    assert df.select(questions.choice_letter(F.col("a"), F.col("o"))).first()[0] == letter


def documents(spark, folder, texts):
    rows = [(i, t, f"s{i % 2}") for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_formulas_are_searched_in_whole_texts(spark, tmp_path):
    from lyceum.plans import materials

    at = documents(spark, tmp_path, [(0, "plain " * 60 + "$y$ and $$z$$"), (9, "plain " * 60 + "y_1 and \\beta then = 4\n9, done")])
    assert {r.doc_id: r.n for r in materials.math_spans(spark, at).collect()} == {0: 3, 9: 0}
    late = {r.doc_id: r for r in materials.math_hazards(spark, documents(spark, tmp_path / "b", [(8, "plain " * 60 + "y_1 and \\beta then = 4\n9, done")])).collect()}[8]
    assert (late.raw, late.command, late.layout) == ("raw_subscript", r"\beta", "stacked_fraction_flattened")


def test_claims_are_checked_against_whole_texts(spark, tmp_path):
    from lyceum.plans import materials, study

    quote = "a quoted run of words"
    at = documents(spark, tmp_path, [(3, f"abc {quote} " + "filler " * 60 + quote[:12]), (5, f"abc {quote} " + "filler " * 60), (7, "abc aaaaaaaaaaaaaaaa"), (11, "x" * 300)])
    got = {r.claim_id: r for r in materials.claims_located(spark, at).collect()}
    assert got[3].problem == got[7].problem == got[11].problem == "quote_ambiguous" and got[5].problem is None and (got[5].start, got[5].end) == (4, 16)
    assert {r.problem: r.n for r in materials.claims_verified(spark, at).collect()} == {None: 3, "role_mismatch": 1}
    ids = documents(spark, tmp_path / "b", [(1, "a" * 229 + " b"), (2, "a" * 229 + "b ")])
    assert {r.problem: r.n for r in study.stable_ids(spark, ids).collect()} == {"too_long": 1, "padded": 1}


def test_boxes_are_all_lines(spark, tmp_path):
    from lyceum.plans import materials

    lines = [(1, n) for n in range(1, 4)] + [(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.multi_column: r.n for r in materials.multi_column(spark, str(tmp_path)).collect()} == {True: 1}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("## Quiz 1.2 (b) Solutions", [("quiz", 1, 2, "b", "solution", "explicit_solution")]), ("Example 3.4 Continued\nbody", [("example", 3, 4, None, "problem", "bare")]), ("Quiz 1.1 Problem: find the solution set", [("quiz", 1, 1, None, "problem", "explicit_problem")]),
        ("as described in\nExample 1.9, each outcome", []), ("decisions of\nExample 1.9 each", []), ("some prose\nExample 1.9, each outcome", []), ("some prose\nExample 1.9 each outcome", [("example", 1, 9, None, "problem", "bare")]),
        ("see in\nExample 1.9 Solution", [("example", 1, 9, None, "solution", "explicit_solution")]), ("see Example 1.1 here", []), ("Example 1.1 ..... 7", []), ("Example 2.2 states that x", []), ("see\n- Example 2.2 x", [("example", 2, 2, None, "problem", "bare")]),
        ("Quiz 1.1 (a) continued 2: Answer", [("quiz", 1, 1, "a", "solution", "explicit_solution")]), ("Example 1.1\nSolution follows", [("example", 1, 1, None, "solution", "explicit_solution")]), (None, []),
    ],
)
def test_headings_of_problems(spark, text, want):
    rows = pages.markers(spark.createDataFrame([("f", 1, text)], "file string, page int, text string")).collect()
    assert [(r.kind, r.chapter, r.num, r.variant, r.role, r.form) for r in rows] == want


def test_parts_are_paired_apart(spark):
    rows = [("f", 1, "Quiz 1.1 (a) Problem"), ("f", 2, "Quiz 1.1 (b) Problem"), ("f", 3, "Quiz 1.1 (b) Solution"), ("f", 4, "Quiz 1.1 (c) Solution")]
    found = pages.markers(spark.createDataFrame(rows, "file string, page int, text string"))
    assert {r.variant: r.answer_page for r in pages.paired(found).collect()} == {"a": None, "b": 3}
    assert [r.variant for r in pages.orphan_solutions(found, parts=True).collect()] == ["c"]

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lyceum.operators import chunking, constraints, duplicates, fusion, matrix, questions, retrieval, sessions, state, stats
from pyspark.sql import functions as F

WORDS = st.text("ab .!?\n好。", max_size=400)


@given(WORDS)
@settings(max_examples=60, deadline=None)
def test_chunks_are_verbatim_and_ordered(text):
    found = chunking.spans(text, 30, 60)
    assert all(0 <= a < b <= len(text) and b - a <= 60 for _, a, b in found)
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:], strict=False))


def test_chunks_by_headings_and_limits():
    text = "# One\n" + "a. " * 50 + "\n# Two\nb."
    assert [s[0] for s in chunking.spans(text)] == ["One", "Two"]
    assert [b - a for _, a, b in chunking.spans("x" * 4500)] == [2000, 2000, 500]
    assert chunking.spans("") == []


def test_chunk_units_keep_atoms_and_hide_answers(spark):
    base = {"source_file": "f", "source_id": "s", "chapter_id": "ch01", "section": "S", "parent_unit_id": None, "asset_path": None, "latex": None, "html": None}
    rows = [
        base | {"page": 1, "ordinal": k, "unit_id": f"u{k}", "kind": kind, "asset_role": role, "text": text}
        for k, (kind, role, text) in enumerate([("text", None, "one"), ("text", None, "two"), ("formula", None, "x=1"), ("text", None, "three"), ("answer", None, "no"), ("text", "worked_solution", "no")])
    ]
    kinds = "source_file string, source_id string, chapter_id string, section string, parent_unit_id string, asset_path string, latex string, html string, page int, ordinal int, unit_id string, kind string, asset_role string, text string"
    got = chunking.chunk_units(spark.createDataFrame(rows, kinds)).orderBy("chunk").collect()
    assert [(r.kind, list(r.unit_ids), r.text) for r in got] == [("prose", ["u0", "u1"], "S\none\n\ntwo"), ("formula", ["u2"], "S\nx=1"), ("prose", ["u3"], "S\nthree")]


def test_bm25_matches_the_formula(spark):
    texts = {1: "word ram model word", 2: "sorting bound", 3: "", 4: "bystander effect ram"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "What is the word ram"), (2, "the of is"), (3, "unheard")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.search(docs, asked).collect()}
    lens = {k: len(v.split()) for k, v in texts.items()}
    avg = round(sum(lens.values()) / 4, 3)

    def part(tf, df, n):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))

    assert got == {(1, 1): pytest.approx(part(2, 1, 4) + part(1, 2, 4), abs=1e-4), (1, 4): pytest.approx(part(1, 2, 3), abs=1e-4)}
    quiet = retrieval.abstentions(asked, retrieval.search(docs, asked))
    assert {r.query_id: r.abstain for r in quiet.collect()} == {1: False, 2: True, 3: True}


def test_glossary_widens_the_query(spark):
    terms = spark.createDataFrame([("stack", ["栈", "pile"])], "term string, others array<string>")
    asked = spark.createDataFrame([(1, "stack overflow")], "query_id long, text string")
    got = retrieval.query_tokens(asked, "query_id", "text", retrieval.glossary_edges(terms)).first().tokens
    assert got == ["stack", "overflow", "pile", "栈"]


def dice(a, b):
    from collections import Counter

    x, y = (Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in (a, b))
    return 2 * sum((x & y).values()) * 1_000_000 // (sum(x.values()) + sum(y.values()))


def test_near_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.choice([60, 200]))).strip() for _ in range(12)]
    texts = list(base)
    for b in base:
        for n in (1, 3, 9):
            s = list(b)
            for _ in range(n):
                s[rng.randrange(len(s))] = "z"
            texts.append("".join(s))
    texts += [base[0], base[0].upper(), "short", "short", ""]
    rows = [(i, "k", x) for i, x in enumerate(texts)]
    got = {(r.left_id, r.right_id): (r.match_kind, r.score_ppm) for r in duplicates.near_pairs(spark.createDataFrame(rows, "unit_id long, block string, text string"), "block").collect()}
    norm = [" ".join(x.split()).lower() for x in texts]
    first = {}
    for i, n in enumerate(norm):
        first.setdefault(n, i)
    for i, x in enumerate(norm):
        for j in range(i + 1, len(norm)):
            if first[x] == i and first[norm[j]] == j and min(len(x), len(norm[j])) >= 24:
                score = dice(x, norm[j])
                assert got.get((i, j)) == (("near", score) if score >= 920_000 else None)
    n = len(base) * 4
    assert got[(0, n)] == ("exact", 1_000_000) and got[(n + 2, n + 3)] == ("exact", 1_000_000) and got[(0, n + 1)] == ("near", 1_000_000)


def test_near_pairs_meet_across_tiles_parts_and_bins(spark, monkeypatch):
    import random

    for name, value in (("TILE", 4000), ("COUNTED", 900), ("STRIP", 16), ("COLUMNS", 3), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(duplicates, name, value)
    rng = random.Random(9)
    syllables = "the of er in re an on ou ha st".split()
    base = ["".join(rng.choice(syllables) + " " * rng.randrange(2) for _ in range(n)).strip() for n in (12, 95, 100, 105, 110, 115, 200, 210, 220, 700) for _ in range(3)] + ["ab" * 400, "ab" * 410]
    texts = list(base)
    for b in base:
        texts += [b + " " + b[: len(b) // k] for k in (6, 9, 40)] + [b[: len(b) // 2] + "\U0001f600é" + b[len(b) // 2 :]]
    rows = [(f"u{i:03d}", "kl"[i % 7 == 0], x) for i, x in enumerate(texts)] + [("u998", None, base[5]), ("u999", "k", None)]
    units = spark.createDataFrame(rows, "unit_id string, block string, text string")
    got = sorted((r.block, r.left_id, r.right_id, r.score_ppm) for r in duplicates.near_pairs(units, "block").collect() if r.score_ppm < 1_000_000)
    first = {}
    for u, b, x in rows:
        if b and x and len(" ".join(x.split())) >= 24:
            first.setdefault((b, " ".join(x.split())), u)
    norm = [(u, b, x) for (b, x), u in first.items()]
    want = [(b, u, v, dice(x, y)) for k, (u, b, x) in enumerate(norm) for v, c, y in norm[k + 1 :] if b == c]
    assert got == sorted(w for w in want if 920_000 <= w[3] < 1_000_000) and len(got) > 60


def test_unrelated_texts_of_few_trigrams_are_no_candidates(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("the of er in re an on ou ha st nd".split()) + " " * rng.randrange(2) for _ in range(rng.randrange(500, 600))) for _ in range(40)]
    sides = [(0, 2, "k", i, str(i), len(x) - 2, 256, duplicates._sketch(duplicates._gram_codes(x), 256)) for i, x in enumerate([*texts, texts[3] + " the end"])]
    df = spark.createDataFrame(sides, "tp long, side int, block string, unit_id long, digest string, n long, bins int, sketch binary")
    out = duplicates._candidates(duplicates.THRESHOLD)(df.toArrow()).to_pylist()
    assert sorted(r["unit_id"] for r in out) == [3, 40]


def test_conflicts_need_two_sources(spark):
    units = spark.createDataFrame([(1, "a", "It is 5 always", "text"), (2, "b", "It is 6 always", "text"), (3, "a", "It is 5 never", "text")], "unit_id long, source string, text string, kind string")
    pairs = spark.createDataFrame([(1, 2, "near", 950_000), (1, 3, "near", 950_000)], "left_id long, right_id long, match_kind string, score_ppm long")
    got = duplicates.conflicts(pairs, units, spark.createDataFrame([("b", 3)], "source string, rank int")).collect()
    assert [(r.left_id, r.right_id, r.kind, r.preferred) for r in got] == [(1, 2, "numeric_mismatch", 2)]


def test_conflicts_go_by_the_left_side_s_kind_and_carry_no_texts(spark):
    rows = [(1, "a", "x + 1", "formula"), (2, "b", "x - 1", "text"), (3, "b", "X + 1", "answer"), (4, "a", None, "answer"), (5, None, "x + 1", None), (6, "a", "x  + 1", "text")]
    units = spark.createDataFrame(rows, "unit_id long, source string, text string, kind string")
    pairs = spark.createDataFrame([(a, b, "exact", 1_000_000) for a in range(1, 7) for b in range(1, 7) if a != b], "left_id long, right_id long, match_kind string, score_ppm long")
    out = duplicates.conflicts(pairs, units)
    got = {(r.left_id, r.right_id): list(r.signals) for r in out.collect()}
    source, text, kind = ({r[0]: r[k] for r in rows} for k in (1, 2, 3))
    want = {}
    for a, b in ((a, b) for a in source for b in source if source[a] != source[b]):
        found = ["answer_mismatch"] * (kind[a] == "answer" and " ".join((text[a] or "").split()).lower() != " ".join((text[b] or "").split()).lower())
        found += ["numeric_mismatch"] * ((text[a] or "")[-1:] != (text[b] or "")[-1:])
        found += ["formula_mismatch"] * (kind[a] == "formula" and (text[a] or "").split() != (text[b] or "").split())
        want.update({(a, b): found} if found else {})
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


def test_labels_are_no_numbers(spark):
    df = spark.createDataFrame([("Theorem 7.8: there are 3 of -2.5e3",)], "t string")
    assert df.select(duplicates.numeric_tokens(F.col("t"))).first()[0] == ["3", "-2.5e3"]


def test_rrf_and_stability(spark):
    rows = [("x", 1, "a", 1), ("x", 1, "b", 2), ("y", 1, "b", 1), ("y", 1, "c", 60)]
    df = spark.createDataFrame(rows, "backend string, query_id long, doc_id string, rank int")
    got = [(r.doc_id, r.score) for r in fusion.rrf(df).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 12)), ("a", round(1 / 61, 12))]
    same = fusion.top_k_stability(df.withColumnRenamed("backend", "repeat"), 1).first()
    assert (same.queries, same.stable, same.share) == (1, 0, 0.0)


def test_query_metrics(spark):
    gold = spark.createDataFrame([(1, True, ["u1", "u2"], ["bad"]), (2, True, ["u9"], []), (3, False, [], [])], "query_id long, answerable boolean, relevant array<string>, hard_negative array<string>")
    hits = spark.createDataFrame([(1, 1, ["x"]), (1, 2, ["u1", "bad"]), (3, 1, ["x"])], "query_id long, rank int, unit_ids array<string>")
    got = {r.query_id: r for r in fusion.query_metrics(gold, hits).collect()}
    assert (got[1].recall_1, got[1].recall_5, got[1].reciprocal_rank, got[1].intrusion) == (0.0, 0.5, 0.5, 1)
    assert got[2].missing == 1 and got[3].false_accept == 1


def test_statistics(spark):
    assert stats.mcnemar_exact(0, 0) == 1.0 and stats.mcnemar_exact(1, 9) == round(2 * 11 / 1024, 8)
    same = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    assert stats.cohen_kappa(same, "a", "b").first().kappa == 1.0
    assert math.isnan(stats.cohen_kappa(same.limit(0), "a", "b").first().kappa)
    df = spark.createDataFrame([(True, False)] * 9 + [(False, True)], "a boolean, b boolean")
    r = stats.mcnemar_counts(df, "a", "b").first()
    assert (r.left_only, r.right_only) == (9, 1) and r.chi_square == pytest.approx(4.9) and r.p_value == pytest.approx(math.erfc(math.sqrt(2.45)), abs=1e-8)
    assert stats.bootstrap_interval([0, 0, 1], [1, 1, 1], 100, 7) == stats.bootstrap_interval([0, 0, 1], [1, 1, 1], 100, 7)
    rounds = spark.createDataFrame([("m", i, v) for i, v in enumerate([0.2, 0.5, 0.51, 0.515, 0.516])], "m string, i int, v double")
    assert stats.converged_round(rounds, ["m"], "i", "v").first().converged == 4


def test_matrix_is_honest_about_missing_verdicts(spark):
    key = "course string, model string, arm string, item_id string"
    a = spark.createDataFrame([("c", "m", "x", str(i), ok, status, 0.5) for i, (ok, status) in enumerate([(True, "ok"), (True, "ok"), (False, "ok"), (True, "infra_error")])], key + ", answerable boolean, status string, cost_usd double")
    s = spark.createDataFrame([("c", "m", "x", "0", None, True, 0.8, False, None, False, "lexical")], key + ", answerable boolean, correct boolean, faithfulness double, hallucinated boolean, abstained boolean, judge_error boolean, scored_by string")
    r = matrix.cells(matrix.merge_rows(a, s)).first()
    assert (r.n, r.n_answerable, r.n_oos, r.correct, r.faithfulness, r.abstention_oos, r.n_judge_error, r.n_infra_error, r.cost_usd) == (4, 2, 1, 0.5, 0.8, 0.0, 1, 1, 2.0)
    orphan = s.withColumn("item_id", F.lit("9"))
    assert {r.rule for r in matrix.merge_problems(a, orphan).collect()} == {"score_without_answer"}
    assert {r.rule for r in matrix.merge_problems(a, s.union(s)).collect()} == {"score_repeated"}


def test_difficulty_and_mastery(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "prove that the integral", True, "3-5", 9, "proof"), ([], "plain", None, None, 1, "choice")], "knowledge_points array<string>, text string, requires_assets boolean, answer_pages string, chapter_no int, type string")
    d, points, _ = questions.difficulty({c: F.col(c) for c in df.columns}, F.lit(7))
    assert [tuple(r) for r in df.select(d, points).collect()] == [(5, 8), (1, 0)]
    rows = spark.createDataFrame([("weak", 3, 0), ("weak", 1, 1), ("neutral", 2, 2), ("mastered", 5, 3), ("neutral", 4, 4)], "class string, difficulty int, position int")
    assert [r.position for r in rows.orderBy(*questions.study_order("review")).collect()] == [1, 0, 4, 2, 3]
    assert [r.position for r in rows.orderBy(*questions.study_order("from_scratch")).collect()] == [1, 2, 0, 4, 3]


def test_eligibility_gives_the_first_reason(spark):
    schema = "id string, chapter string, phase string, gradable boolean, type string, question string, options array<string>, answer string, keywords array<string>"
    rows = [
        ("1", "1", None, None, "choice", "q", ["A. x", "B. y"], "B", None), ("2", "1", None, None, "choice", "q", ["A. x", "B. x"], "x", None), ("3", "1", None, None, "fill_blank", "q", None, "a", None),
        ("3", "1", None, None, "fill_blank", "q", None, "a", None), ("4", None, None, None, "fill_blank", "q", None, "a", None), ("5", "1", None, False, "fill_blank", "q", None, "a", None), ("6", "1", None, None, "subjective", "q", None, "a", []),
        (None, "1", None, None, "fill_blank", "q", None, "a", None), ("7", "one", None, None, "fill_blank", "q", None, "a", None), ("8", "2", None, None, "true_false", "q", None, " True ", None),
    ]
    got = sorted(((r.id or "", r.reason) for r in questions.eligibility(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([("1", None), ("2", "choice_answer_not_unique_option"), ("3", "duplicate_id"), ("3", "duplicate_id"), ("4", "scope_missing"), ("5", "non_gradable"), ("6", "subjective_keywords_missing"), ("", "id_invalid"), ("7", "scope_invalid"), ("8", None)], key=str)


def test_window_changes_allow_a_chapter_to_be_filled_in(spark):
    rows = [(["a@", "b@1"], ["a@2", "b@1"], 0, 0), (["a@1"], ["a@"], 1, 1), (["a@"], ["a@1", "a@2"], 1, 0), (["a@"], ["b@1"], 1, 1), ([], ["a@"], 1, 0)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "p array<string>, c array<string>")
    added, lost = sessions.window_changes(F.col("p"), F.col("c"))
    assert [tuple(r) for r in df.select(added, lost).collect()] == [r[2:] for r in rows]


def test_reconcile_keeps_status_and_supersedes(spark):
    old = spark.createDataFrame([(1, "old", "in_review"), (2, "old", "open"), (3, "old", "resolved")], "k int, text string, status string")
    new = spark.createDataFrame([(1, "new", "open"), (4, "new", "open")], "k int, text string, status string")
    assert {r.k: (r.text, r.status) for r in state.reconcile(old, new, "k").collect()} == {1: ("new", "in_review"), 2: ("old", "superseded"), 3: ("old", "resolved"), 4: ("new", "open")}


def test_window_add(spark):
    w = spark.createDataFrame([("p", None, "in_window"), ("q", "1", "in_window"), ("q", "2", "in_window")], "point string, chapter string, status string")
    assert {(r.point, r.chapter, r.status) for r in state.window_add(w, "p", "3", "verified").where("point = 'p'").collect()} == {("p", "3", "verified")}
    assert state.window_add(w, "r", None, "in_window").count() == 4
    with pytest.raises(ValueError):
        state.window_add(w, "q", None, "verified")


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "c")], "id int, v string")
    found = constraints.together([constraints.unique(df, "u", "id"), constraints.present(df, "p", "id", "v"), constraints.allowed(df, "a", "id", "v", ["a"])])
    assert sorted((r.rule, r.n) for r in constraints.summary(found).collect()) == [("a", 2), ("p", 1), ("u", 1)]
    assert constraints.readiness(found).first().state == "blocked"

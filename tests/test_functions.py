import pytest
from lyceum.functions import answers, mathtext, quality
from lyceum.functions import text as t
from pyspark.sql import functions as F


def one(spark, value, expr, name="t"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expr.alias("x")).first().x


def test_tokens_of_mixed_languages(spark):
    assert one(spark, "什么是Word-RAM模型 it's 树", t.tokenize(F.col("t"))) == ["什么", "么是", "word-ram", "模型", "it's", "树"]
    assert one(spark, None, t.tokenize(F.col("t"))) == []
    assert one(spark, "What is the capital of France", t.informative(t.tokenize(F.col("t")))) == ["capital", "france"]


def test_clean_text_keeps_prose(spark):
    got = one(spark, "  <p>a</p>\n\n\n\nb \t c {x | x > 0}<b>d;</b> .x {color: red;} ", t.clean_text(F.col("t")))
    assert got == "a\n\nb c {x | x > 0} d;"


@pytest.mark.parametrize(("value", "key"), [("3", "3"), ("03", "3"), ("ch03", "3"), ("chapter-3", "3"), ("phase 3", "3"), ("x3", None), ("", None)])
def test_chapter_key(spark, value, key):
    assert one(spark, value, t.chapter_key(F.col("t"), allow_phase=True)) == key


def test_snippet_and_slug(spark):
    text = "x" * 300 + " needle " + "y" * 300
    got = one(spark, text, t.snippet(F.col("t"), F.array(F.lit("absent"), F.lit("needle"))))
    assert "needle" in got and len(got) <= 240
    assert one(spark, " A b_C-d! 树 ", t.slug(F.col("t"))) == "a-b_c-d-树"


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [("the answer is", None, "en"), ("证明 the answer", None, "mixed"), ("证明", None, "zh"), ("x + 2 = 3", None, "zxx"), ("sin(x) dx", "formula", "zxx"), ("foobarbaz", None, "unknown"), ("  ", None, "unknown"), (None, None, "unknown")],
)
def test_language_evidence(spark, value, kind, want):
    assert one(spark, value, t.language_evidence(F.col("t"), kind=F.lit(kind).cast("string"))) == want


def page(spark, text, **signals):
    base = {"page": 1, "image_count": 0, "image_area_ratio": 0.0, "vector_count": 0, "multi_column_hint": False, "table_hint": False, "formula_hint": False} | signals
    c = {k: F.lit(v) if v is not None else F.lit(None).cast("int") for k, v in base.items()} | {"text": F.col("t")}
    return tuple(quality.assess(spark.createDataFrame([(text,)], "t string"), c).select("score", "reasons", "route").first())


def test_page_quality(spark):
    assert page(spark, "A plain page of prose.") == (10000, [], "fast")
    assert page(spark, "") == (1500, ["no_text"], "review")
    assert page(spark, "", image_count=1) == (1500, ["no_text"], "recover")
    assert page(spark, "fine", vector_count=None) == (2500, ["missing_signals"], "review")
    assert page(spark, "aaaaaaa text") == (8000, ["repeated_characters"], "recover")
    assert page(spark, "go go, go go go", table_hint=True)[1] == ["repeated_characters", "table_hint"]
    assert page(spark, "xref 12 endobj")[1] == ["extraction_residue"]
    score, reasons, _ = page(spark, "bad �� text of some length here")
    assert reasons == ["nul_or_replacement_char", "garbled_text"] and score < 5000
    assert page(spark, "some prose on a page", image_area_ratio=0.5)[1] == ["visual_heavy"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("the answer is 42", 42.0), ("1,000,000", 1e6), ("1 000 000", 1e6), ("3/4", 0.75), ("2^10", 1024.0), ("-2^2", -4.0), ("(-2)^2", 4.0), ("2 x 10^3", 2000.0), (".05", 0.05), ("1.5e3", 1500.0),
        ("3-5", 5.0), ("roots 5,-3", -3.0), ("3,14", None), ("5/0", None), ("42, see chapter 7", 42.0), ("42 (pages 12-13)", 42.0), ("答案是42，见第7章", 42.0), ("complexity n^2", None), ("2^n", None), ("none", None), ("p. 12", None), ("1e999", None), ("共 7 章", 7.0), ("1/2^3", 0.125),
    ],
)
def test_final_number(text, value):
    assert answers.final_number(text) == value


@pytest.mark.parametrize(
    ("answer", "gold", "found"),
    [("It is Word-RAM。", "word-ram", True), ("microRAM", "RAM", False), ("It is not Word-RAM.", "Word-RAM", False), ("Not that. It is Word - RAM", "Word-RAM", True), ("不是树，是图", "图", False), ('**"a donkey"**', "a donkey", True), ("x", "x", False), ("", "ab", False), ("Paris is wrong; Rome it is", "Rome", True)],
)
def test_contains_gold(answer, gold, found):
    assert answers.contains_gold(answer, gold) is found


def test_decision_ladder(spark):
    names = "answerable boolean, abstained boolean, answer_type string, numeric_ok boolean, hedged boolean, has_gold boolean, votes_for int, votes int, votes_abstained int, faithful double"
    rows = [
        (False, True, "factual", False, False, False, None, None, None, None), (False, False, "numeric", True, False, False, None, None, None, None),
        (True, False, "numeric", True, False, False, None, None, None, None), (True, True, "numeric", False, True, False, None, None, None, None), (True, True, "numeric", False, False, False, None, None, None, None),
        (True, False, "factual", False, False, True, 0, 1, 0, 0.5), (True, False, "factual", False, False, False, 1, 2, 0, 1.0), (True, False, "factual", False, False, False, 0, 3, 2, 0.2), (True, False, "factual", False, False, False, 2, 3, 0, 0.9),
        (True, False, "factual", False, False, False, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, names)
    got = [tuple(r.x) for r in df.select(answers.decide({c: F.col(c) for c in df.columns}).alias("x")).collect()]
    assert got == [
        (True, True, 1.0, False, "abstention", None), (False, False, 0.0, True, "abstention", None), (True, False, 1.0, False, "numeric", None), (False, False, 0.0, True, "numeric", None), (False, True, 0.0, False, "numeric", None),
        (True, False, 1.0, False, "lexical", None), (True, False, 1.0, False, "judge", 0.5), (False, True, 0.2, False, "judge", 1.0), (True, False, 0.9, True, "judge", 2 / 3), (False, False, None, False, "judge_error", None),
    ]
    assert answers.looks_abstained("I am NOT SURE.") and not answers.looks_abstained("sure")


@pytest.mark.parametrize(
    ("text", "want"),
    [("a $x$ b $y$", [(2, 5), (8, 11)]), ("$$a\nb$$ c", [(0, 7)]), ("$a\nb$", []), ("$$ open", []), (r"\$5 and $x$", [(8, 11)]), ("$$$x$$", [(0, 6)]), ("", []), (None, [])],
)
def test_formula_spans(text, want):
    assert mathtext.spans(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [(r"use \sin x", r"\sin"), (r"\log n", r"\log"), (r"\max f", r"\max"), (r"\binom{n}{k}", None), (r"$\sin x$", None), (r"C:\sin\x", None), (r"\\host\sum\a", None), (r"\sines", None), (r"\SUM", r"\SUM"), ("", None), (None, None)],
)
def test_bare_commands(text, want):
    assert mathtext.bare_command(text) == want


@pytest.mark.parametrize(("text", "want"), [("x^2", "raw_superscript"), ("p_0", "raw_subscript"), ("$x^2$", None), ("`x^2`", None), ("`a $y$ x^2`", None), ("ab_c name", None), (") _ {ij}", "raw_subscript"), (None, None)])
def test_raw_notation(text, want):
    assert mathtext.raw_notation(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("not sure, maybe 999", True), ("not covered; I checked all 20 lectures", False), ("not sure, maybe 5 years", True), ("不确定，材料只有 20 讲", False), ("不确定，可能是 3,14", True), ("not covered in chapter 7", False), ("not covered; maybe 999. I checked all 20 lectures", True), (None, False)],
)
def test_hedged_numbers(text, want):
    assert answers.hedged(text) is want

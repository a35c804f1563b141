"""Pages of course files: visual evidence, asset cues, chapters, problems and their solutions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of visual kinds, axes, and cues for questions that need a figure.
KINDS = {
    "figure": ("figure", "fig.", "illustration", "插图", "如图", "下图", "上图"), "table": ("table", "tabular", "表格", "数据表"),
    "diagram": ("diagram", "schematic", "示意图", "结构图", "装置图", "受力图", "解剖图", "机械结构", "状态机", "state machine"), "chart": ("chart", "bar chart", "pie chart", "柱状图", "饼图", "统计图"),
    "graph": ("graph", "curve", "waveform", "曲线", "波形", "信号图", "函数图"), "plot": ("plot", "scatter", "散点", "坐标图", "sample path"), "screenshot": ("screenshot", "截图", "运行结果", "界面图", "console output"),
    "circuit": ("circuit", "电路", "原理图"), "tree": ("tree", "树状", "二叉树", "决策树"), "map": ("map", "地图"), "geometry": ("geometry", "几何图", "三角形", "venn", "文氏图", "韦恩图"), "flowchart": ("flowchart", "flow chart", "流程图"),
}
AXES = ("x-axis", "y-axis", "x轴", "y轴", "横轴", "纵轴", "坐标轴", "图例", "legend", "axis")
FIGURE_NUMBER = r"(?i)(?<![A-Za-z0-9])(?:figure|fig\.?|table|图|表)\s*\d"
MIN_DRAWINGS = 4
MASKED = ("table of contents", "figure it out", "figure out", "graph theory", "figure caption")
SHOWN = (
    r"venn", r"at right", r"to the right", r"shown (on the right|below|above)", r"as shown", r"\bshaded?\b", r"(figure|diagram|table|image|picture|chart|graph|tree|plot)s?\s+(below|above|at right|to the right)",
    r"(shown|given)\s+in\s+(figure|table|fig\.?)\s*\d*", "文氏图", "如图", "阴影", "示意图", "如下图", "见下图", "如上图", "见上图", "下图所示", "上图所示", "如下表", "见下表", "如上表", "见上表", "下表所示", "上表所示",
)
NAMED = (
    r"\bdiagram\b", r"\bfigure\b", r"\btable\b", r"\bgraph\b", r"\bplot\b", r"\btree\b", r"\bcircuit\b", r"\bdraw\b", r"\bdrawn\b", r"\baxes\b", r"\brectangle\b", r"\btriangle\b", r"\bhistograms?\b", r"\bflow\s*charts?\b",
    "流程图", "柱状图", "折线图", "饼图", "图示", "区域", r"[见如]\s*[上下]一?页", r"(?:see|on)\s+(?:the\s+)?(?:next|previous)\s+page", r"matrix\s+(below|above|shown)",
)
# A problem's heading at the start of a line, what may stand between its number and its role, the roles, prose that only mentions a problem, and a line of a table of contents.
HEAD = r"(?i)^[ \t>*•·\-\d.)）、#]*(Example|Quiz)\s+(\d+)\s*\.\s*(\d+)"
SUBPART, CONTINUED = r"(?i)^\s*[\)\.:\-]?\s*\(\s*([A-Za-z])\s*\)\s*", r"(?i)^\s*[\)\.:\-]?\s*\(?\s*continued\b\s*\d*\s*\)?[\s:.\-]*"
PROBLEM_ROLE, SOLUTION_ROLE = r"(?i)^\s*[\)\.:\-]?\s*\(?\s*problems?\b", r"(?i)^\s*[\)\.:\-]?\s*\(?\s*(?:solutions?|answers?)\b"
CITING_TAIL, CITED_NUMBER = r"(?i)^\s*[\)\.:\-]?\s*(?:says|states)\s+that\b", r"^\s*[,.;](?:\s|$)"
LEAD_IN = r"(?i)(?:\b(?:see|in|from|of|via|using|consult|review|recall|following)|\b(?:as\s+)?(?:described|defined|shown|given|stated|proved|derived|illustrated|explained)\s+in)\s*[:(]?\s*$"
CONTENTS = r"\.{4,}"
TAIL = 48


def _words(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words: Latin ones as whole tokens, others anywhere."""
    latin = [re.escape(w) for w in words if w.isascii()]
    hits = [F.contains(text, F.lit(w)) for w in words if not w.isascii()]
    if latin:
        hits.append(text.rlike("(?i)(?<![A-Za-z0-9])(?:" + "|".join(latin) + ")(?![A-Za-z0-9])"))
    return reduce(lambda a, b: a | b, hits)


def classify_page(text: Column, images: Column, drawings: Column) -> tuple[Column, Column]:
    """(has_visual, kinds) of a page: by pictures, numbered figures, axes or words; three lines with wide gaps make a table."""
    t = F.lower(F.coalesce(text, F.lit("")))
    layout = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S[ \t]{5,}\S"))) >= 3
    kinds = F.filter(F.array(*[F.when(_words(t, KINDS[k]) | (layout if k == "table" else F.lit(False)), F.lit(k)) for k in sorted(KINDS)]), lambda k: k.isNotNull())
    structural = (F.coalesce(images, F.lit(0)) > 0) | (F.coalesce(drawings, F.lit(0)) >= MIN_DRAWINGS)
    return structural | t.rlike(FIGURE_NUMBER) | _words(t, AXES) | (F.size(kinds) > 0), kinds


def needs_assets(text: Column, renderable: Column) -> Column:
    """Whether a question depends on a figure: words for one that is shown count anywhere, its mere name only where pages can be rendered."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for phrase in MASKED:
        t = F.replace(t, F.lit(phrase), F.lit(" "))
    any_of = lambda cues: t.rlike("(?i)" + "|".join(cues))
    return any_of(SHOWN) | (renderable & any_of(NAMED))


def chapters(pages: DataFrame) -> DataFrame:
    """Pages (file, page, text) with a chapter: their own heading, else the file's name, else the page before, else 1; `guessed` where there was no clue."""
    own = F.nullif(F.regexp_extract("text", r"(?im)^\s*(?:chapter|ch\.?|第)\s*(\d+)", 1), F.lit("")).try_cast("int")
    named = F.nullif(F.regexp_extract("file", r"(?i)ch(?:apter)?[\s_\-]*0*(\d+)", 1), F.lit("")).try_cast("int")
    w = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    clue = F.coalesce(F.last(F.coalesce(own, named), ignorenulls=True).over(w))
    return pages.withColumn("chapter", F.coalesce(clue, F.lit(1))).withColumn("guessed", clue.isNull())


def markers(pages: DataFrame) -> DataFrame:
    """(file, page, ordinal, kind, chapter, num, variant, role, form, continued) of headings like `Example 2.3` and `Quiz 2.3 (b) Solution`.

    A heading opens a line. A bare one is none where the line before runs on into it, or where its
    number is punctuated like a citation; lines of a table of contents are none. `variant` is the
    letter of a part, `form` tells whether the role was said.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = pages.select("file", "page", F.posexplode(F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.get(lines, i - 1).alias("before"), F.get(lines, i + 1).alias("after")))).alias("ordinal", "l")).select("file", "page", "ordinal", "l.*")
    rows = rows.where(F.col("line").rlike(HEAD) & ~F.substring("line", 1, 300).rlike(CONTENTS))
    head = F.regexp_extract("line", HEAD, 0)
    tail = F.substring(F.concat(F.substr("line", F.length(head) + 1), F.lit("\n"), F.coalesce("after", F.lit(""))), 1, TAIL)
    rows = rows.withColumn("head", head).withColumn("tail", tail)
    bare = F.col("tail")
    for pattern in (SUBPART, CONTINUED, SUBPART, CONTINUED):
        bare = F.regexp_replace(bare, pattern, "")
    rows = rows.withColumn("said", bare)
    either = lambda pattern: F.col("tail").rlike(pattern) | F.col("said").rlike(pattern)
    form = F.when(either(PROBLEM_ROLE), "explicit_problem").when(either(SOLUTION_ROLE), "explicit_solution").otherwise("bare")
    kind, listed = F.lower(F.regexp_extract("head", HEAD, 1)), F.trim(F.regexp_replace("head", r"(?i)(example|quiz)\s+\d+\s*\.\s*\d+$", "")) != ""
    first = F.col("before").isNull() | (F.trim("before") == "")
    credible = (form != "bare") | listed | first | (~F.trim("before").rlike(LEAD_IN) & ~F.col("tail").rlike(CITED_NUMBER))
    rows = rows.where(credible & ~((kind == "example") & F.col("said").rlike(CITING_TAIL)))
    part = F.lower(F.regexp_extract("tail", SUBPART, 1))
    number = lambda k: F.regexp_extract("head", HEAD, k).try_cast("int")
    return rows.select(
        "file", "page", (F.col("ordinal") * 1000).alias("ordinal"), kind.alias("kind"), number(2).alias("chapter"), number(3).alias("num"), F.when(part != "", part).alias("variant"),
        F.when(form == "explicit_solution", "solution").otherwise("problem").alias("role"), form.alias("form"), F.col("tail").rlike(r"(?i)\bContinued\b").alias("continued"),
    )


_PROBLEM = ["kind", "chapter", "num", "part"]


def paired(found: DataFrame) -> DataFrame:
    """One row a problem of a file (and of a part, where it has some), with the page of its solution: in the same file, else in another where no second file has the problem."""
    found = found.withColumn("part", F.coalesce("variant", F.lit("")))
    problems = found.where("role = 'problem'").groupBy(*_PROBLEM, "file").agg(F.min("page").alias("page"))
    files = problems.groupBy(*_PROBLEM).agg(F.count("*").alias("files"))
    solutions = found.where("role = 'solution'").groupBy(*_PROBLEM, "file").agg(F.min(F.struct("page", "ordinal")).alias("s"))
    same = solutions.select(*_PROBLEM, "file", F.col("s.page").alias("same_page"))
    other = solutions.groupBy(*_PROBLEM).agg(F.min(F.struct("file", "s")).alias("o")).select(*_PROBLEM, F.col("o.file").alias("other_file"), F.col("o.s.page").alias("other_page"))
    rows = problems.join(files, _PROBLEM).join(same, [*_PROBLEM, "file"], "left").join(other, _PROBLEM, "left")
    lone = (F.col("files") == 1) & F.col("same_page").isNull()
    return rows.select(
        "kind", "chapter", "num", F.nullif("part", F.lit("")).alias("variant"), "file", "page", F.when(F.col("same_page").isNotNull(), F.col("file")).when(lone, F.col("other_file")).alias("answer_file"),
        F.coalesce("same_page", F.when(lone, F.col("other_page"))).alias("answer_page"), (F.col("files") > 1).alias("ambiguous"),
    )


def orphan_solutions(found: DataFrame, parts: bool = False) -> DataFrame:
    """Solutions of a problem, or of a part of one, that no heading poses; with `parts` the part is told as `variant`."""
    found = found.withColumn("part", F.coalesce("variant", F.lit("")))
    lone = found.where("role = 'solution'").select(*_PROBLEM).distinct().join(found.where("role = 'problem'").select(*_PROBLEM), _PROBLEM, "left_anti")
    return lone.select("kind", "chapter", "num", *([F.nullif("part", F.lit("")).alias("variant")] if parts else [])).distinct()


def question_index(questions: DataFrame, visual: DataFrame) -> DataFrame:
    """Questions (id, file, page, has_asset) on pages (file, page, has_visual) with pictures, suspects where the question has no asset; pages never scanned are marked."""
    rows = questions.join(visual, ["file", "page"], "left")
    return rows.select("id", "file", "page", F.coalesce("has_visual", F.lit(False)).alias("visual"), (F.coalesce("has_visual", F.lit(False)) & ~F.col("has_asset")).alias("suspect"), F.col("has_visual").isNull().alias("unscanned"))


def columns_hint(boxes: DataFrame) -> DataFrame:
    """(file, page, multi_column) from text boxes (x0, y0, x1, y1): some gap of 3 % of the width splits them with two at least on either side that overlap in height by a quarter."""
    w = Window.partitionBy("file", "page")
    rows = boxes.withColumn("n", F.count("*").over(w)).withColumn("width", F.max("x1").over(w) - F.min("x0").over(w))
    order = w.orderBy("x0", "y0")
    left = order.rowsBetween(Window.unboundedPreceding, 0)
    right = order.rowsBetween(1, Window.unboundedFollowing)
    gap = F.min("x0").over(right) - F.max("x1").over(left)
    top, bottom = F.greatest(F.min("y0").over(left), F.min("y0").over(right)), F.least(F.max("y1").over(left), F.max("y1").over(right))
    short = F.least(F.max("y1").over(left) - F.min("y0").over(left), F.max("y1").over(right) - F.min("y0").over(right))
    k = F.row_number().over(order)
    split = (F.col("n") >= 4) & (k >= 2) & (F.col("n") - k >= 2) & (gap >= 0.03 * F.col("width")) & (bottom - top >= 0.25 * short)
    return rows.withColumn("split", F.coalesce(split, F.lit(False))).groupBy("file", "page").agg(F.bool_or("split").alias("multi_column"))

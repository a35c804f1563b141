"""Small vocabularies: message codes, chapters of paths, opened files of a tool log, severities."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Patterns in order, the first that fits gives the code.
MESSAGES = (
    (r"(?i)NUL|控制字节|control", "unsafe_control_text"), (r"(?i)formula|公式|LaTeX|math", "formula_or_math"), (r"(?i)missing.answer|缺.*答案|答案.*缺", "missing_answer"),
    (r"(?i)keyword|关键词", "subjective_keywords_missing"), (r"(?i)chapter|章节|未归属", "chapter_mapping"), (r"(?i)visual|asset|图片|图像|题面图|答案图", "visual_asset"), (r"(?i)review|审核|复核", "review_pending"),
)
CHAPTER_IN_PATH = r"(?i)(?:lecture|lec|ch|chapter|ps)[\s_\-]*0*(\d+)"
TOOL_LOG = "type string, result string, total_cost_usd double, message struct<content: array<struct<type: string, name: string, input: struct<file_path: string, pattern: string, path: string>>>>"


def message_code(message: Column) -> Column:
    out = F.lit("other")
    for pattern, code in reversed(MESSAGES):
        out = F.when(message.rlike(pattern), code).otherwise(out)
    return out


def chapter_of(path: Column) -> Column:
    """The chapter that a path names, in its last part rather than before."""
    number = lambda p: F.nullif(F.regexp_extract(p, CHAPTER_IN_PATH, 1), F.lit(""))
    return F.coalesce(number(F.element_at(F.split(path, "/"), -1)), number(path)).try_cast("int")


def opened_files(log: Column) -> Column:
    """Paths that a run opened, in order and once each, from a log of one JSON object a line.

    A read gives its file, a glob its pattern and path, a search its path only: what it searches for is no path.
    """
    events = F.transform(F.split(log, "\n"), lambda line: F.from_json(line, TOOL_LOG))
    calls = F.flatten(F.transform(F.filter(events, lambda e: e["type"] == "assistant"), lambda e: F.coalesce(e["message"]["content"], F.array().cast("array<struct<type: string, name: string, input: struct<file_path: string, pattern: string, path: string>>>"))))
    used = F.filter(calls, lambda c: c["type"] == "tool_use")
    paths = F.transform(
        used,
        lambda c: F.when(c["name"] == "Read", F.array(c["input"]["file_path"])).when(c["name"] == "Glob", F.array(c["input"]["pattern"], c["input"]["path"])).when(c["name"] == "Grep", F.array(c["input"]["path"])).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(F.flatten(paths), lambda p: p.isNotNull() & (p != "")))


def severity(kind: Column, blocking: list[str]) -> Column:
    """Blocking if the kind holds one of the words."""
    out = F.lit(False)
    for word in blocking:
        out = out | F.contains(kind, F.lit(word))
    return F.when(out, "blocking").otherwise("warning")


# Study modes, time tiers and reply languages, with the words that stand for them; older modes with the mode and tier that replace them.
MODES = {
    "from_scratch": ("零基础从头讲", "teach from scratch", "from scratch", "teach-from-scratch"),
    "shore_up": ("某章起步补弱", "start mid-course, shore up weak spots", "shore up", "shore up weak spots", "start mid-course", "mid-course"),
    "fill_gaps": ("查缺补漏", "fill the gaps", "fill gaps", "fill-the-gaps", "gap filling"),
}
OLD_MODES = {"panic": ("from_scratch", "le1d"), "sprint": ("fill_gaps", "d1_3"), "normal": ("fill_gaps", None), "mock": ("fill_gaps", None)}
TIERS = {
    "le1d": ("≤1天", "≤1 day", "<=1天", "1天", "当天", "今天", "一天", "考前一天", "明天考", "1 day"), "d1_3": ("1-3天", "1-3 days", "1—3天", "1~3天", "2-3天", "几天"),
    "d3_7": ("3-7天", "3-7 days", "3—7天", "3~7天", "一周", "一周内"), "gt7d": (">7天", ">7 days", "＞7天", "7天以上", "一周以上", "还早", "时间充裕"),
}
LANGUAGES = {
    "zh": ("中文", "Chinese", "zh-cn", "chinese", "简体中文", "汉语", "中"), "en": ("English", "english", "英文", "英语"), "bilingual": ("双语", "Bilingual", "bi", "zh+en", "中英", "中英双语"),
}
WINDOW_STATUSES = {"in_window": ("在窗口", "in window"), "out_window": ("窗口外", "out of window"), "verified": ("已实测", "verified by quiz")}
ROW_STATUSES = {
    "to_review": ("待复盘", "to review"), "to_revisit": ("待回顾", "to revisit"), "corrected": ("已订正", "corrected"), "reviewed": ("已复盘", "reviewed"), "revisited": ("已回顾", "revisited"), "resolved": ("已解决", "resolved"),
}
# What an answer says when the run failed, for good or for now, and what marks it as no answer.
HARD_ERRORS, TRANSIENT_ERRORS = ("hit your limit", "usage limit", "resets "), ("temporarily limiting", "rate limited", "api error", "overloaded")
INFRA_ERRORS = ("hit your limit", "api error", "rate limited", "temporarily limiting", "usage limit", "你已达到", "prompt is too long")
# Families of models by what their name holds.
MODEL_FAMILIES = (("claude", ("opus", "sonnet", "haiku", "claude")), ("gemini", ("gemini",)), ("openai", ("gpt", "o1", "o3", "openai")), ("deepseek", ("deepseek",)), ("mock", ("mock",)))


def canonical(value: Column, words: dict[str, tuple[str, ...]], *, any_case: bool = True) -> Column:
    """(code, known) of a word: its code, or the trimmed word itself where it stands for none."""
    said = F.trim(F.coalesce(value, F.lit("")))
    pairs = {w: code for code, names in words.items() for w in (code, *names)}
    if any_case:
        pairs |= {w.lower(): code for w, code in pairs.items()}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    code = F.coalesce(F.try_element_at(table, said), F.try_element_at(table, F.lower(said)) if any_case else F.lit(None).cast("string"))
    return F.struct(F.coalesce(code, said).alias("code"), code.isNotNull().alias("known"))


def canonical_mode(value: Column) -> Column:
    """(code, tier, known): a mode's code; an older mode gives the tier that it implied."""
    said = F.trim(F.coalesce(value, F.lit("")))
    new = canonical(value, MODES)
    out = F.struct(new["code"].alias("code"), F.lit(None).cast("string").alias("tier"), new["known"].alias("known"))
    for old, (code, tier) in OLD_MODES.items():
        out = F.when(said == old, F.struct(F.lit(code).alias("code"), F.lit(tier).cast("string").alias("tier"), F.lit(False).alias("known"))).otherwise(out)
    return out


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for m in marks:
        out = out | F.contains(low, F.lit(m))
    return out


def error_class(text: Column) -> Column:
    """hard (a limit that must be waited for), transient (try again) or ok."""
    return F.when(_holds(text, HARD_ERRORS), "hard").when(_holds(text, TRANSIENT_ERRORS), "transient").otherwise("ok")


def is_infra_error(text: Column) -> Column:
    """Whether an answer is a message of the service, and so neither right nor wrong."""
    return _holds(text, INFRA_ERRORS)


def model_family(model: Column) -> Column:
    name = F.lower(F.coalesce(model, F.lit("")))
    out = F.when(name == "", "unknown").otherwise(name)
    for family, marks in reversed(MODEL_FAMILIES):
        out = F.when(_holds(model, marks), family).otherwise(out)
    return out


# What marks a part of a path as an exam, what speaks against it, names that are a paper only in an exam folder, and words that stick to a key.
EXAM_PART = (
    r"(?i)(?:^|[\\/_\-. ])(?:exam(?!ple)s?|examinations?|mid[ _-]?terms?\d*|finals?[ _-]?exams?|finals?[ _-]?\d+|quiz(?:zes)?\d*|past[ _-]?papers?|question[ _-]?papers?|sample[ _-]?exams?|practice[ _-]?(?:exams?|midterms?|finals?)"
    r"|mock[ _-]?exams?|specimen[ _-]?papers?|prelims?[ _-]?\d+|makeup[ _-]?exams?)(?![A-Za-z])|试卷|试题|考题|真题|模拟[题卷]|模拟试[卷题]|模拟考|期[中末]|半期|样[卷题]|测验|月考|补考"
)
NO_EXAM = (
    r"(?i)课件|讲义|讲稿|教案|提纲|笔记|总结|归纳|串讲|考点|知识点|重点|复习|安排|通知|范围|时间表|考试时间|题型|说明|须知|指南|信息"
    r"|(?<![A-Za-z])(?:lectures?|slides?|notes?|handouts?|reviews?|outlines?|syllabus|schedules?|format|info(?:rmation)?|instructions?|logistics|polic(?:y|ies)|guide(?:lines?)?)(?![A-Za-z])"
)
PAPER_NAME = r"(?i)^\d{1,4}(?:[-_ .]?\d{1,4})?\s*[abAB]?\s*卷?$|^[abAB]\s*卷?$|^卷[一二三四五12345]$|^finals?$|^papers?$"
GLUED_KEY = r"(?i)(midterms?\d*|finals?\d*|exams?\d*|examinations?|quiz(?:zes)?\d*|prelims?\d*|(?:past|question|specimen)?papers?\d*)((?:solutions?|answers?|soln?s?|ans)(?:keys?|manuals?)?|keys?)(?![a-z])"


def is_exam_path(path: str | None, root: str = "") -> bool:
    """Whether a material is an exam: by its own name, or by a folder's (or the root's) if its name looks like a paper; notes and notices never are."""
    *folders, name = [x for x in (path or "").replace("\\", "/").split("/") if x] or [""]
    name = re.sub(GLUED_KEY, r"\1_\2", os.path.splitext(name)[0])
    exam = lambda part: bool(re.search(EXAM_PART, "/" + part)) and not re.search(NO_EXAM, part)
    if not name or re.search(NO_EXAM, name):
        return False
    return exam(name) or bool(re.match(PAPER_NAME, name.strip()) and any(exam(x) for x in (*folders, root) if x))


@F.pandas_udf(BooleanType())
def is_exam_path_of(paths: pd.Series) -> pd.Series:
    return paths.map(is_exam_path).astype(bool)

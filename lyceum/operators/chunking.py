"""Chunks of texts by headings or sentences, and of typed content units."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.functions.text import clean_text

# Sizes, sentence ends, words that open a topic, kinds and roles.
TARGET, HARD_MAX, MIN_TAIL = 1200, 2000, 300
SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+[\"'”』」)]*\s*|[^.!?。！？]+$")
TOPIC = re.compile(r"^(?:okay|ok|so|now|all right|alright|next|today|let's|lets|first|second|finally|好|那么|接下来|下面|现在|首先|其次|最后|我们来|让我们)\b", re.I)
HEADING = re.compile(r"(?m)^#{1,4}\s+\S.*$")
ATOMIC = ("table", "formula", "question", "code", "figure", "diagram")
RETRIEVABLE = ("title", "heading", "text", "list", "caption", "speaker_notes", "other", *ATOMIC)
HIDDEN_ROLES = ("answer_context", "worked_solution", "student_attempt", "source_page")

Span = tuple[str, int, int]


def sentences(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the sentences in a part of a text, white space with the sentence before it."""
    found = [(start + m.start(), start + m.end()) for m in SENTENCE.finditer(text[start:end]) if m[0].strip()]
    return found or ([(start, end)] if text[start:end].strip() else [])


def packed(text: str, start: int, end: int, target: int = TARGET, hard: int = HARD_MAX) -> list[tuple[int, int]]:
    """Chunks of whole sentences: each ends before the first sentence that would pass the limit, or that opens a topic beyond the target.

    Both places are searched among the sentences' ends. A short tail joins the chunk before it, and
    a sentence beyond the limit is cut there.
    """
    found = sentences(text, start, end)
    ends = [b for _, b in found]
    topics = [k for k, (a, b) in enumerate(found) if TOPIC.match(text[a : min(b, a + 24)].lstrip())]
    chunks, first = [], 0
    while first < len(found):
        begin = found[first][0]
        full = bisect.bisect_right(ends, begin + min(hard, 1.5 * target), first + 1)
        enough = bisect.bisect_right(ends, begin + target, first + 1)
        topic = bisect.bisect_left(topics, enough)
        after = min([full, *topics[topic : topic + 1]])
        chunks.append((begin, ends[after - 1]))
        first = after
    if len(chunks) > 1 and chunks[-1][1] - chunks[-1][0] < MIN_TAIL and chunks[-1][1] - chunks[-2][0] <= hard:
        chunks[-2:] = [(chunks[-2][0], chunks[-1][1])]
    return [(s, min(s + hard, b)) for a, b in chunks for s in range(a, max(b, a + 1), hard)]


def spans(text: str, target: int = TARGET, hard: int = HARD_MAX) -> list[Span]:
    """(title, start, end) of the chunks of a clean text: by headings if there are two, else by sentences."""
    marks = [(m.start(), m[0].strip()) for m in HEADING.finditer(text)]
    parts: list[Span] = [("", 0, len(text))]
    if len(marks) >= 2:
        ends = [m[0] for m in marks[1:]] + [len(text)]
        parts = [(re.sub(r"^#{1,4}\s+", "", title)[:80], a, b) for (a, title), b in zip(marks, ends, strict=True)]
        if marks[0][0] > MIN_TAIL:
            parts.insert(0, ("", 0, marks[0][0]))
    out = []
    for title, a, b in parts:
        whole = len(marks) >= 2 and b - a <= hard
        out += [(title, s, e) for s, e in ([(a, b)] if whole else packed(text, a, b, target, hard))]
    return [s for s in out if text[s[1] : s[2]].strip()]


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk, title, start, end, text): offsets are code points of the cleaned text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, title, s, e, t[s:e]) for i, t in zip(b["doc_id"], b["text"]) if t for k, (title, s, e) in enumerate(spans(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "title", "start", "end", "text"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), clean_text(F.col(text)).alias("text")).mapInPandas(run, f"doc_id {kind}, chunk int, title string, start int, end int, text string")


def unit_text(kind: str, text: str | None, latex: str | None, html: str | None, asset: str | None, options: list | None = None) -> str:
    """What a unit says: its text (a question with its options), else formula, else mark-up as text, else its asset."""
    if (text or "").strip():
        lines = [f"{chr(65 + k)}. {o}" for k, o in enumerate(options if options is not None else [])] if kind == "question" else []
        return "\n".join([text.strip(), *lines])
    if (latex or "").strip():
        tex = latex.strip()
        return tex if tex.startswith("$") and tex.endswith("$") else f"$$\n{tex}\n$$"
    if (html or "").strip():
        rows = re.sub(r"(?i)</(?:tr|p|div|li|h[1-6])\s*>", "\n", html.strip())
        return re.sub(r"<[^>]+>", " ", re.sub(r"(?i)</(?:td|th)\s*>", "\t", rows)).strip()
    return f"Visual asset: {asset.strip()}" if (asset or "").strip() else ""


def chunk_units(units: DataFrame, tainted: DataFrame | None = None, target: int = TARGET, hard: int = HARD_MAX) -> DataFrame:
    """Chunks of typed units (source_file, source_id, chapter_id, section, parent_unit_id, page, ordinal, unit_id, kind, asset_role, asset_path, text, latex, html).

    Atomic kinds stand alone. Prose is joined while source, chapter, section and parent stay the
    same, up to the limit. Answers, hidden roles and tainted assets are left out. A task holds one
    source file at a time, the unit of order.
    """
    rows = units.where(F.col("kind").isin(*RETRIEVABLE) & ~F.coalesce(F.col("asset_role").isin(*HIDDEN_ROLES), F.lit(False)))
    if tainted is not None:
        rows = rows.join(tainted.select(F.col("path").alias("asset_path")), "asset_path", "left_anti")
    names = ["source_file", "chunk", "chapter_id", "kind", "unit_ids", "pages", "text"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page", "ordinal", "unit_id"])
        groups: list[tuple[bool, list[dict]]] = []
        key = None
        for u in part.to_dict("records"):
            u = {k: None if isinstance(v, float) and v != v else v for k, v in u.items()}
            u["said"] = unit_text(u["kind"], u["text"], u["latex"], u["html"], u["asset_path"])
            if not u["said"]:
                continue
            own = (u["source_id"], u["chapter_id"], u["section"], u["parent_unit_id"])
            size = sum(len(x["said"]) for x in groups[-1][1]) if groups else 0
            if u["kind"] in ATOMIC:
                groups.append((True, [u]))
                key = None
            elif key is not None and own == key and size + len(u["said"]) <= hard and size < target:
                groups[-1][1].append(u)
            else:
                groups.append((False, [u]))
                key = own
        out = []
        for atomic, group in groups:
            said = "\n\n".join(u["said"] for u in group)
            section = group[0]["section"]
            said = said if not section or said.startswith(section) else f"{section}\n{said}"
            parts = [said] if atomic or len(said) <= hard else [said[s:e] for _, s, e in spans(said, target, hard)]
            for text in parts:
                first = group[0]
                out.append((first["source_file"], len(out), first["chapter_id"], first["kind"] if atomic else "prose", [u["unit_id"] for u in group], sorted({int(u["page"]) for u in group if u["page"]}), text))
        return pd.DataFrame(out, columns=names)

    schema = "source_file string, chunk int, chapter_id string, kind string, unit_ids array<string>, pages array<int>, text string"
    return rows.groupBy("source_file").applyInPandas(run, schema)


# The heading of a notebook entry, and a code fence.
ENTRY_HEAD, FENCE = r"^##\s+\[#([^\]\s]+)\]\s*(.*)$", r"^ {0,3}(`{3,}|~{3,})"


def notebook_entries(text: str | None) -> list[tuple[str, str, int, int]]:
    """(id, title, first line, lines) of the entries of a notebook chapter, lines counted from 0; a heading in a code fence is content.

    A fence is closed by the same character, as many times at least. One that is left open is an error.
    """
    lines, fence, heads = (text or "").splitlines(), None, []
    for k, line in enumerate(lines):
        mark = re.match(FENCE, line)
        if mark:
            if fence is None:
                fence = mark[1]
            elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
            continue
        head = re.match(ENTRY_HEAD, line) if fence is None else None
        if head:
            heads.append((head[1], head[2].strip() or head[1], k))
    if fence is not None:
        raise ValueError("a code fence is left open")
    ends = [h[2] for h in heads[1:]] + [len(lines)]
    return [(i, title, k, end - k) for (i, title, k), end in zip(heads, ends, strict=False)]

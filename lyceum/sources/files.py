"""Course files as tables: text pages, JSON lines, office documents, sheets and image headers.

Files are read by Spark's binary and text sources, so any store that Spark reads will do; the
parsers see one file's bytes at a time and give rows.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions.text import media_type

#: Bytes of one archive member, of all members together, and members of an archive that are read at most.
MEMBER_BYTES, ARCHIVE_BYTES, MEMBERS = 64 << 20, 512 << 20, 20_000
#: Folders that a scan of materials leaves out.
GENERATED = ("/.ingest/", "/references/", "/__pycache__/", "/.git/")
TEXT_SUFFIXES = ("txt", "md", "markdown", "csv", "tsv")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, media_type, size_bytes, sha256, content) of the files below a folder, without generated ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    for part in GENERATED:
        files = files.where(~F.contains("path", F.lit(part)))
    return files.select("path", media_type(F.col("path")).alias("media_type"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def _common_han(text: str) -> float:
    """Share of the characters that lie in the first level of the national standard, which running text mostly uses."""
    han = [c for c in text if "一" <= c <= "鿿"]
    if not han:
        return 0.0
    level = 0
    for c in han:
        raw = c.encode("gbk", "ignore")
        level += len(raw) == 2 and 0xB0 <= raw[0] <= 0xD7 and raw[1] >= 0xA1
    return level / len(han)


def decode(raw: bytes) -> str | None:
    """UTF-8, else whichever of GBK and Big5 gives more common characters; none if neither fits."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        found = []
        for name in ("gbk", "big5"):
            try:
                found.append(raw.decode(name))
            except UnicodeDecodeError:
                continue
        return max(found, key=_common_han, default=None)


def rows_of(files: DataFrame, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (path, ...) of a parser over (path, content)."""
    names = [c.strip().split(" ", 1)[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(path, *row) for path, raw in zip(b["path"], b["content"]) for row in parse(path, bytes(raw))]
            yield pd.DataFrame(out, columns=["path", *names]).astype(object)

    return files.select("path", "content").mapInPandas(run, "path string, " + schema)


def text_pages(files: DataFrame) -> DataFrame:
    """(path, page, text) of text files; a form feed ends a page. Files in no known encoding have one page without text."""

    def parse(path: str, raw: bytes) -> Iterator[tuple]:
        text = decode(raw)
        yield from [(1, None)] if text is None else [(k, p) for k, p in enumerate(text.split("\f"), 1)]

    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*TEXT_SUFFIXES))
    return rows_of(wanted, parse, "page int, text string")


def strict_object(line: str) -> tuple[str | None, str | None]:
    """(canonical JSON, problem) of a line: repeated keys and numbers that aren't finite are refused."""

    def pairs(items: list[tuple]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    try:
        value = json.loads(line, object_pairs_hook=pairs, parse_constant=constant)
    except ValueError as e:
        return None, str(e)[:200]
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None


def json_lines(spark: SparkSession, path: str, *, comments: bool = False) -> DataFrame:
    """(json, problem) of each line that isn't blank, nor a `#` comment where those are allowed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        lines = lines.where(~F.startswith(F.ltrim("value"), F.lit("#")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([strict_object(v) for v in b["value"]], columns=["json", "problem"])

    return lines.mapInPandas(run, "json string, problem string")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json, problem) of whole JSON files: UTF-8, without repeated keys or constants that JSON lacks, as canonical text."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, raw in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((name, *strict_object(bytes(raw).decode())))
                except UnicodeDecodeError:
                    rows.append((name, None, "not UTF-8"))
            yield pd.DataFrame(rows, columns=["path", "json", "problem"])

    return found.mapInPandas(run, "path string, json string, problem string")


def bank_items(documents: DataFrame) -> DataFrame:
    """(path, position, item, problem): the objects with an id of JSON files that hold an array; a file that holds anything else is a problem, other entries are left out."""
    whole = documents.select("path", F.coalesce("problem", F.when(~F.startswith("json", F.lit("[")), "not an array")).alias("problem"), F.from_json("json", "array<string>").alias("items"))
    bad = whole.where("problem is not null").select("path", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("item"), "problem")
    each = whole.where("problem is null").select("path", F.posexplode("items").alias("position", "item"))
    good = each.where(F.startswith("item", F.lit("{")) & F.get_json_object("item", "$.id").isNotNull())
    return good.select("path", "position", "item", F.lit(None).cast("string").alias("problem")).unionByName(bad)


def _members(raw: bytes) -> dict[str, bytes] | None:
    """Members of an archive; none if it is broken, has unsafe names or is larger than the limits."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            infos = z.infolist()
            total = sum(i.file_size for i in infos)
            unsafe = any(i.filename.startswith("/") or ".." in i.filename.split("/") or i.flag_bits & 1 for i in infos)
            if len(infos) > MEMBERS or total > ARCHIVE_BYTES or unsafe or any(i.file_size > MEMBER_BYTES for i in infos):
                return None
            return {i.filename: z.read(i) for i in infos if i.filename.endswith((".xml", ".rels"))}
    except (zipfile.BadZipFile, NotImplementedError, OSError):
        return None


def _xml(raw: bytes | None) -> ET.Element | None:
    if raw is None or b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        return None
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        return None


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _said(e: ET.Element) -> str:
    """Text runs below an element, with tabs and breaks."""
    out = []
    for x in e.iter():
        name = _local(x)
        out.append((x.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
    return "".join(out)


def _word(parts: dict[str, bytes]) -> Iterator[tuple]:
    root = _xml(parts.get("word/document.xml"))
    body = None if root is None else next((x for x in root if _local(x) == "body"), None)
    page = 1
    for k, e in enumerate(body if body is not None else []):
        if _local(e) == "p":
            style = next((v for x in e.iter() if _local(x) == "pStyle" for a, v in x.attrib.items() if a.endswith("}val")), "")
            kind = "heading" if style.lower().startswith(("heading", "title")) else "list" if any(_local(x) == "numPr" for x in e.iter()) else "text"
            yield page, k, kind, _said(e)
            page += any(_local(x) == "br" and any(v == "page" for v in x.attrib.values()) for x in e.iter())
        elif _local(e) == "tbl":
            rows = [[" ".join(_said(p) for p in c if _local(p) == "p") for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            yield page, k, "table", "\n".join("\t".join(r) for r in rows)


def _slides(parts: dict[str, bytes]) -> Iterator[tuple]:
    def number(name: str) -> int:
        return int("".join(c for c in name.rsplit("/", 1)[-1] if c.isdigit()) or 0)

    for folder, kind in (("ppt/slides/", "text"), ("ppt/notesSlides/", "speaker_notes")):
        for name in sorted((n for n in parts if n.startswith(folder) and n.count("/") == 2 and n.endswith(".xml")), key=number):
            root = _xml(parts[name])
            shapes = [] if root is None else [x for x in root.iter() if _local(x) in ("sp", "graphicFrame")]
            for k, shape in enumerate(shapes):
                title = any(_local(x) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter())
                said = "\n".join(_said(p) for p in shape.iter() if _local(p) == "p").strip()
                if said:
                    yield number(name), k, "title" if title and kind == "text" else "table" if _local(shape) == "graphicFrame" else kind, said


def office_elements(files: DataFrame) -> DataFrame:
    """(path, page, ordinal, kind, text) of .docx (page breaks) and .pptx (slides and notes); broken or oversized files give none."""

    def parse(path: str, raw: bytes) -> Iterator[tuple]:
        parts = _members(raw)
        return iter(()) if parts is None else _word(parts) if path.lower().endswith(".docx") else _slides(parts)

    return rows_of(files.where(F.lower("path").rlike(r"\.(docx|pptx)$")), parse, "page int, ordinal int, kind string, text string")


def _sheet_cells(raw: bytes | None, strings: list[str]) -> Iterator[tuple]:
    root = _xml(raw)
    for c in root.iter() if root is not None else []:
        if _local(c) != "c":
            continue
        children = {_local(x): x for x in c}
        kind, value = c.attrib.get("t", "n"), children["v"].text if "v" in children else None
        if kind == "s":
            value = strings[int(value)] if value is not None and value.isdigit() and int(value) < len(strings) else None
        elif kind == "inlineStr":
            value = _said(children["is"]) if "is" in children else None
        elif kind == "b":
            value = None if value is None else "true" if value == "1" else "false"
        kind = {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error", "n": "number", "d": "date"}.get(kind, "unknown")
        formula = children["f"].text if "f" in children else None
        if value is not None or formula is not None:
            yield c.attrib.get("r"), kind, value, formula


def sheet_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, name, cell, type, value, formula) of the cells of .xlsx files that hold something; a sheet is a page."""

    def parse(path: str, raw: bytes) -> Iterator[tuple]:
        parts = _members(raw) or {}
        shared = _xml(parts.get("xl/sharedStrings.xml"))
        strings = [] if shared is None else [_said(si) for si in shared if _local(si) == "si"]
        book, links = _xml(parts.get("xl/workbook.xml")), _xml(parts.get("xl/_rels/workbook.xml.rels"))
        target = {} if links is None else {x.attrib.get("Id"): x.attrib.get("Target", "") for x in links}
        sheets = [] if book is None else [x for x in book.iter() if _local(x) == "sheet"]
        for n, sheet in enumerate(sheets, 1):
            link = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            place = target.get(link, "")
            for cell in _sheet_cells(parts.get(place.lstrip("/") if place.startswith("/") else f"xl/{place}"), strings):
                yield (n, sheet.attrib.get("name"), *cell)

    return rows_of(files.where(F.lower("path").rlike(r"\.xlsx$")), parse, "sheet int, name string, cell string, type string, value string, formula string")


def _jpeg(raw: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        mark = raw[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 0x01:
            at += 1 if mark == 0xFF else 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def _tiff(raw: bytes) -> tuple[int, int] | None:
    order = "<" if raw[:2] == b"II" else ">"
    place = struct.unpack(order + "I", raw[4:8])[0]
    size: dict[int, int] = {}
    for k in range(struct.unpack(order + "H", raw[place : place + 2])[0]):
        entry = raw[place + 2 + 12 * k : place + 14 + 12 * k]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        if tag in (256, 257) and kind in (3, 4):
            size[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (size[256], size[257]) if len(size) == 2 else None


def _webp(raw: bytes) -> tuple[int, int] | None:
    if raw[12:16] == b"VP8X":
        return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
    if raw[12:16] == b"VP8L":
        bits = int.from_bytes(raw[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if raw[12:16] == b"VP8 " and raw[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", raw[26:30])
        return width & 0x3FFF, height & 0x3FFF
    return None


def image_size(raw: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) by the header alone; none if it isn't a known image or has no size."""
    try:
        found: tuple[str, tuple[int, int] | None] | None = None
        if raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR":
            found = "png", struct.unpack(">II", raw[16:24])
        elif raw[:6] in (b"GIF87a", b"GIF89a"):
            found = "gif", struct.unpack("<HH", raw[6:10])
        elif raw[:2] == b"BM":
            width, height = struct.unpack("<ii", raw[18:26])
            found = "bmp", (width, abs(height))
        elif raw[:4] in (b"II*\x00", b"MM\x00*"):
            found = "tiff", _tiff(raw)
        elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            found = "webp", _webp(raw)
        elif raw[:3] == b"\xff\xd8\xff":
            found = "jpeg", _jpeg(raw)
    except (struct.error, IndexError):
        return None
    return (found[0], *found[1]) if found and found[1] and min(found[1]) > 0 else None


def images(files: DataFrame) -> DataFrame:
    """(path, format, width, height) of image files; other files and broken headers give none."""

    def parse(path: str, raw: bytes) -> Iterator[tuple]:
        size = image_size(raw)
        yield from [size] if size else []

    return rows_of(files, parse, "format string, width int, height int")

"""Page quality: signals of broken extraction, a score, ordered reasons and a route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of reasons and the patterns must equal the reference's.
REASONS = (
    "missing_signals", "no_text", "extraction_residue", "nul_or_replacement_char", "garbled_text",
    "repeated_characters", "visual_heavy", "multi_column_hint", "table_hint", "formula_hint",
)
RESIDUE = (
    r"(?i)(?:^|\s)(?:xref|startxref|endobj|endstream)(?:\s|$)",
    r"(?i)(?:^|\s)(?:cid|glyph)[\s:#_-]*\d+(?:\s|$)",
    r"(?i)<\/?(?:div|span|font|page|text)(?:\s[^>]*)?>",
    r"(?i)\{\\(?:rtf|fonttbl|colortbl)\b",
)
MOJIBAKE = ("Ã", "Â", "â€", "â€™", "â€œ", "â€\ufffd", "ï»¿", "Ð", "Ñ")
REPEATED = (r"([^\s])\1{5,}", r"(?iu)(?<![\p{L}\p{N}_])([\p{L}\p{N}_]{2,}+)(?:[\s,;:|]++\1(?![\p{L}\p{N}_])){3}")
SIGNALS = ("page", "text", "image_count", "image_area_ratio", "vector_count", "multi_column_hint", "table_hint", "formula_hint")


def _count(text: Column, fragment: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(fragment), F.lit("")))) / len(fragment)).cast("int")


def _members(text: Column, members: str) -> Column:
    """Characters of a class, by what is left without them: no list of matches is made."""
    return F.length(text) - F.length(F.regexp_replace(text, members, ""))


def corruption(text: Column) -> Column:
    """Counts of bad characters, their share, and the share of symbols among visible characters."""
    nul = _count(text, "\x00") + _count(text, "\ufffd")
    controls = _members(text, r"[\p{Cc}&&[^\n\r\t]]")
    private = _members(text, r"[\p{Co}\p{Cs}]")
    mojibake = sum((_count(text, f) for f in MOJIBAKE), F.lit(0))
    bad = nul + controls + private + mojibake
    visible = F.length(text) - _members(text, r"(?U)\s")
    symbols = _members(text, r"[\p{P}\p{S}]")
    return F.struct(
        nul.alias("nul"), mojibake.alias("mojibake"), bad.alias("bad"),
        (bad / F.greatest(F.length(text), F.lit(1))).alias("bad_ratio"), F.when(visible > 0, symbols / visible).otherwise(0.0).alias("symbol_ratio"),
    )


def assess(rows: DataFrame, c: dict[str, Column]) -> DataFrame:
    """The rows with score (in 1/10000), reasons and route, for the signals by name; a missing one is null.

    Patterns are searched once, in a projection of their own.
    """
    missing = F.lit(False)
    for name in SIGNALS:
        missing = missing | c[name].isNull()
    text = F.coalesce(c["text"], F.lit(""))
    residue = F.lit(False)
    for p in RESIDUE:
        residue = residue | text.rlike(p)
    seen = {
        "missing": missing, "length": F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), "stats": corruption(text), "residue": residue, "repeated": text.rlike(REPEATED[0]) | text.rlike(REPEATED[1]),
        **{n: F.coalesce(c[n], F.lit(0)) for n in ("image_count", "image_area_ratio", "vector_count")}, **{n: F.coalesce(c[n], F.lit(False)) for n in ("multi_column_hint", "table_hint", "formula_hint")},
    }
    rows = rows.select("*", F.struct(*[v.alias(k) for k, v in seen.items()]).alias("_seen"))
    s = {k: F.col(f"_seen.{k}") for k in seen}
    bad = F.col("_seen.stats.bad_ratio")
    hint = {n: s[n] for n in ("multi_column_hint", "table_hint", "formula_hint")}
    length, images, area, vectors = s["length"], s["image_count"], s["image_area_ratio"], s["vector_count"]
    fires = {
        "missing_signals": s["missing"],
        "no_text": length == 0,
        "extraction_residue": (length > 0) & s["residue"],
        "nul_or_replacement_char": F.col("_seen.stats.nul") > 0,
        "garbled_text": (F.col("_seen.stats.mojibake") >= 1) | (bad >= 0.01) | ((length >= 24) & (F.col("_seen.stats.symbol_ratio") >= 0.55) & ~hint["formula_hint"]),
        "repeated_characters": (length > 0) & s["repeated"],
        "visual_heavy": (area >= 0.45) | (images >= 3) | ((images >= 1) & (area >= 0.25) & (length < 120)) | ((vectors >= 100) & (length < 160)),
        **hint,
    }
    penalty = {
        "no_text": F.lit(0.85), "extraction_residue": F.lit(0.25), "nul_or_replacement_char": F.least(F.lit(0.60), 0.20 + bad * 5), "garbled_text": F.least(F.lit(0.50), 0.25 + bad * 4),
        "repeated_characters": F.lit(0.20), "visual_heavy": F.lit(0.12), "multi_column_hint": F.lit(0.08), "table_hint": F.lit(0.05), "formula_hint": F.lit(0.05),
    }
    score = F.lit(1.0)
    for name, cost in penalty.items():
        score = score - F.when(fires[name], cost).otherwise(0.0)
    score = F.least(F.when(s["missing"], 0.25).otherwise(1.0), F.greatest(F.lit(0.0), score))
    reasons = F.filter(F.array(*[F.when(fires[r], F.lit(r)) for r in REASONS]), lambda r: r.isNotNull())
    rows = rows.withColumn("score", F.round(score * 10000).cast("long")).withColumn("reasons", reasons)
    evidence = (images > 0) | (area > 0) | (vectors > 0) | hint["multi_column_hint"] | hint["table_hint"] | hint["formula_hint"]
    route = F.when(s["missing"], "review").when(length == 0, F.when(evidence, "recover").otherwise("review")).when(F.size("reasons") > 0, "recover").otherwise("fast")
    return rows.withColumn("route", route).drop("_seen")


def merge_quality(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column, Column]:
    """The lower score, the worse route, and all reasons, known ones in their order and others sorted."""
    rank = lambda r: F.when(r == "review", 2).when(r == "recover", 1).otherwise(0)
    both = F.array_union(a["reasons"], b["reasons"])
    order = F.array(*[F.lit(r) for r in REASONS])
    reasons = F.concat(F.filter(order, lambda r: F.array_contains(both, r)), F.array_sort(F.array_except(both, order)))
    return F.least(a["score"], b["score"]), reasons, F.when(rank(a["route"]) >= rank(b["route"]), a["route"]).otherwise(b["route"])

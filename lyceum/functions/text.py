"""Text expressions: tokens, cleaning, normal forms, trigrams, keys. All are Catalyst expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# They must equal the reference's for equal results.
CJK = "぀-ヿ㐀-䶿一-鿿"
TOKEN = rf"[a-z0-9][a-z0-9\-']*|[{CJK}]+"
STOPWORDS = (
    "a an the is are was were be been being am do does did doing have has had having will would "
    "shall should can could may might must of in on at by for with about against between into "
    "through to from up down out off over under again and or but not no nor so than too very "
    "what which who whom whose when where why how this that these those it its he she they them "
    "him his her hers their theirs you your yours we our ours i me my mine us if as then there "
    "here also just please tell say says said give gives show shows explain define describe"
).split()
HTML_TAG = r"(?i)</?(?:div|span|p|br|img|table|tr|td|th|ul|ol|li|a|b|i|em|strong)\b[^>]*>"
CSS_RULE = r"(?:^|\s)[\w.#][\w.#\-, >]{0,60}\{\s*(?:[a-zA-Z-]+\s*:\s*[^{};:]{1,80};?\s*){1,8}\}"
CSS_HEAD = 2048


def tokenize(text: Column) -> Column:
    """Lower-cased words, and character pairs of each CJK run (a lone character stays)."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    is_cjk = lambda x: x.rlike(f"^[{CJK}]+$") & (F.length(x) > 1)
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda x: F.when(is_cjk(x), pairs(x)).otherwise(F.array(x))))


def informative(tokens: Column) -> Column:
    """Tokens without function words; repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def clean_text(text: Column) -> Column:
    """Without mark-up tags, without style rules in the head, with blanks and blank lines collapsed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), HTML_TAG, " ")
    head = F.regexp_replace(F.substring(t, 1, CSS_HEAD), CSS_RULE, " ")
    t = F.concat(head, F.substr(t, F.lit(CSS_HEAD + 1)))
    t = F.regexp_replace(t, "[ \t　]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def composed(text: Column) -> Column:
    """Unicode form NFC; only texts with a character from U+0300 on, which alone can change, leave the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike("[^\\x00-\\u02ff]"), text)), text)


def folded(text: Column) -> Column:
    """Case-folded; texts of ASCII, where that is lower case, stay in the JVM."""
    return F.coalesce(_casefold(F.when(text.rlike("[^\\x00-\\x7f]"), text)), F.lower(text))


def normalize_exact(text: Column) -> Column:
    """Composed, with line ends and white space folded to single blanks."""
    return F.trim(F.regexp_replace(composed(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def normalize_near(text: Column) -> Column:
    return folded(normalize_exact(text))


def trigrams(text: Column) -> Column:
    """Character trigrams with repeats; a shorter text is its own only one."""
    n = F.length(text)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n < 3, F.array(text))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))
    )


def chapter_key(value: Column, *, allow_phase: bool = False) -> Column:
    """`3`, `"03"`, `ch03`, `chapter-3` (and `phase 3`) as "3", else null."""
    prefix = r"(?:ch(?:apter)?|phase)?" if allow_phase else r"(?:ch(?:apter)?)?"
    digits = F.regexp_extract(F.lower(F.trim(value.cast("string"))), rf"^{prefix}[\s_-]*0*([0-9]+)$", 1)
    return F.when(digits != "", digits)


def snippet(text: Column, tokens: Column, width: int = 240) -> Column:
    """A window around the first place of the first token, in token order, that the text holds."""
    low = F.lower(text)
    places = F.filter(F.transform(tokens, lambda t: F.instr(low, t)), lambda p: p > 0)
    at = F.when(F.size(places) > 0, F.element_at(places, 1) - 1).otherwise(0)
    start = F.greatest(F.lit(0), at - width // 4)
    return F.trim(F.regexp_replace(F.substring(text, start + 1, F.lit(width)), r"\s+", " "))


def slug(text: Column) -> Column:
    """Heading anchor: lower case, letters, digits, `_` and `-` kept, blanks to `-`."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\p{L}\p{N}_\-\s]", ""), r"\s", "-")


def media_type(path: Column) -> Column:
    """MIME type by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = {
        "pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "csv": "text/csv", "tsv": "text/tab-separated-values", "html": "text/html",
        "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp",
        "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "json": "application/json",
    }
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def canonical_tokens(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


# Words and patterns of the language evidence.
ENGLISH_PROSE = (
    "the a an and or of to in for with from by is are was were what which why how find calculate compute "
    "determine derive explain show prove given assume using answer solution true false"
).split()
ENGLISH_LABELS = "chapter section example quiz problem overview course note parser output".split()
FORMULA_PROSE = "if where otherwise use let be when then else such that equals result case".split()
MATH_WORDS = "sin cos tan log ln exp min max lim det rank arg argmin argmax var cov dx dy dt".split()
NEUTRAL_KINDS = ("text", "list", "table", "formula", "question", "answer", "other")
HAN = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
MATH_SIGNAL = r"\\[A-Za-z]+|[0-9=+*/^<>≤≥∑∏∫√±×÷≠≈∈∉⊂⊆⊃⊇∅∀∃∪∩(){}\[\]|_]"
TEX_PROSE = r"(?i)\\(?:text|textrm|textsf|texttt|textnormal|mbox)\s*\{"
TEX_COMMAND = r"\\(?:begin|end)\{[A-Za-z*]+\}|\\[A-Za-z]+"


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def neutral_formula(text: Column, latex: Column, kind: Column) -> Column:
    """Whether there is nothing but formula: no prose words, and a formula's kind, source or symbols."""
    has_latex = F.length(F.trim(F.coalesce(latex, F.lit("")))) > 0
    value = F.concat_ws("\n", F.when(F.length(F.trim(text)) > 0, text), F.when(has_latex, latex))
    is_formula = F.coalesce(kind == "formula", F.lit(False))
    symbolic = value.rlike(MATH_SIGNAL) & (is_formula | has_latex)
    tokens = F.regexp_extract_all(F.regexp_replace(value, TEX_COMMAND, ""), F.lit("[A-Za-z]+"), F.lit(0))

    def allowed(t: Column) -> Column:
        low = F.lower(t)
        prose = F.array_contains(_words(ENGLISH_PROSE + FORMULA_PROSE), low)
        short = F.length(t) <= 4
        return (F.length(t) == 1) | (~prose & (F.array_contains(_words(MATH_WORDS), low) | ((t == F.upper(t)) & short) | (symbolic & (t == low) & short)))

    plain = ~value.rlike(HAN) & ~value.rlike(TEX_PROSE) & F.forall(tokens, allowed)
    known = kind.isNull() | kind.isin(*NEUTRAL_KINDS)
    return known & (value != "") & plain & (is_formula | has_latex | value.rlike(MATH_SIGNAL))


def language_evidence(text: Column, latex: Column | None = None, kind: Column | None = None) -> Column:
    """zh, mixed, zxx (formula only), en or unknown."""
    latex = F.lit(None).cast("string") if latex is None else latex
    kind = F.lit(None).cast("string") if kind is None else kind
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    prose = F.arrays_overlap(words, _words(ENGLISH_PROSE))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "unknown")
        .when(text.rlike(HAN), F.when((letters >= 3) & prose, "mixed").otherwise("zh"))
        .when(neutral_formula(text, latex, kind), "zxx")
        .when(F.arrays_overlap(words, _words(ENGLISH_PROSE + ENGLISH_LABELS)), "en")
        .otherwise("unknown")
    )

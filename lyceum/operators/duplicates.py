"""Exact and near duplicates, canonical groups, cross-source conflicts and folding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions.text import normalize_exact, normalize_near
from lyceum.session import stored

# Scale, threshold, shortest text, order of conflicts, patterns.
SCALE, THRESHOLD, MIN_CHARS = 1_000_000, 920_000, 24
CONFLICT_ORDER = ("answer_mismatch", "boolean_mismatch", "numeric_mismatch", "formula_mismatch", "visual_context_mismatch", "provenance_mismatch", "textual_divergence")
NUMBER = r"(?<![\w.])[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w.])"
TRUTH = r"\btrue\b|\bfalse\b|\byes\b|\bno\b|\bnot\b|\bnever\b|\balways\b|正确|错误|是|否|不|无|从不|总是"
FORMULA_TOKEN = r"\\[A-Za-z]+|[A-Za-z]+|\d+(?:\.\d+)?|[^\s]"
LABEL = r"(?i)^\s*(?:theorem|lemma|proposition|corollary|definition|example|quiz|section|figure|fig\.?|table|equation)\s+\d+(?:\s*\.\s*\d+)*(?:\s*[:.\-])?\s*"
KIND_FAMILY = {
    "title": "heading", "heading": "heading", "text": "concept", "list": "concept", "caption": "concept", "speaker_notes": "concept", "formula": "formula", "question": "question",
    "answer": "answer", "table": "table", "code": "code", "figure": "visual", "diagram": "visual", "other": "other", "page_anchor": "other",
}

#: Trigrams of the texts of a tile and of a part of it that is counted in full, most bits of a bin's number, bins summed in 16 bits, texts that one pass compares with a text.
TILE, COUNTED, MAX_BITS, STRIP, COLUMNS = 24_000_000, 1_000_000, 14, 256, 1024
#: Rows (part of a tile, pair of tiles; ids of candidates) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def kind_family(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_FAMILY.items() for x in kv]), kind)


def source_side(kind: Column, role: Column) -> Column:
    return (
        F.when(role == "student_attempt", "attempt")
        .when((kind == "question") | (role == "question_context"), "prompt")
        .when((kind == "answer") | role.isin("answer_context", "worked_solution"), "answer")
        .otherwise("teaching")
    )


def compatibility_key(u: dict[str, Column]) -> Column:
    """Blocking key: chapter, family, side and provenance class as one JSON text."""
    provenance = F.when(u["provenance"] == "ai_supplemented", "ai_supplemented").otherwise("source_backed")
    number = F.lpad(F.regexp_extract(u["chapter_id"], r"^ch0*([0-9]+)$", 1), 2, "0")
    chapter = F.when(number != "", F.concat(F.lit("ch"), number))
    parts = F.struct(chapter.alias("chapter_id"), kind_family(u["kind"]).alias("kind_family"), provenance.alias("provenance_class"), source_side(u["kind"], u["asset_role"]).alias("source_side"))
    return F.to_json(parts, {"ignoreNullFields": "false"})


def exact_fingerprint(text: Column) -> Column:
    return F.sha2(normalize_exact(text), 256)


def identities(units: DataFrame) -> DataFrame:
    """(unit_id, block, fingerprint) of units (unit_id, kind, text, chapter_id, provenance, asset_path, asset_role, asset_sha256, paired_unit_id).

    The fingerprint covers the text, the asset and, of a question, what its paired answer is: bound
    with that answer's own fingerprint, missing, or none. The block is the compatibility key, so
    units of other chapters, sides or origins never meet.
    """
    asset = F.to_json(F.struct("asset_path", "asset_role", "asset_sha256"))
    rows = units.withColumn("own", F.sha2(F.concat_ws("\x1f", normalize_exact(F.col("text")), asset), 256))
    answers = rows.where("kind = 'answer'").select(F.col("unit_id").alias("paired_unit_id"), F.col("own").alias("bound"))
    both = rows.join(answers, "paired_unit_id", "left")
    pairing = F.when(F.col("paired_unit_id").isNull(), "unpaired").when(F.col("bound").isNotNull(), F.col("bound")).otherwise(F.concat(F.lit("missing:"), "paired_unit_id"))
    key = compatibility_key({c: F.col(c) for c in ("kind", "asset_role", "provenance", "chapter_id")})
    return both.select("unit_id", key.alias("block"), F.when(F.col("kind") == "question", F.sha2(F.concat_ws("\x1f", "own", pairing), 256)).otherwise(F.col("own")).alias("fingerprint"))


def exact_groups(units: DataFrame, block: str, unit_id: str = "unit_id", text: str = "text") -> DataFrame:
    """(block, fingerprint, members, display): units of one block with equal normal texts, two or more."""
    rows = units.select(F.col(block).alias("block"), F.col(unit_id).alias("unit_id"), exact_fingerprint(F.col(text)).alias("fingerprint"), normalize_near(F.col(text)).alias("near"))
    groups = rows.where("near <> ''").groupBy("block", "fingerprint").agg(F.array_sort(F.collect_set("unit_id")).alias("members"))
    return groups.where(F.size("members") >= 2).withColumn("display", F.element_at("members", 1))


def star_pairs(rows: DataFrame, keys: list[str], unit_id: str = "unit_id") -> DataFrame:
    """The least unit of each group with each other one; sums of groups meet the rows again, so a large group isn't gathered."""
    first = rows.groupBy(*keys).agg(F.min(unit_id).alias("left_id"))
    return rows.join(first, keys).where(F.col(unit_id) > F.col("left_id")).select(*keys, "left_id", F.col(unit_id).alias("right_id"))


def _gram_codes(text: str) -> np.ndarray:
    """Codes of the character trigrams of a text of three characters or more, with repeats."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]


def _bins(n: int) -> int:
    """Bins of the sketch of a text of n trigrams: a power of two, about a sixth of n."""
    return 1 << min(max((max(n, 1) // 8).bit_length(), 5), MAX_BITS)


def _sketch(codes: np.ndarray, bins: int) -> bytes:
    """Trigrams by bin, up to 255 each: two texts differ in them by no more than in their trigrams."""
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    return np.minimum(np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., n, bins, sketch) in place of the last column, `near`; none for texts that are too short."""
    for batch in batches:
        n, bins, out = [], [], []
        for near in batch.column("near").to_pylist():
            n.append(len(near) - 2 if near is not None else None)
            bins.append(_bins(n[-1]) if near is not None else None)
            out.append(_sketch(_gram_codes(near), bins[-1]) if near is not None else None)
        names = [c for c in batch.schema.names if c != "near"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(bins, pa.int32()), pa.array(out, pa.binary())], [*names, "n", "bins", "sketch"])


def _tiles(texts: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(block, bins, cell, tile, parts), and (block, tile, part, tp, side): which pairs of tiles the texts of a tile's part visit, as side 0 or 1, or 2 where they meet themselves.

    A tile holds the texts of some neighbouring sizes, in parts by hash where they are too many for
    one. Each part meets itself and all parts of whose sizes some reach the threshold with its own.
    """
    cells = texts.groupBy("block", "bins", "cell").agg(F.sum(F.greatest("n", F.lit(256))).alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    before = Window.partitionBy("block", "bins").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    cells = stored(cells.withColumn("tile", F.struct("bins", F.expr(f"before div {TILE}").alias("k"))))
    tiles = cells.groupBy("block", "tile").agg(F.expr(f"(sum(size) - 1) div {TILE} + 1").alias("parts"), F.min("least").alias("least"), F.max("most").alias("most"))
    parts = tiles.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x, y = parts.alias("x"), parts.alias("y")
    ordered = F.struct("x.tile", "x.part") <= F.struct("y.tile", "y.part")
    reach = F.col("y.least") <= F.expr(f"(2 * x.most * {SCALE}) div {threshold} - x.most")
    met = x.join(y, (F.col("x.block") == F.col("y.block")) & ordered & reach).select(F.col("x.block").alias("block"), *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "xy" for c in ("tile", "part")])
    met = stored(met.withColumn("tp", F.monotonically_increasing_id()))
    itself = F.expr("x_tile = y_tile and x_part = y_part")
    side = lambda p, rows, k: rows.select("block", F.col(f"{p}_tile").alias("tile"), F.col(f"{p}_part").alias("part"), "tp", k.cast("int").alias("side"))
    visits = side("x", met, F.when(itself, 2).otherwise(0)).unionByName(side("y", met.where(~itself), F.lit(1)))
    cells = cells.join(tiles.select("block", "tile", "parts"), ["block", "tile"]).select("block", "bins", "cell", "tile", "parts")
    return cells, F.broadcast(visits) if met.count() <= BROADCAST_ROWS else visits


def _columns(side: pa.Table, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, sketches [bin, text]) of texts of one number of bins, folded to `bins`."""
    found = np.frombuffer(b"".join(side.column("sketch").to_pylist()), np.uint8).reshape(side.num_rows, -1).astype(np.uint16)
    while found.shape[1] > bins:
        found = np.minimum(found[:, : found.shape[1] // 2] + found[:, found.shape[1] // 2 :], 255)
    return side.column("n").to_numpy(), np.ascontiguousarray(found.T)


def _listed(group: pa.Table, left: np.ndarray, right: np.ndarray, strip: int) -> pa.Table:
    """(tp, strip, block, unit_id, digest, place, with): the texts of some pairs of places, and for each one on the left the places, in this list, of those on the right; `left` ascends."""
    used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    sizes = np.bincount(at[: len(left)], minlength=len(used))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(at[len(left) :]))
    rows = group.take(pa.array(used))
    names = ("tp", "block", "unit_id", "digest")
    return pa.Table.from_arrays([*(rows.column(c) for c in names), pa.array(np.full(len(used), strip)), pa.array(np.arange(len(used))), lists], [*names, "strip", "place", "with"])


def _candidates(threshold: int):  # noqa: ANN202
    """For the texts of two tiles: those whose sketches allow the threshold, as _listed; strips bound what is counted at once."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("n", "ascending")])
        sides = group.column("side").to_numpy()
        alone, cut = sides[0] == 2, int(np.searchsorted(sides, 1))
        own, other = (group, group) if alone else (group.slice(0, cut), group.slice(cut))
        place, partners = [], []
        if own.num_rows and other.num_rows:
            bins = min(own.column("bins")[0].as_py(), other.column("bins")[0].as_py())
            (n, a), (m, b) = _columns(own, bins), _columns(other, bins)
            sums_a, sums_b = a.sum(0, dtype=np.int64), b.sum(0, dtype=np.int64)
            low = np.searchsorted(m, -(-n * threshold // (2 * SCALE - threshold)), "left")
            high = np.searchsorted(m, n * (2 * SCALE - threshold) // threshold, "right")
            spare = np.empty((min(bins, STRIP), COLUMNS), np.uint16)
            for i in range(len(n)):
                found = []
                for start in range(max(low[i], i + 1) if alone else low[i], high[i], COLUMNS):
                    stop = min(start + COLUMNS, high[i])
                    both = np.zeros(stop - start, np.int64)
                    for k in range(0, bins, STRIP):
                        least = np.minimum(b[k : k + STRIP, start:stop], a[k : k + STRIP, i, None], out=spare[:, : stop - start])
                        both += least.sum(0, dtype=np.uint16)
                    apart = sums_a[i] + sums_b[start:stop] - 2 * both
                    found.append(start + np.flatnonzero(apart * SCALE <= (SCALE - threshold) * (n[i] + m[start:stop])))
                found = np.concatenate(found) if found else np.zeros(0, np.int64)
                if len(found):
                    place.append(i)
                    partners.append(found if alone else found + cut)
        left = np.repeat(np.array(place, np.int64), [len(f) for f in partners])
        right = np.concatenate([np.zeros(0, np.int64), *partners])
        strip = np.cumsum(group.column("n").to_numpy()) // COUNTED
        key = strip[left] * (strip.max() + 1) + strip[right]
        out = [_listed(group, left[key == k], right[key == k], int(k)) for k in np.unique(key)]
        return pa.concat_tables(out or [_listed(group, left, right, 0)])

    return run


def _scored(threshold: int):  # noqa: ANN202
    """(block, x, y, score_ppm) of the pairs at the threshold among the candidates of two tiles, by all trigrams."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        counts = [np.unique(_gram_codes(near), return_counts=True) for near in group.column("near").to_pylist()]
        first = np.cumsum([0, *(len(c[0]) for c in counts)])
        grams, code = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
        times = np.concatenate([c[1] for c in counts])
        n = np.add.reduceat(times, first[:-1])
        own, left, right, score = np.zeros(len(grams), np.int64), [], [], []
        lists = group.column("with").combine_chunks()
        ends, partners = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i in np.flatnonzero(np.diff(ends)):
            ys = partners[ends[i] : ends[i + 1]]
            mine = slice(first[i], first[i + 1])
            own[code[mine]] = times[mine]
            for at in (ys[k : k + 256] for k in range(0, len(ys), 256)):
                sizes = first[at + 1] - first[at]
                begins = np.cumsum(sizes) - sizes
                place = np.arange(int(sizes.sum())) + np.repeat(first[at] - begins, sizes)
                ppm = 2 * SCALE * np.add.reduceat(np.minimum(own[code[place]], times[place]), begins) // (n[i] + n[at])
                good = ppm >= threshold
                left.append(np.full(good.sum(), i))
                right.append(at[good])
                score.append(ppm[good])
            own[code[mine]] = 0
        left, right, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right, score))
        unit = group.column("unit_id")
        return pa.Table.from_arrays([group.column("block").take(pa.array(left)), unit.take(pa.array(left)), unit.take(pa.array(right)), pa.array(score)], ["block", "x", "y", "score_ppm"])

    return run


def _among(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows whose `name` is among `ids`, where they lie if these are few."""
    ids = stored(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, name, "left_semi")


def near_pairs(units: DataFrame, block: str, unit_id: str = "unit_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(block, left_id, right_id, match_kind, score_ppm).

    Star pairs for equal texts (`exact`) and for equal normal texts of unequal fingerprints
    (`near`, a million), then pairs whose multisets of character trigrams have a Dice similarity of
    the threshold at least. Texts of a block meet in pairs of tiles of such lengths that allow the
    threshold. Each has a sketch, its trigrams by bin; two sketches differ by no more than the
    trigrams do, so pairs whose sketches are too far apart are none. All others are counted in
    full, over all their trigrams; nothing is capped.
    """
    units = units.select(F.col(block).alias("block"), F.col(unit_id).alias("unit_id"), F.col(text).alias("text"))
    near = normalize_near(F.col("text"))
    normal = units.select("block", "unit_id", exact_fingerprint(F.col("text")).alias("fingerprint"), near.alias("near")).where("near <> ''")
    normal = normal.select("block", "unit_id", "fingerprint", F.sha2("near", 256).alias("digest"), F.when(F.length("near") >= max(min_chars, 3), F.col("near")).alias("near"))
    kinds = {c: normal.schema[c].dataType.simpleString() for c in ("unit_id", "block")}
    shape = f"block {kinds['block']}, unit_id {kinds['unit_id']}, fingerprint string, digest string"
    rows = stored(normal.mapInArrow(_sketches, f"{shape}, n long, bins int, sketch binary"))  # every text is normalised once
    kind = lambda df, name: df.select("block", "left_id", "right_id", F.lit(name).alias("match_kind"), F.lit(SCALE).cast("long").alias("score_ppm"))
    exact = kind(star_pairs(rows, ["block", "fingerprint"]), "exact")
    reps = rows.groupBy("block", "fingerprint", "digest").agg(F.min("unit_id").alias("unit_id"))
    same = kind(star_pairs(reps, ["block", "digest"]), "near")
    # One row for each normal text; its copies have the same sketch.
    texts = rows.where("block is not null and n is not null").groupBy("block", "digest").agg(F.min("unit_id").alias("unit_id"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("sketch").alias("sketch"))
    texts = stored(texts.withColumn("cell", F.floor(F.log2("n") * 32)))
    cells, visits = _tiles(texts, threshold)
    placed = texts.join(F.broadcast(cells), ["block", "bins", "cell"]).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    placed = placed.join(visits, ["block", "tile", "part"]).select("tp", "side", "block", "unit_id", "digest", "n", "bins", "sketch")
    shape = f"tp long, block {kinds['block']}, unit_id {kinds['unit_id']}, digest string, strip long, place long, with array<bigint>"
    held = stored(placed.groupBy("tp").applyInArrow(_candidates(threshold), shape))
    # The texts of candidates are read again; a repeated id may have other texts, which their digests tell apart.
    wanted = held.select("unit_id", "digest").distinct()
    again = _among(units, wanted.select("unit_id"), "unit_id").select("unit_id", near.alias("near")).withColumn("digest", F.sha2("near", 256))
    again = again.join(wanted, ["unit_id", "digest"]).groupBy("unit_id", "digest").agg(F.first("near").alias("near"))
    scored = held.join(again, ["unit_id", "digest"]).select("tp", "strip", "block", "unit_id", "near", "place", "with").groupBy("tp", "strip").applyInArrow(_scored(threshold), f"block {kinds['block']}, x {kinds['unit_id']}, y {kinds['unit_id']}, score_ppm long")
    close = scored.select("block", F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), F.lit("near").alias("match_kind"), "score_ppm")
    return exact.unionByName(same).unionByName(close)


def numeric_tokens(text: Column) -> Column:
    """Numbers that a text claims, without the number of a leading label."""
    return F.regexp_extract_all(F.regexp_replace(normalize_near(text), LABEL, ""), F.lit(NUMBER), F.lit(0))


def truth_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_near(text), F.lit(TRUTH), F.lit(0))


def formula_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_exact(text), F.lit(FORMULA_TOKEN), F.lit(0))


def conflicts(pairs: DataFrame, units: DataFrame, priorities: DataFrame | None = None) -> DataFrame:
    """Pairs of different sources with their signals, the first of them by priority, and the preferred side.

    `units` is (unit_id, source, text, kind), `priorities` (source, rank); a source without a rank has 0.
    """
    # What is compared is derived once for each unit, so that pairs carry digests and no texts.
    pairs, text = stored(pairs), F.col("text")
    digest = lambda tokens: F.sha2(F.to_json(tokens), 256)
    kinds = units.select(F.col("unit_id").alias("left_id"), (F.col("kind") == "answer").alias("answers"), (kind_family(F.col("kind")) == "formula").alias("formulas"))
    asked = pairs.join(kinds, "left_id").select(F.explode(F.array("left_id", "right_id")).alias("unit_id"), "answers", "formulas")
    asked = stored(asked.groupBy("unit_id").agg(F.max("answers").alias("answers"), F.max("formulas").alias("formulas")))
    held = units.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "unit_id").select(
        "unit_id", "source", "kind", F.when(F.col("answers"), F.sha2(normalize_near(text), 256)).alias("near"), digest(truth_tokens(text)).alias("truth"),
        digest(numeric_tokens(text)).alias("numbers"), F.when(F.col("formulas"), digest(formula_tokens(text))).alias("formula"),
    )
    held = stored(held)
    side = lambda p: held.select(*[F.col(c).alias(f"{p}_{c}") for c in held.columns])
    both = pairs.join(side("l"), F.col("left_id") == F.col("l_unit_id")).join(side("r"), F.col("right_id") == F.col("r_unit_id")).where(~F.col("l_source").eqNullSafe(F.col("r_source")))
    other = lambda c: F.col(f"l_{c}") != F.col(f"r_{c}")
    signals = F.array(
        F.when((F.col("l_kind") == "answer") & other("near"), "answer_mismatch"), F.when(other("truth"), "boolean_mismatch"), F.when(other("numbers"), "numeric_mismatch"),
        F.when((kind_family(F.col("l_kind")) == "formula") & other("formula"), "formula_mismatch"),
    )
    signals = F.filter(signals, lambda s: s.isNotNull())
    out = both.select("left_id", "right_id", "l_source", "r_source", "score_ppm", "match_kind", signals.alias("signals"))
    out = out.where((F.size("signals") > 0) | (F.col("match_kind") == "near")).withColumn("kind", F.when(F.size("signals") > 0, F.element_at("signals", 1)).otherwise("textual_divergence"))
    if priorities is None:
        return out
    rank = lambda p: priorities.select(F.col("source").alias(f"{p}_source"), F.col("rank").alias(f"{p}_rank"))
    out = out.join(rank("l"), "l_source", "left").join(rank("r"), "r_source", "left")
    l_rank, r_rank = F.coalesce("l_rank", F.lit(0)), F.coalesce("r_rank", F.lit(0))
    return out.withColumn("preferred", F.when(l_rank > r_rank, F.col("left_id")).when(r_rank > l_rank, F.col("right_id")))


def fold(units: DataFrame, groups: DataFrame, unit_id: str = "unit_id") -> DataFrame:
    """Units without the hidden members of groups; a shown one lists the others."""
    hidden = groups.select(F.explode(F.array_except("members", F.array("display"))).alias(unit_id))
    shown = groups.select(F.col("display").alias(unit_id), F.array_except("members", F.array("display")).alias("aliases"))
    none = F.array().cast(shown.schema["aliases"].dataType)
    return units.join(hidden, unit_id, "left_anti").join(shown, unit_id, "left").withColumn("aliases", F.coalesce("aliases", none))


def group_violations(groups: DataFrame) -> DataFrame:
    """Members of more than one group, and groups of fewer than two."""
    each = groups.select("fingerprint", F.explode("members").alias("unit_id")).groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1")
    overlap = each.select(F.lit("group_overlap").alias("rule"), F.col("unit_id").cast("string").alias("key"))
    return overlap.unionByName(groups.where(F.size("members") < 2).select(F.lit("group_too_small").alias("rule"), F.col("fingerprint").alias("key")))

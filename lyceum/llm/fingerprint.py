"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle of WIDTH bytes is hashed once; the top bits of the hash choose one of BINS bins and a
bin keeps its least hash. An empty bin borrows from the bin that a fixed sequence of draws for it
reaches first (2-universal draws, so borrowed bins are spread evenly). Of every bin LOW_BITS bits
are stored, and the share of equal bins is corrected for bits that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import few, mix64, running_sums, saved, window_hashes

#: Bytes of a shingle (a shorter text is one shingle), bins, stored bits of a bin (at most 8).
WIDTH, BINS, LOW_BITS = 12, 256, 8
#: Bytes of text of a range of ids; from RANGES ranges on they grow instead, up to WIDE_BYTES, and then their number grows again.
RANGE_BYTES, RANGES, WIDE_BYTES = 1 << 24, 4_096, 1 << 28
#: Sampled rows for each range, of which every so many-th is the first row of one.
SAMPLE = 16

_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_PIECE = 1 << 19


def _bin_mins(raw: bytes) -> np.ndarray:
    """The least hash of each bin, all ones where it is empty."""
    out = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    data = np.frombuffer(raw, np.uint8)
    last = max(len(data) - WIDTH + 1, 1)
    for lo in range(0, last, _PIECE):
        part = data[lo : min(lo + _PIECE, last) + WIDTH - 1]
        starts = np.arange(min(_PIECE, last - lo))
        h = window_hashes(part, starts, np.minimum(starts + WIDTH, len(part)))
        h.sort()
        bins = (h >> _BIN_SHIFT).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out[bins[first]] = np.minimum(out[bins[first]], h[first])
    return out


def _densified(mins: np.ndarray) -> np.ndarray:
    full = mins != np.uint64(0xFFFFFFFFFFFFFFFF)
    if full.all():
        return mins
    out, held = mins.copy(), np.flatnonzero(full)
    if len(held) == 1:
        out[:] = mins[held[0]]
        return out
    empty, draw = np.flatnonzero(~full), 0
    while len(empty):
        draw += 1
        probe = (mix64(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(draw * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> _BIN_SHIFT).astype(np.int64)
        hit = full[probe]
        out[empty[hit]] = mins[probe[hit]]
        empty = empty[~hit]
    return out


def fingerprint(raw: bytes) -> bytes:
    """Packed fingerprint of a text's UTF-8 bytes; nothing for an empty text."""
    if not raw:
        return b""
    low = (mix64(_densified(_bin_mins(raw))) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, None], axis=1)[:, 8 - LOW_BITS :]
    return np.packbits(bits).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated similarity of two shingle sets, 0 to 1; two empty texts are alike."""
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(BINS, LOW_BITS)
    agree, chance = 1 - x.any(axis=1).mean(), 0.5**LOW_BITS
    return float(min(1.0, max(0.0, (agree - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _distinct(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, mark, n): the different rows with their number, in the order of key and mark: descending ids, null last, and a hash of the text.

    Only rows that are repeated meet by their text, counted before the shuffle.
    """
    key = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key).withColumn("mark", F.xxhash64("text"))
    again, small = few(rows.groupBy("key", "mark").count().where("count > 1").select("key", "mark"))
    if again.isEmpty():
        return rows.withColumn("n", F.lit(1).cast("long"))
    again = F.broadcast(again) if small else again
    once = rows.join(again, ["key", "mark"], "left_anti").withColumn("n", F.lit(1).cast("long"))
    many = rows.join(again, ["key", "mark"], "left_semi").groupBy("doc_id", "text", "key", "mark").agg(F.count("*").alias("n"))
    return once.select("doc_id", "text", "key", "mark", "n").unionByName(saved(many))


def _ranges(rows: DataFrame) -> DataFrame:
    """`rows` dealt to one partition for each range of (key, mark), with `part`; the first row of each range is repeated as a guest of the range before it.

    Ranges begin at even steps through a sample of SAMPLE rows for each, drawn by hash, so the
    same on every run; it is put in order by ranges itself, and only the limits reach the driver.
    """
    n, size, top = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long")), F.min(F.struct("key", "mark"))).first()
    count = max(1, min((size or 0) // RANGE_BYTES, max(RANGES, (size or 0) // WIDE_BYTES)))
    found: list = []
    if count > 1:
        place = F.shiftrightunsigned(F.xxhash64("key", "mark"), 11) / F.lit(float(1 << 53))
        sample = rows.where(place < SAMPLE * count / n).select(F.lit(0).alias("all"), "key", "mark", F.lit(1).cast("long").alias("one"))
        steps = running_sums(sample, "all", ["key", "mark"], "one").where((F.col("before") > 0) & (F.col("before") % SAMPLE == 0))
        found = sorted({(r["key"], r["mark"]) for r in steps.select("key", "mark").collect()} - {(top["key"], top["mark"])})
    limits = rows.sparkSession.sparkContext.broadcast(np.array(found, np.int64).reshape(-1, 2))
    first = (top["key"], top["mark"]) if top else (0, 0)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks = limits.value[:, 0], limits.value[:, 1]
        for batch in batches:
            key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
            low, part = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            opens = np.zeros(len(key), bool)
            for k in np.flatnonzero(part > low):  # an id that holds limits of its own is cut by the texts' hashes
                same = marks[low[k] : part[k]]
                opens[k] = mark[k] in same
                part[k] = low[k] + np.searchsorted(same, mark[k], "right")
            guest = np.where(opens, part - 1, np.where((key == first[0]) & (mark == first[1]), len(keys), -1))
            take = np.flatnonzero(guest >= 0)
            yield batch.append_column("part", pa.array(part.astype(np.int32))).append_column("guest", pa.array(np.zeros(len(key), np.int32)))
            if len(take):
                yield batch.take(pa.array(take)).append_column("part", pa.array(guest[take].astype(np.int32))).append_column("guest", pa.array(np.ones(len(take), np.int32)))

    placed = rows.select("doc_id", "text", "key", "mark", "n").mapInArrow(place_rows, "doc_id long, text string, key long, mark long, n long, part int, guest int")
    return placed.repartitionById(len(found) + 1, F.col("part"))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, guest, key, mark, text): each one with its following text, which for the last of a range is the guest."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def row(doc_id: int | None, text: str, mark: bytes, following: str, after: bytes) -> tuple:
        new = edited(text, following).encode()
        edit = fingerprint(new)
        return doc_id, len(text), hashlib.sha256(new).hexdigest(), mark.hex(), edit.hex(), likeness(mark, edit), likeness(mark, after)

    held = None
    for batch in batches:
        for doc_id, text, n, part, guest in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "n", "part", "guest")], strict=True):
            mark = fingerprint(text.encode())
            if held is not None and held[2] == part:
                out.append(row(held[0], held[1], held[3], text, mark))
            held = None if guest else (doc_id, text, part, mark)
            if not guest and n > 1:
                own = row(doc_id, text, mark, text, mark)
                for k in range(n - 1):
                    out.append(own)
                    if len(out) >= 500:
                        yield emit()
            if len(out) >= 500:
                yield emit()
    if out:
        yield emit()


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The following document is the next by descending doc_id, after the last the first; rows of one
    id follow by a hash of their text, ids that are null come last. Rows that are repeated follow
    each other and then the next different one. A null text is empty, and an empty text has an
    empty fingerprint, like only another empty one. Texts are shuffled once, to ranges of ids and
    texts that hold about the same number of bytes; a range also gets the first row of the next, so
    no step orders the whole table in one task. An only row follows itself; an empty table gives no
    rows.
    """
    ordered = _ranges(_distinct(docs)).sortWithinPartitions("part", "guest", "key", "mark", "text")
    return ordered.mapInArrow(_fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

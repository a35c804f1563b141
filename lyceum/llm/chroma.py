"""Chroma audio fingerprints of a media column, and alignment of recordings.

A recording is 16-bit mono PCM. Frames of FRAME samples, half overlapping, give energy by pitch
class; an integral image over (frame, pitch class) lets sixteen rectangle filters be read with a
few look-ups each; each filter's log ratio is quantised to two bits, so a frame is one packed
32-bit integer. Recordings with equal fingerprints are one class. A query class is compared with
the classes that share a sub-word: the same two of the four bytes in two frames that are APART apart. A pair
is compared at every offset with enough overlap: the share of unequal bits is the bit error, and the
offset of a pair is where most frames match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import PASS_BYTES, mix64, saved

#: Samples a second, samples of a frame, frames that the widest filter spans, largest bit error of a match.
RATE, FRAME, SPAN, MATCH = 2000, 512, 8, 0.25
#: Frames between the two that a sub-word is made of; in fingerprints that are too short for it, a frame stands alone.
APART = (3, 4, 5)
#: Every how many ids one is a query.
EVERY = 20
#: Recordings of a batch that leaves the renderer.
SOUNDS = 128
#: Type of the list of a class's matches.
LINKS = "array<struct<match_id: long, offset: long, bit_error: double>>"


@cache
def _chroma_of_bin() -> np.ndarray:
    """[frequency bin, pitch class] weights for 60 to 950 Hz."""
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(freq), 12), np.float32)
    for k, f in enumerate(freq):
        if 60 <= f <= 950:
            out[k, int(round(12 * np.log2(f / 440))) % 12] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, pitch classes, frames) of the sixteen filters: four shapes in four sizes."""
    return [(shape, (3 * size + 2 * shape) % 8, 4, width) for size, width in enumerate((2, 4, 6, SPAN)) for shape in range(4)]


def chroma(pcm: np.ndarray) -> np.ndarray:
    """[..., frame, pitch class] shares of energy of recordings [..., sample] of equal length."""
    hop = FRAME // 2
    if pcm.shape[-1] < FRAME:
        return np.zeros((*pcm.shape[:-1], 0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME, axis=-1)[..., ::hop, :]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=-1)) ** 2
    out = power.astype(np.float32) @ _chroma_of_bin()
    return out / np.maximum(np.sqrt((out**2).sum(axis=-1, keepdims=True)), 1e-3)


def packed(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer [..., place] for each place of the widest filter in images [..., frame, pitch class]."""
    n = image.shape[-2] - SPAN + 1
    if n <= 0:
        return np.zeros((*image.shape[:-2], 0), np.uint32)
    sums = np.zeros((*image.shape[:-2], image.shape[-2] + 1, 13))
    sums[..., 1:, 1:] = image.cumsum(-2).cumsum(-1)

    def area(t0: int, y0: int, t1: int, y1: int) -> np.ndarray:
        return sums[..., t1 : t1 + n, y1] - sums[..., t0 : t0 + n, y1] - sums[..., t1 : t1 + n, y0] + sums[..., t0 : t0 + n, y0]

    out = np.zeros((*image.shape[:-2], n), np.uint32)
    for shape, y, height, width in filters():
        whole, half, mid = area(0, y, width, y + height), width // 2, y + height // 2
        if shape == 0:
            a = area(0, y, half, y + height)
        elif shape == 1:
            a = area(0, y, width, mid)
        elif shape == 2:
            a = area(0, y, half, mid) + area(half, mid, width, y + height)
        else:
            a = area(0, y + 1, width, y + 3)
        ratio = np.log((0.05 + a) / (0.05 + whole - a))
        level = (ratio > -0.6).astype(np.uint32) + (ratio > 0) + (ratio > 0.6)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def tones(values: np.ndarray) -> bytes:
    """A recording that sounds one note for each value: the pitch follows the value, half a frame each."""
    hop = FRAME // 2
    note = np.clip(np.round(12 + 5 * values), 0, 24)
    freq = np.repeat(110.0 * 2 ** (note / 12), hop)
    wave = np.sin(2 * np.pi * np.cumsum(freq) / RATE)
    return (12000 * np.concatenate([wave, np.zeros(hop)])).astype("<i2").tobytes()


def recordings(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rec_id, pcm): each vector as a recording, the media column that the query works on; null and empty vectors have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SOUNDS) for b in batches for k in range(0, b.num_rows, SOUNDS)):
            sound = []
            for x in batch.column("vector"):
                v = np.nan_to_num(np.array([y if y is not None else 0.0 for y in x.as_py() or []], np.float64), posinf=9, neginf=-9)
                scale = np.abs(v).mean() if len(v) else 0
                sound.append(tones(v / scale) if scale > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(sound, pa.binary())], ["rec_id", "pcm"])

    return vectors.select(F.col(id_col).cast("long").alias("rec_id"), F.col(vector).alias("vector")).mapInArrow(run, "rec_id long, pcm binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """(rec_id, n_frames, marks): the packed integers of each recording, none for a null or short one.

    Recordings of equal length are transformed together, up to PASS_BYTES of samples at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sounds = [x.as_py() or b"" for x in batch.column("pcm")]
            marks, frames = [b""] * len(sounds), np.zeros(len(sounds), np.int64)
            by_size = defaultdict(list)
            for k, raw in enumerate(sounds):
                by_size[len(raw) // 2].append(k)
            for size, rows in by_size.items():
                step = max(1, PASS_BYTES // max(1, 2 * size))
                for at in (rows[k : k + step] for k in range(0, len(rows), step)):
                    image = chroma(np.stack([np.frombuffer(sounds[k][: 2 * size], "<i2") for k in at]))
                    frames[at] = image.shape[1]
                    for k, row in zip(at, packed(image).view(np.int32), strict=True):
                        marks[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(frames), pa.array(marks, pa.binary())], ["rec_id", "n_frames", "marks"])

    return media.mapInArrow(run, "rec_id long, n_frames long, marks binary")


def sub_words(marks: np.ndarray) -> np.ndarray:
    """The distinct sub-words of a fingerprint: 64-bit hashes of two bytes in each of two frames, which bytes these are, and how far apart the frames."""
    masks = [255 << 8 * a | 255 << 8 * b for a in range(4) for b in range(a)]
    out = []
    for apart in APART:
        first, second = (marks[:-apart], marks[apart:]) if len(marks) > apart else (marks, np.zeros_like(marks))
        both = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        out += [mix64((both & np.uint64(m << 32 | m)) ^ np.uint64((6 * apart + k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k, m in enumerate(masks)]
    return np.unique(np.concatenate(out))


def _entries(classes: DataFrame) -> DataFrame:
    """(node, asked, mark): the sub-words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sub_words(np.frombuffer(x.as_buffer(), np.uint32)).view(np.int64) for x in batch.column("marks")]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, words)]).astype(np.int32), np.concatenate(words) if words else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("asked"), lists], ["node", "asked", "words"])

    return classes.select("node", "asked", "marks").mapInArrow(run, "node long, asked boolean, words array<long>").select("node", "asked", F.explode("words").alias("mark"))


def least_overlap(n: int, m: int) -> int:
    """Frames that an alignment of n and m frames has at least: half of the shorter recording, and SPAN or all of it."""
    return max((min(n, m) + 1) // 2, min(n, m, SPAN))


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, matched frames, bit error) of the best alignment of each row of `a` with the same row of `b`; bit error 1 where none is up to MATCH.

    A frame is matched if its own bit error is up to MATCH. Among the offsets with enough overlap
    and a bit error up to MATCH, the best has most matched frames, then the least bit error, then
    the least shift.
    """
    n, m = a.shape[1], b.shape[1]
    least = least_overlap(n, m)
    offset, matched, error = np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64), np.ones(len(a))
    for k in sorted(range(least - m, n - least + 1), key=abs):
        x0, y0 = max(0, k), max(0, -k)
        w = min(n - x0, m - y0)
        bits = np.bitwise_count(a[:, x0 : x0 + w] ^ b[:, y0 : y0 + w])
        e, f = bits.sum(axis=1, dtype=np.int64) / (32 * w), (bits <= int(32 * MATCH)).sum(axis=1)
        better = (e <= MATCH) & ((f > matched) | (f == matched) & (e < error))
        offset[better], matched[better], error[better] = k, f[better], e[better]
    return offset, matched, error


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(x.as_py(), y.as_py()) for x, y in zip(batch.column("q_marks"), batch.column("marks"), strict=True)]
        offset, matched, error = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), np.ones(len(pairs))
        shapes = defaultdict(list)
        for i, (x, y) in enumerate(pairs):
            shapes[len(x), len(y)].append(i)
        for (n, m), rows in shapes.items():
            step = max(1, 4 * PASS_BYTES // (n + m))
            for at in (rows[k : k + step] for k in range(0, len(rows), step)):
                a, b = (np.frombuffer(b"".join(pairs[i][side] for i in at), np.uint32).reshape(len(at), -1) for side in (0, 1))
                offset[at], matched[at], error[at] = align(a, b)
        cols = [batch.column("query"), batch.column("node"), pa.array(offset), pa.array(matched), pa.array(error)]
        yield pa.RecordBatch.from_arrays(cols, ["query", "node", "offset", "matched", "bit_error"]).filter(pa.array(error <= MATCH))


def match_recordings(media: DataFrame, every: int = EVERY) -> DataFrame:
    """rec_id, n_frames, fingerprint, class_id, match_id, offset, bit_error, n_links, links for every recording.

    class_id is the smallest id with the same fingerprint. Queries are the classes with a member
    whose id is divisible by `every`; match_id is the class, other than a recording's own, among
    them that aligns with most matched frames (then the least bit error, then the smallest id), up
    to MATCH over the least overlap, and offset its place against it; null where none does. n_links
    counts all classes that align so, and links lists them (match_id, offset, bit_error), best first.
    Copies are not expanded: only class representatives are aligned, and only the rows with
    rec_id = class_id hold the list (null elsewhere). A null or too short recording has an empty fingerprint and no class. Repeated rows
    get a row each; a null id is never a query; an empty table gives no rows.
    """
    rows = saved(fingerprints(media.select("rec_id", "pcm")))
    sounding = rows.where(F.length("marks") > 0)
    grouped = sounding.groupBy("marks").agg(F.min("rec_id").alias("node"), F.max(F.coalesce(F.pmod("rec_id", F.lit(every)) == 0, F.lit(False))).alias("asked"))
    classes = saved(grouped.where("node is not null"))
    entries = _entries(classes)
    asked = entries.where("asked").select(F.col("node").alias("query"), "mark")
    pairs = entries.select("node", "mark").join(asked, "mark").where("node <> query").select("query", "node").distinct()
    pairs = pairs.join(classes.select(F.col("node").alias("query"), F.col("marks").alias("q_marks")), "query").join(classes.select("node", "marks"), "node")
    hits = pairs.select("query", "node", "q_marks", "marks").mapInArrow(_aligned, "query long, node long, offset long, matched long, bit_error double")
    found = F.sort_array(F.collect_list(F.struct((-F.col("matched")).alias("order"), "bit_error", F.col("query").alias("match_id"), "offset")))
    linked = hits.groupBy("node").agg(F.transform(found, lambda x: F.struct(x["match_id"], x["offset"], x["bit_error"])).alias("links"))
    named = classes.select("marks", "node").join(linked, "node", "left")
    best = F.get("links", F.lit(0))
    return rows.join(named, "marks", "left").select(
        "rec_id", "n_frames", F.lower(F.hex("marks")).alias("fingerprint"), F.col("node").alias("class_id"), *[best[c].alias(c) for c in ("match_id", "offset", "bit_error")],
        F.when(F.col("node").isNotNull(), F.coalesce(F.size("links"), F.lit(0))).alias("n_links"), F.when(F.col("rec_id") == F.col("node"), F.coalesce("links", F.array().cast(LINKS))).alias("links"),
    )

"""Language identification by partial matching: byte context trees with escapes, under frozen statistics.

For each language, contexts of zero to three bytes hold the counts of the bytes that followed them
in training texts. A byte is coded in the longest context that was seen; with n counts of t
different bytes, a seen byte costs -log2(count / (n + t)) there, and any other pays the escape
-log2(t / (n + t)) and is coded one byte shorter, down to 8 bits and more for a byte never seen.
The statistics are frozen after training, so a byte's cost depends on it and the three bytes before
it only. Every context that was seen is kept: a context stores the set of its bytes as 256 bits,
and costs for these bytes and for its escape, for LANES languages side by side. A text's exact code
length is a sum of such costs, whatever the number of languages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import passes, text_buffer

#: Training sample: rows and bytes a language at most (texts are cut there), rows and bytes of all languages at most.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_ALL, SAMPLE_TOTAL = 300, 1_200_000, 6_000, 24_000_000
#: Languages whose costs lie side by side.
LANES = 8
#: Every how many training texts of a language one is kept out of the counts to learn how long codes of that language are, and the standard deviations by which a text may exceed them.
KEPT_OUT, DEVIATIONS = 5, 14.0

_LETTER = regex.compile(r"\p{L}")
_U32, _U64 = np.uint32, np.uint64


@dataclass
class Group:
    """Contexts of up to LANES languages; a row is a context: one for each last byte, then one for each pair, then one for each triple."""

    langs: list[str]
    pair: np.ndarray  # [byte before the last, last byte] -> number of the two-byte context
    triple: np.ndarray  # [number of the two bytes before the last, last byte] -> row of the longest context seen
    shorter: np.ndarray  # [row] -> row of the context one byte shorter, -1 for none
    seen: np.ndarray  # [row, 4] -> the set of the context's bytes
    first: np.ndarray  # [row, 4] -> place of the first of them
    bits: np.ndarray  # [place, language] cost of a byte in a context
    escape: np.ndarray  # [row, language] cost of leaving a context
    zero: np.ndarray  # [byte, language] cost without context


@dataclass
class Model:
    groups: list[Group]
    langs: list[str]
    most: np.ndarray  # [language, 2] mean and deviation of bits a byte in texts that were not counted

    def acceptable(self, rate: np.ndarray, size: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether a text of `size` bytes may be of its best language: its code isn't longer than such texts' by DEVIATIONS."""
        mean, deviation = self.most[best, 0], self.most[best, 1]
        return rate <= mean + DEVIATIONS * deviation / np.sqrt(np.maximum(size, 1))


def _counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of context and byte, count) for all bytes of the texts after `order` bytes of context; a text starts after three line feeds, which are context only."""
    data = np.frombuffer(b"".join(b"\n\n\n" + t for t in texts), np.uint8).astype(_U32)
    sizes = np.array([len(t) for t in texts], np.int64)
    own = np.repeat(3 * np.arange(1, len(texts) + 1), sizes) + np.arange(sizes.sum())
    code = np.zeros(len(own), _U32)
    for k in range(order, -1, -1):
        code = (code << _U32(8)) | data[own - k]
    return np.unique(code, return_counts=True)


def _group(langs: list[str], samples: dict[str, list[bytes]]) -> Group:
    tables = [[_counts(samples[x], order) for order in range(4)] for x in langs]
    codes = [np.unique(np.concatenate([t[order][0] for t in tables])) for order in range(4)]
    pairs, triples = (np.unique(codes[order] >> _U32(8)) for order in (2, 3))
    pair = np.zeros((256, 256), np.int32)
    pair[pairs >> 8, pairs & 255] = np.arange(1, len(pairs) + 1)
    rows = 256 + len(pairs) + len(triples)
    triple = np.zeros((len(pairs) + 1, 256), np.int32)
    triple[1:] = _pair_row(pair, pairs[:, None] & 255, np.arange(256)[None, :])
    triple[pair[triples >> 16, (triples >> 8) & 255], triples & 255] = 256 + len(pairs) + np.arange(len(triples))
    shorter = np.concatenate([np.full(256, -1), pairs & 255, _pair_row(pair, (triples >> 8) & 255, triples & 255)]).astype(np.int32)
    # The zeroth order: every byte has a cost.
    zero = np.empty((256, len(langs)), np.float32)
    for j, t in enumerate(tables):
        count = np.zeros(256)
        count[t[0][0]] = t[0][1]
        n, kinds = count.sum(), (count > 0).sum()
        zero[:, j] = np.where(count > 0, -np.log2(np.maximum(count, 1) / (n + kinds)), -np.log2(kinds / (n + kinds)) + 8.0)
    escape, seen = np.zeros((rows, len(langs)), np.float32), np.zeros((rows, 4), _U64)
    places, costs, below = [], [], zero
    starts = (0, 0, 256, 256 + len(pairs))
    for order, contexts in ((1, np.arange(256, dtype=_U32)), (2, pairs), (3, triples)):
        code = codes[order]
        at, byte = np.searchsorted(contexts, code >> _U32(8)), code & _U32(255)
        # The same byte one byte shorter was seen too, so its cost is known.
        base = below[byte] if order == 1 else below[np.searchsorted(codes[order - 1], code & _U32((1 << 8 * order) - 1))]
        bits = np.empty((len(code), len(langs)), np.float32)
        for j, t in enumerate(tables):
            count = np.zeros(len(code))
            count[np.searchsorted(code, t[order][0])] = t[order][1]
            n, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, count > 0, len(contexts))
            known = n > 0
            escape[starts[order] : starts[order] + len(contexts), j][known] = -np.log2(kinds[known] / (n + kinds)[known])
            with np.errstate(divide="ignore", invalid="ignore"):
                bits[:, j] = np.where(count > 0, -np.log2(count / (n + kinds)[at]), escape[starts[order] + at, j] + base[:, j])
        row = starts[order] + at
        np.bitwise_or.at(seen, (row, byte >> _U32(6)), _U64(1) << (byte & _U32(63)).astype(_U64))
        places.append(row)
        costs.append(bits)
        below = bits
    held = np.bitwise_count(seen).astype(np.int64)
    first = (np.cumsum(held.ravel()) - held.ravel()).reshape(held.shape).astype(np.int32)
    return Group(langs, pair, triple, shorter, seen, first, np.concatenate(costs), escape, zero)


def _pair_row(pair: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The row of a two-byte context, or of its last byte where the two were never seen."""
    number = pair[before, last]
    return np.where(number > 0, 255 + number, last)


def train(samples: dict[str, list[bytes]]) -> Model:
    """A model of the given texts of each language; a language without a byte can't be learned and is left out."""
    langs = sorted(x for x in samples if any(samples[x]))
    counted, apart = {}, {}
    for x in langs:
        texts = [t for t in samples[x] if t]
        out = texts[KEPT_OUT - 1 :: KEPT_OUT] if len(texts) >= 4 * KEPT_OUT else []
        counted[x] = [t for k, t in enumerate(texts) if not out or k % KEPT_OUT != KEPT_OUT - 1]
        apart[x] = out
    model = Model([_group(langs[k : k + LANES], counted) for k in range(0, len(langs), LANES)], langs, np.tile([8.0, 0.0], (len(langs), 1)))
    for j, x in enumerate(langs):
        if apart[x]:
            size = np.array([len(t) for t in apart[x]], float)
            data, offsets = np.frombuffer(b"".join(apart[x]), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            bits = code_lengths(model, data, offsets)[:, j]
            mean = bits.sum() / size.sum()
            model.most[j] = mean, np.sqrt(np.mean((bits - mean * size) ** 2 / size))
    return model


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    for lo, hi in passes(offsets, 1 << 18):
        rows = np.flatnonzero(np.diff(offsets[lo : hi + 1]) > 0)
        if not len(rows):
            continue
        part = raw[offsets[lo] : offsets[hi]]
        starts = (offsets[lo:hi] - offsets[lo])[rows]
        before = []
        for k in (1, 2, 3):
            b = np.empty(len(part), np.int32)
            b[:k], b[k:] = 10, part[:-k] if len(part) > k else part[:0]
            for j in range(k):
                at = starts + j
                b[at[at < len(b)]] = 10
            before.append(b)
        # A text shorter than three bytes ends before the next one's marks; those are set again by that text.
        word, rank = part >> np.uint8(6), _U64(1) << (part & np.uint8(63)).astype(_U64)
        done = 0
        for g in model.groups:
            number = g.pair[before[2], before[1]]
            row = g.triple[number, before[0]]
            new = np.flatnonzero(number == 0)
            row[new] = _pair_row(g.pair, before[1][new], before[0][new])
            cost = np.zeros((len(part), len(g.langs)), np.float32)
            todo = np.arange(len(part))
            while len(todo):
                here, w, bit = row[todo], word[todo], rank[todo]
                members = g.seen[here, w]
                hit = (members & bit) != 0
                if hit.all():
                    cost[todo] += g.bits[g.first[here, w] + np.bitwise_count(members & (bit - _U64(1)))]
                    break
                yes, no = todo[hit], todo[~hit]
                cost[yes] += g.bits[g.first[here[hit], w[hit]] + np.bitwise_count(members[hit] & (bit[hit] - _U64(1)))]
                cost[no] += g.escape[here[~hit]]
                row[no] = g.shorter[here[~hit]]
                last = no[row[no] < 0]
                cost[last] += g.zero[part[last]]
                todo = no[row[no] >= 0]
            out[lo + rows, done : done + len(g.langs)] = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
            done += len(g.langs)
    return out


def _held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def training_rows(docs: DataFrame) -> DataFrame:
    """text and lang of rows that may be learned from."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc, F.lit(4)) != 2)).select("doc_id", "lang", "text")


def fit(docs: DataFrame) -> Model:
    """Learn every language of the training rows from a sample by hash of the id, bounded by SAMPLE_ROWS and SAMPLE_BYTES a language; no more than that reaches the driver."""
    rows = training_rows(docs)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ALL).collect()}
    if not sizes:
        return train({})
    each = max(1, min(SAMPLE_ROWS, SAMPLE_ALL // len(sizes)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.3 * each / n))])
    small = rows.select("doc_id", "lang", place.alias("place"), F.octet_length("text").alias("bytes")).where(F.col("place") < F.try_element_at(share, F.col("lang")))
    chosen: dict[str, dict[int, int]] = {}
    for r in small.orderBy("place", "doc_id").limit(2 * SAMPLE_ALL).collect():
        ids = chosen.setdefault(r["lang"], {})
        room = min(SAMPLE_BYTES, SAMPLE_TOTAL // len(sizes)) - sum(ids.values())
        if len(ids) < each and room > 0:
            ids[r["doc_id"]] = min(r["bytes"], room)
    wanted = docs.sparkSession.createDataFrame([(lang, i, n) for lang, ids in chosen.items() for i, n in ids.items()], "lang string, doc_id long, bytes long")
    found = rows.join(F.broadcast(wanted), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(F.expr("substring(encode(text, 'UTF-8'), 1, int(bytes))")).alias("raw"))
    texts: dict[str, dict[int, bytes]] = {}
    for r in found.collect():
        texts.setdefault(r["lang"], {})[r["doc_id"]] = bytes(r["raw"])
    return train({lang: [found[i] for i in sorted(found)] for lang, found in texts.items()})


def _judged(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language, score and bits a byte in it, of each text."""
    bits, size = code_lengths(model, raw, offsets), np.maximum(np.diff(offsets), 1)
    rate = bits / size[:, None]
    least = rate.min(axis=1)
    odds = np.exp2(-(rate - least[:, None]) * np.minimum(size, 64)[:, None])
    return bits.argmin(axis=1), 1 / odds.sum(axis=1), least


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row.

    The least code length wins (ties: the first language by code point); the score is its share of
    the likelihoods 2**-bits per character, scaled to the text's first 64 bytes' worth of evidence
    at most, so long texts do not all reach 1. A text that is null or has no letter is `und` with
    score 0, and so is every text if nothing could be learned. Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column("text")
            raw, offsets = text_buffer(column)
            letters = np.array([bool(_LETTER.search(t)) if (t := x.as_py()) else False for x in column], bool)
            if m.langs and batch.num_rows:
                best, sure, rate = _judged(m, raw, offsets)
                score, least = np.where(letters, sure, 0.0), np.where(letters, rate, 0.0)
                langs = [m.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            else:
                score, least, langs = np.zeros(len(letters)), np.zeros(len(letters)), ["und"] * len(letters)
            held = [_held_out(x.as_py()) for x in batch.column("doc_id")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(langs, pa.string()), pa.array(score), pa.array(least)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the training rows, and predict every row."""
    return predict(docs, fit(docs))


def known(docs: DataFrame) -> DataFrame:
    """Rows in a learned language; other columns stay. `lang` becomes the predicted language where it is null or the text speaks for another one with a score of 0.99 or more.

    A text is rejected if it is `und`, or if its code in the best language is longer than those of
    texts that were kept out of the counts by more than DEVIATIONS (the deviation of a text's bits a
    byte falls with the root of its size): scrambled or binary text, or a language nobody taught.
    Where nothing could be learned, texts with a letter stay.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column("text")
            raw, offsets = text_buffer(column)
            keep = np.array([bool(_LETTER.search(t)) if (t := x.as_py()) else False for x in column], bool)
            cols = {c: batch.column(c) for c in names}
            if m.langs and batch.num_rows:
                best, score, rate = _judged(m, raw, offsets)
                size = np.diff(offsets)
                keep &= m.acceptable(rate, size, best)
                given = cols["lang"].to_pylist()
                cols["lang"] = pa.array([m.langs[b] if x is None or s >= 0.99 else x for x, b, s in zip(given, best, score, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Quality classifier from weak labels: expectation-maximisation over overlapping labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import mix64, passes, saved, text_buffer, window_hashes, word_bounds

#: Labellers; each one votes bad (0), abstains (1) or votes good (2), and a document's votes are one number to the base 3.
LABELLERS = ("symbols", "shouting", "repeats", "variety", "lines", "exclamation", "letters", "length")
#: Bins of the hashed features, documents of the training sample at most, bytes of a document that may enter it.
BINS, SAMPLE, SAMPLE_BYTES = 1 << 14, 2_000, 60_000

_UPPER, _LOWER, _HIGH, _SYMBOL, _MARK = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:] = _UPPER, _LOWER, _HIGH
_CLASS[list(b"#$%&*|<>{}\\^~=")] = _SYMBOL
_CLASS[33] = _MARK


@dataclass
class Part:
    """What one vectorised pass knows of its texts."""

    votes: np.ndarray
    words: np.ndarray
    tails: np.ndarray
    first: np.ndarray
    shape: np.ndarray  # [text, repeats, stale lines, symbols, capitals]


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 2, 1))


def _share(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct share of the hashes of each text."""
    out = np.ones(len(first) - 1)
    for k in range(len(first) - 1):
        a, b = first[k], first[k + 1]
        if b - a > 1:
            x = np.sort(hashes[a:b])
            out[k] = (1 + np.count_nonzero(x[1:] != x[:-1])) / (b - a)
    return out


def _parts(column: pa.Array) -> Iterator[Part]:
    raw, offsets = text_buffer(column)
    for lo, hi in passes(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_bounds(part, at)
        words = window_hashes(part, starts, ends)
        tails = window_hashes(part, np.maximum(starts, ends - 3), ends)
        n, size = np.diff(first), np.maximum(np.diff(at), 1)
        kinds = _CLASS[part]

        def count(kind: int, kinds: np.ndarray = kinds, at: np.ndarray = at) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum((kinds & kind) > 0)])[at])

        upper, lower, symbols, marks = count(_UPPER), count(_LOWER), count(_SYMBOL), count(_MARK)
        cased, some = np.maximum(upper + lower, 1), np.maximum(n, 1)
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[first[:-1][n > 0]] = False
        repeats = np.diff(np.concatenate([[0], np.cumsum(same)])[first]) / some
        variety = _share(words, first)
        breaks = part == 10
        inside = ~breaks
        before = np.concatenate([[False], inside[:-1]]) if len(part) else inside
        before[at[:-1][at[:-1] < len(part)]] = False
        after = np.concatenate([inside[1:], [False]]) if len(part) else inside
        after[at[1:][at[1:] > 0] - 1] = False
        line_starts, line_ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        line_first = np.searchsorted(line_starts, at)
        fresh, lines = _share(window_hashes(part, line_starts, line_ends), line_first), np.diff(line_first)
        letters = (upper + lower + count(_HIGH)) / size
        each = (
            _vote(symbols > 0.03 * size, symbols == 0), _vote(upper > 0.5 * cased, upper < 0.15 * cased), _vote(repeats > 0.2, repeats < 0.05),
            _vote((n >= 50) & (variety < 0.4), (n >= 50) & (variety > 0.6)), _vote((lines >= 4) & (fresh < 0.6), (lines >= 2) & (fresh == 1)),
            _vote(marks > 0.2 * some, np.zeros(len(n), bool)), _vote(letters < 0.7, letters > 0.78), _vote(n < 1, n >= 30),
        )
        yield Part(sum(v.astype(np.int64) * 3**k for k, v in enumerate(each)), words, tails, first, np.stack([repeats, 1 - fresh, 10 * symbols / size, upper / cased], axis=1))


def votes(docs: DataFrame) -> DataFrame:
    """doc_id and votes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p.votes for p in _parts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else [], pa.int64())], ["doc_id", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes long")


@dataclass
class LabelModel:
    """Share of good documents, and for each labeller the chance of each vote in bad and good ones, given that it votes."""

    prior: float
    table: np.ndarray  # [labeller, class, vote]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        logs = np.log(np.array([1 - self.prior, self.prior]))[None, :] + np.zeros((len(patterns), 2))
        for k in range(len(LABELLERS)):
            logs += np.log(self.table[k][:, patterns // 3**k % 3]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))

    def accuracy(self) -> dict[str, float]:
        """Estimated share of right votes of each labeller among those it casts, at the classes' shares."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.table[:, 0, 0] + share[1] * self.table[:, 1, 2]
        return dict(zip(LABELLERS, right.tolist(), strict=True))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, from the majority of votes."""
    digits = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = 1 / (1 + np.exp(-1.5 * ((digits - 1).sum(1) - 3 * (digits == 0).sum(1))))
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        total = weight.sum(1)
        table = np.stack([[[weight[c][digits[:, k] == v].sum() for v in range(3)] for c in range(2)] for k in range(len(LABELLERS))])
        cast = table[:, :, [0, 2]].sum(2, keepdims=True)
        table = (table + 0.5) / (cast + 1)
        table[:, :, 1] = 1  # an abstention says nothing
        model = LabelModel(float(np.clip((total[1] + 1) / (total.sum() + 2), 0.01, 0.99)), table)
        good = model.posterior(patterns)
    return model


def _features(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, value) of the hashed words and word ends, whose values add up to 2 in a text, and of its shape."""
    n = np.diff(part.first)
    text = np.repeat(np.arange(len(n)), n)
    value = 1.0 / np.maximum(n, 1)[text]
    bins = [(mix64(h + np.uint64(salt)) & np.uint64(BINS - 1)).astype(np.int64) for salt, h in ((1, part.words), (2, part.tails))]
    rows, kinds = part.shape.shape
    at = np.tile(np.arange(rows), kinds)
    names = np.repeat((mix64(np.arange(kinds, dtype=np.uint64) + np.uint64(1)) & np.uint64(BINS - 1)).astype(np.int64), rows)
    return np.concatenate([text, text, at]), np.concatenate([*bins, names]), np.concatenate([value, value, part.shape.T.ravel()])


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, part: Part) -> np.ndarray:
        text, bins, value = _features(part)
        return 1 / (1 + np.exp(-(np.bincount(text, self.weights[bins] * value, len(part.first) - 1) + self.bias)))


def fit_scorer(texts: list[str], target: np.ndarray, rounds: int = 120) -> Scorer:
    """Logistic regression on soft labels by Adam, full batches."""
    rows, bins, values, done = [], [], [], 0
    for part in _parts(pa.array(texts, pa.string())):
        r, b, v = _features(part)
        rows.append(r + done)
        bins.append(b)
        values.append(v)
        done += len(part.first) - 1
    if not done:
        return Scorer(np.zeros(BINS), 0.0)
    r, b, v = np.concatenate(rows), np.concatenate(bins), np.concatenate(values)
    w, m, s = np.zeros(BINS + 1), np.zeros(BINS + 1), np.zeros(BINS + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(r, w[b] * v, done) + w[-1])))
        error = (p - target) / done
        g = np.bincount(b, error[r] * v, BINS + 1) + 1e-6 * w
        g[-1] = error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g**2
        w = w - 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return Scorer(w[:-1], float(w[-1]))


def fit(docs: DataFrame) -> tuple[DataFrame, LabelModel, Scorer]:
    """Votes of every row, the label model of all rows, and a scorer of a bounded sample.

    All rows' votes are counted by pattern (3**8 patterns at most). The sample is drawn by hash of
    the id and the votes, up to SAMPLE documents of SAMPLE_BYTES at most, half of them from patterns
    that the label model takes for bad where there are as many.
    """
    cast = saved(votes(docs))
    table = cast.groupBy("votes").count().collect()
    if not table:
        return cast, estimate(np.zeros(0, np.int64), np.zeros(0)), fit_scorer([], np.zeros(0))
    patterns, counts = np.array([r["votes"] for r in table], np.int64), np.array([r["count"] for r in table], float)
    model = estimate(patterns, counts)
    good = model.posterior(patterns) >= 0.5
    texts, target = [], []
    for side in (False, True):
        chosen, total = [int(p) for p in patterns[good == side]], float(counts[good == side].sum())
        if not chosen:
            continue
        rate = min(1.0, 1.5 * SAMPLE / 2 / total)
        place = F.shiftrightunsigned(F.xxhash64("doc_id", "votes"), 11) / F.lit(float(1 << 53))
        ids = cast.where(F.col("votes").isin(chosen) & F.col("doc_id").isNotNull()).withColumn("place", place).where(F.col("place") < rate).orderBy("place", "doc_id").limit(SAMPLE // 2).collect()
        label = {r["doc_id"]: r["votes"] for r in ids}
        rows = docs.where(F.col("doc_id").isin(list(label)) & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text").limit(SAMPLE).collect() if label else []
        texts += [(r["doc_id"], r["text"]) for r in rows]
        target += [label[r["doc_id"]] for r in rows]
    order = sorted(range(len(texts)), key=lambda k: texts[k])
    soft = model.posterior(np.array([target[k] for k in order], np.int64)) if order else np.zeros(0)
    return cast, model, fit_scorer([texts[k][1] for k in order], soft)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score and kept (score at least 0.5) for every row.

    A null or empty text has no words, so only its bias and few votes judge it. Repeated rows are
    judged alike; other columns are ignored; an empty table gives no rows.
    """
    _, model, scorer = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, linear = shared.value
        for batch in batches:
            found = list(_parts(batch.column("text")))
            cast = np.concatenate([p.votes for p in found]) if found else np.zeros(0, np.int64)
            score = np.concatenate([linear.score(p) for p in found]) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cast, pa.int64()), pa.array(labels.posterior(cast)), pa.array(score), pa.array(score >= 0.5)], ["doc_id", "votes", "posterior", "score", "kept"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes long, posterior double, score double, kept boolean")

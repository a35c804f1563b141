"""Shared parts: checkpoints, Arrow text buffers, word and shingle hashes in numpy."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes of text that one vectorised pass handles; longer single texts form a pass of their own.
PASS_BYTES = 1 << 20
#: Rows up to which a table of ids is broadcast; more ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows that one range of an ordered running sum holds on average.
RANGE_ROWS = 50_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lyceum-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let executors drop the shuffle files of plans that are done: Spark removes them once the driver has collected the plans as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(rows: DataFrame) -> tuple[DataFrame, bool]:
    """A saved table, and whether it is small enough to be broadcast."""
    rows = saved(rows)
    return rows, rows.count() <= BROADCAST_IDS


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], how: str, hot: Column) -> DataFrame:
    """`rows` joined with `side`, one row for each key; keys that `hot` marks in `side` are looked up in a broadcast table and not shuffled.

    The rows of other keys meet by a shuffle, and so does everything where hot keys are too many to
    broadcast. `side` is read twice, so it should be stored.
    """
    heavy, small = few(side.where(hot))
    if not small or heavy.isEmpty():
        return rows.join(side, on, how)
    heavy = F.broadcast(heavy)
    cold = rows.join(heavy, on, "left_anti").join(side.where(~hot), on, how)
    return rows.join(heavy, on).unionByName(cold)


def running_sums(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """`rows` with `before`, the sum of `value` over the rows of the same group (null is one) that precede in `order`, and `total`, that of the group.

    Rows are dealt to ranges of (group, order), a last key tells equal rows apart so that ranges cut
    through them, and every range sums its rows in one stream. Sums of ranges give each group's
    start in a range, so no task holds a whole group, whatever its size. Equal rows are
    interchangeable: which of them comes first does not change the rows that result.
    """
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()))
    names = [*rows.columns]
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    keys = [F.col(c).asc_nulls_last() if c == group else F.col(c) for c in (group, *order, "_row")]
    schema = StructType([*rows.schema.fields, StructField("_range", LongType()), StructField("_local", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(group).dictionary_encode()
            known = codes.dictionary.to_pylist()
            number = codes.indices.fill_null(len(known)).to_numpy()
            amount = batch.column(value).to_numpy().astype(np.int64)
            new = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
            names_at = [None if number[k] == len(known) else known[number[k]] for k in new]
            sums = np.cumsum(amount) - amount
            base = sums[new].copy()
            if last is not None and names_at[0] == last[0]:
                base[0] -= done
            local = sums - np.repeat(base, np.diff(np.append(new, len(number))))
            last, done = (names_at[-1],), int(local[-1] + amount[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(number), here, np.int64)), pa.array(local)], [*names, "_range", "_local"])

    placed = saved(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    sums = placed.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(group)
    before = F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums, small = few(sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_first"), F.sum("_sum").over(whole).alias("total")))
    both = placed.join(F.broadcast(sums) if small else sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return both.select(*[c for c in names if c != "_row"], (F.col("_first") + F.col("_local")).alias("before"), "total")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit words."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, np.uint64))])
        return self.up, self.down


POWERS = _Powers()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts, and for each text the index of its first word (one more at the end)."""
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    before[at] = False
    after[at[at > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one running polynomial sum."""
    up, down = POWERS.to(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def shingle_rows(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its word shingles; the whole sequence counts as one where it is shorter."""
    raw, offsets = text_buffer(column)
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    for lo, hi in passes(offsets):
        part = _LOWER[raw[offsets[lo] : offsets[hi]]]
        starts, ends, first = word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
        words = window_hashes(part, starts, ends)
        n = max(len(words) - width + 1, 0)
        whole = np.zeros(n, np.uint64)
        for j in range(width):
            whole += words[j : j + n] * factors[j]
        whole = mix64(whole)
        for k in range(hi - lo):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                yield mix64((words[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text."""
    raw, offsets = text_buffer(column)
    out = []
    for lo, hi in passes(offsets, 4 * PASS_BYTES):
        out.append(np.diff(word_bounds(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def binary_array(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())

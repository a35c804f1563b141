"""Paired statistics, agreement and evaluation of extraction."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mcnemar_counts(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: both right, only left, only right, neither; the statistic with continuity correction and its p-value."""
    a, b = F.col(left), F.col(right)
    out = pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"))
    n = F.col("left_only") + F.col("right_only")
    chi = F.when(n > 0, F.pow(F.greatest(F.abs(F.col("left_only") - F.col("right_only")) - 1, F.lit(0)), F.lit(2)) / n).otherwise(0.0)
    return out.withColumn("chi_square", chi).withColumn("p_value", F.round(chi_square_p("chi_square"), 8))


def chi_square_p(column: str) -> Column:
    """erfc(sqrt(x / 2)); Spark has no erfc, and the rows are few."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    return tail(F.col(column))


def mcnemar_exact(left_only: int, right_only: int) -> float:
    """Two-sided binomial p-value of the discordant pairs."""
    n = left_only + right_only
    if not n:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(left_only, right_only) + 1))
    return round(min(1.0, 2 * tail / 2**n), 8)


def cohen_kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed and expected agreement, kappa (1 where chance alone agrees, NaN for no rows)."""
    cells = ratings.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agree"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("product"))
    out = n.crossJoin(chance)
    po, pe = F.try_divide("agree", "total"), F.try_divide(F.col("product"), F.col("total") * F.col("total"))
    kappa = F.when(F.col("total") == 0, F.lit(float("nan"))).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))
    return out.select(F.col("total").alias("n"), F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(kappa, 6).alias("kappa"))


def _draws(seed: int, n: int) -> Iterator[np.ndarray]:
    """Blocks of the numbers below n that a Mersenne twister of that seed draws one by one: its words' leading bits, those that are too large left out."""
    _, words, _ = random.Random(seed).getstate()
    twister = np.random.RandomState()
    twister.set_state(("MT19937", np.array(words[:-1], np.uint32), words[-1]))
    bits = n.bit_length()
    while True:
        drawn = twister.randint(0, 1 << 32, size=1 << 16, dtype=np.uint32) >> np.uint32(32 - bits)
        yield drawn[drawn < n].astype(np.int64)


def bootstrap_interval(left: list[float], right: list[float], resamples: int, seed: int, alpha: float = 0.05, statistic: Callable[[list[float]], float] | None = None) -> tuple[float, float, float]:
    """Observed difference and the bounds of a paired bootstrap; a Mersenne twister of that seed draws the items. Means are taken of whole blocks of resamples at once."""
    if not left:
        return 0.0, 0.0, 0.0
    n, draws, rest = len(left), _draws(seed, len(left)), np.zeros(0, np.int64)
    a, b, found = np.array(left, float), np.array(right, float), []
    measure = statistic or (lambda xs: sum(xs) / len(xs))
    observed = measure(list(right)) - measure(list(left))
    while len(found) < resamples:
        rest = np.concatenate([rest, next(draws)])
        rows = min(len(rest) // n, resamples - len(found))
        at, rest = rest[: rows * n].reshape(rows, n), rest[rows * n :]
        if statistic is None:
            found += (b[at].sum(1) / n - a[at].sum(1) / n).tolist()
        else:
            found += [statistic(b[k].tolist()) - statistic(a[k].tolist()) for k in at]
    found.sort()
    return observed, found[int(alpha / 2 * resamples)], found[max(0, int((1 - alpha / 2) * resamples) - 1)]


def bootstrap(pairs: DataFrame, by: list[str], left: str, right: str, resamples: int = 10_000, seed: int = 12_345) -> DataFrame:
    """n, observed difference and interval of each group of paired scores (a group is one evaluation: hundreds of items)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        observed, lo, hi = bootstrap_interval(rows["left"].tolist(), rows["right"].tolist(), resamples, seed)
        return pd.DataFrame([(*key, len(rows), round(observed, 6), round(lo, 6), round(hi, 6))], columns=[*by, "n", "observed", "ci_low", "ci_high"])

    rows = pairs.select(*by, F.col("item"), F.col(left).cast("double").alias("left"), F.col(right).cast("double").alias("right"))
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, n long, observed double, ci_low double, ci_high double")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1, six places, 0 for an empty denominator."""
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def kind_prf(gold: DataFrame, predicted: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts and scores of every kind (also those without rows) and of all together (`micro`), from (unit_id, kind)."""
    g, p = gold.select("unit_id", "kind", F.lit(1).alias("g")), predicted.select("unit_id", "kind", F.lit(1).alias("p"))
    both = g.join(p, ["unit_id", "kind"], "full_outer")
    counts = both.groupBy("kind").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    every = gold.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    dense = every.join(counts, "kind", "left").na.fill(0, ["tp", "fp", "fn"])
    total = dense.agg(F.lit("micro").alias("kind"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    rows = dense.unionByName(total)
    return rows.select("kind", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def accounting(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys gold has, how many are accounted for, and which side has more."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    out = both.agg(F.count("g").alias("expected"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("accounted"), F.count_if(F.col("g").isNull()).alias("unexpected"))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide("accounted", "expected"), F.lit(0.0)), 6))


def converged_round(values: DataFrame, by: list[str], order: str, value: str, step: float = 0.02) -> DataFrame:
    """The first place, three or later, at which the value has changed by less than `step` twice in a row."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    rows = values.withColumn("i", F.row_number().over(w)).withColumn("d", F.abs(F.col(value) - F.lag(value).over(w)))
    rows = rows.withColumn("before", F.lag("d").over(w))
    return rows.groupBy(*by).agg(F.min(F.when((F.col("i") >= 3) & (F.col("d") < step) & (F.col("before") < step), F.col("i"))).alias("converged"))

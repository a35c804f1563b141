"""Mixing sources to target weights: hash order, distributed prefix sums, exact budgets, whole epochs first."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lyceum.llm.common import few, running_sums, saved

#: Regular expression of a word; the size of a document is their number.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating; share of all words that the mix takes; most epochs of a source.
WEIGHTS, SHARE_PERCENT, EPOCHS = (3, 1, 2), 150, 2
#: Equal rows at a cut that one output task makes at most.
CHUNK = 1_000


def hash_key(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id, the same on every rerun."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from one row for each source.

    Sorted by cap over weight, the saturated sources come first: the first source whose share of
    what remains lies below its cap fixes the common level. These windows see one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"), rank.alias("rank"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    every = Window.partitionBy()
    rows = rows.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        F.row_number().over(order).alias("at"),
    )
    rest = (F.lit(SHARE_PERCENT) * F.col("total") - F.lit(100 * EPOCHS) * F.col("before")) / F.lit(100.0)
    rows = rows.withColumn("level", rest / F.col("left"))
    cap = F.lit(float(EPOCHS)) * F.col("source_size")
    level = F.min(F.when(F.col("weight") * F.col("level") < cap, F.struct("at", "level"))).over(every)["level"]
    rows = rows.withColumn("common", level)
    return rows.select("source", "source_size", F.coalesce(F.least(cap, F.col("weight") * F.col("common")), cap).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, start: how many words the mix takes of every row.

    A source's documents lie in hash order; the mix takes whole epochs and then words up to the
    exact budget, so its sum is the target rounded down and the last document may be taken in part.
    Rows are sorted within ranges of (source, key, id, size, text), and sums of ranges give each
    range its start: no task holds a whole source, nor all rows of one key. Null texts have size 0,
    a null source is a source of its own (last), null ids share one key, repeated rows are taken
    one after the other, and an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        "source", hash_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("mark"),
    )
    placed = saved(running_sums(rows, "source", ["key", "doc_id", "size", "mark"], "size"))
    targets, small = few(source_targets(placed.groupBy("source").agg(F.max("total").alias("source_size"))))
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = placed.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_source"))).withColumnRenamed("before", "start")
    budget = F.floor(F.col("target") + F.lit(1e-9))
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return joined.select(
        "doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), "start", "key", whole.cast("long").alias("whole"), rest.cast("long").alias("rest"), "mark"
    )


def cuts(docs: DataFrame) -> DataFrame:
    """One row a source: whole epochs; key and tie (id, size, hash of the text) of the document at which the last epoch is cut; its number among the rows that equal it in both, how many these are, and the words taken of it."""
    rows = mix(docs).select("source", "whole", "rest", "start", "size", "key", F.struct("doc_id", "size", "mark").alias("tie"))
    last = F.min(F.when(F.col("start") + F.col("size") > F.col("rest"), F.struct("key", "tie", "start", (F.col("rest") - F.col("start")).alias("words"))))
    edges = rows.groupBy("source").agg(F.max("whole").alias("whole"), last.alias("last")).alias("e")
    same = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.key") == F.col("last.key")) & (F.col("r.tie") == F.col("last.tie"))
    both = edges.join(rows.alias("r"), same, "left").groupBy("e.source", "e.whole", "last")
    both = both.agg((F.count_if(F.col("r.start") < F.col("last.start")) + 1).alias("cut_nth"), F.count("r.key").alias("ties"))
    return both.select("source", "whole", F.col("last.key").alias("cut_key"), F.col("last.tie").alias("cut_tie"), "cut_nth", "ties", F.col("last.words").alias("words"))


@F.pandas_udf(StringType())
def _first_words(texts: pd.Series, words: pd.Series) -> pd.Series:
    """The beginning of each text up to its n-th word; null texts stay null."""
    word = re.compile(WORD)

    def cut(text: str | None, n: float) -> str | None:
        end = 0
        if text is not None:
            for _, m in zip(range(int(n)), word.finditer(text)):
                end = m.end()
        return None if text is None else text[:end]

    return pd.Series([cut(t, n) for t, n in zip(texts, words)], dtype=object)


def materialised(docs: DataFrame) -> DataFrame:
    """The mix as rows: a row for every whole copy that is taken, and the first words of the document at a source's cut.

    A document lies before the cut, at it or after it by its own columns, so the texts meet only
    a table of one row a source and are not shuffled. Rows with the key of the cut are told apart by
    id, size and text; rows that are equal in these as well are counted by their content, partially
    before the shuffle, and as many as the mix takes are made of each. All columns stay, with
    `n_chars` counted anew for the cut ones. Documents without words are not taken.
    """
    edges, small = few(cuts(docs))
    names = [f.name for f in docs.schema.fields]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), hash_key(F.col("doc_id").cast("long")).alias("key"), F.col("source").alias("of"))
    both = packed.join(F.broadcast(edges) if small else edges, F.col("of").eqNullSafe(F.col("source")))
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    tied = F.coalesce(F.col("key") == F.col("cut_key"), F.lit(False))
    tie = F.when(tied, F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), size.alias("size"), F.xxhash64("row.text").alias("mark")))
    both = both.where(F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))).withColumn("tie", tie)
    equal = F.coalesce(F.col("tie") == F.col("cut_tie"), F.lit(False))
    before = F.coalesce((F.col("key") < F.col("cut_key")) | (F.col("tie") < F.col("cut_tie")), F.lit(False))
    full = F.col("whole") + F.when(before, 1).otherwise(0)
    plain = both.where(~equal & (full > 0)).select("row", F.explode(F.sequence(F.lit(1), full.cast("long"))).alias("copy"))
    alike = saved(both.where(equal).groupBy("source", "row", "whole", "cut_nth", "words").agg(F.count("*").alias("n")))
    until = F.sum("n").over(Window.partitionBy("source").orderBy(F.xxhash64("row"), "row"))
    alike = alike.withColumn("first", until - F.col("n"))
    left = F.col("cut_nth") - 1 - F.col("first")
    copies = F.col("whole") * F.col("n") + F.greatest(F.lit(0), F.least(F.col("n"), left))
    whole = alike.select("row", copies.alias("copies")).where("copies > 0")
    whole = whole.select("row", "copies", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("long"), F.lit(CHUNK).cast("long"))).alias("at")).repartition(F.hash("row", "at"))
    whole = whole.select("row", F.explode(F.sequence(F.col("at"), F.least(F.col("copies"), F.col("at") + CHUNK) - 1)).alias("copy"))
    cut = alike.where((left >= 0) & (left < F.col("n")) & (F.col("words") > 0)).select("row", _first_words(F.col("row.text"), F.col("words")).alias("short"))
    kept = plain.unionByName(whole).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
    new = {"text": F.col("short")}
    if "n_chars" in names:
        new["n_chars"] = F.length("short").cast(docs.schema["n_chars"].dataType)
    return kept.unionByName(cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names]))

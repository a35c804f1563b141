"""Hierarchical weighted hash tree over regions, racks and shards.

A key descends from the root: at each level every child draws from a hash of the key and the
child's name, divided by its weight, and the least draw wins, so a child is chosen with its share of
the weight. A node weighs what its children weigh together. A draw depends on nothing but the key,
the child and its weight: a changed weight alters draws on the path to it only, so keys move into
or out of the nodes on that path, and below every other node each key stays where it was.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import running_sums

#: Racks of a region and shards of a rack in the grid that a tree is founded with.
RACKS, SHARDS = 4, 5


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def founded_tree(shards: int, founded: int | None = None) -> list[Leaf]:
    """`shards` equal leaves: a grid of the `founded` first ones (all by default), and a region of its own for each that came later.

    A later shard adds a child to the root and changes no other node, so it takes rows only into itself.
    """
    founded = min(shards, founded or shards)
    grid = [Leaf(i // (RACKS * SHARDS), i // SHARDS, i) for i in range(founded)]
    return grid + [Leaf(i, i, i) for i in range(founded, shards)]


def reweighted(tree: list[Leaf], weights: dict[int, float]) -> list[Leaf]:
    """The tree with other weights for some shards."""
    return [replace(x, weight=weights.get(x.shard, x.weight)) for x in tree]


def _children(tree: list[Leaf]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children (name, weight) of every node that has weight."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for x in tree:
        if x.weight > 0:
            path = ("", f"g{x.region}", f"g{x.region}r{x.rack}", str(x.shard))
            for k in range(3):
                node = levels[k].setdefault(path[k], {})
                node[path[k + 1]] = node.get(path[k + 1], 0.0) + x.weight
    return [{at: list(node.items()) for at, node in level.items()} for level in levels]


def _least(key: Column, children: list[tuple[str, float]]) -> Column:
    """The name of the child with the least draw."""

    def drawn(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws("/", key, child["name"]).cast("binary")), 1, 13)
        unit = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)
        return F.struct((-F.ln(unit) / child["weight"]).alias("draw"), child["name"].alias("name"))

    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.transform(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in children]), drawn))["name"]


def descend(rows: DataFrame, key: Column, tree: list[Leaf], name: str) -> DataFrame:
    """`rows` with `name`, the shard that `key` (null is a key) descends to; null in a tree without weight."""
    at = F.lit("")
    text = F.coalesce(key.cast("string"), F.lit(""))
    rows = rows.withColumn("_at", at)
    for level in _children(tree):
        chosen = F.lit(None).cast("string")
        for node, children in level.items():
            chosen = F.when(F.col("_at") == node, _least(text, children)).otherwise(chosen)
        rows = rows.withColumn("_at", chosen)
    return rows.withColumn(name, F.col("_at").cast("int")).drop("_at")


def shard_rows(docs: DataFrame, shards: int = 40, founded: int | None = None) -> DataFrame:
    """Every row with its shard, its place in it and its shard in a tree of one shard more.

    Law `key`: doc_id and the number of shards decide. `founded` (by default `shards`) is the number
    that the tree was founded with and stays the same while shards are added. `size` is the UTF-8
    bytes of the text (none for null) plus 16; a null text has CRC 0, like an empty one. Null ids
    share one key. Slots number a shard's rows without gaps by a hash of the id, id, CRC and size;
    repeated rows get slots of their own. Only narrow rows are shuffled, to ranges of that order, so
    no task numbers a whole shard. An empty table gives no rows.
    """
    founded = founded or shards
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")).alias("place"), F.lit(1).cast("long").alias("one"),
    )
    rows = descend(descend(rows, F.col("doc_id"), founded_tree(shards, founded), "shard"), F.col("doc_id"), founded_tree(shards + 1, founded), "grown_shard")
    placed = running_sums(rows, "shard", ["place", "doc_id", "text_crc32", "size"], "one")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("before").cast("long").alias("slot"), "grown_shard")

"""URL rules, and a blocked Bloom filter of listed URLs whose hits an exact join confirms."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import BROADCAST_IDS, hot_join, saved

#: Words of a block, bits of a word, and listed URLs a block holds on average (about 12 bits for each).
WORDS, BITS, PER_BLOCK = 8, 32, 21
#: Blocks up to which the filter is broadcast (40 bytes each); a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 200_000
#: Pages of one listed URL from which it is looked up in a broadcast table in the exact join.
HOT = 10_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without `www.`, a final dot or a default port, and path without `.html` or final slashes; null without a host."""
    plain = F.regexp_replace(F.regexp_replace(host, r"\.?(:80|:443)?$", ""), r"^www\.", "")
    return F.when(host != "", F.concat(plain, F.regexp_replace(path, r"(\.html?)?/*$", "")))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The longest rule that fits the host or a parent of it, with a path that the URL's path starts with."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def _bit(url: Column, word: int) -> Column:
    spread = F.xxhash64(url, F.lit("bits"))
    return F.shiftrightunsigned(spread, 5 * word).bitwiseAND(F.lit(BITS - 1)).cast("int")


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of `listed.canon`, built by a partial aggregation."""
    # shiftleft takes a literal count only, so a power of two stands for the bit.
    bits = [F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(BITS)]), _bit(F.col("canon"), w) + 1).alias(f"b{w}") for w in range(WORDS)]
    rows = listed.select(_block(F.col("canon"), blocks).alias("block"), *bits)
    return rows.groupBy("block").agg(*[F.bit_or(f"b{w}").alias(f"w{w}") for w in range(WORDS)])


def maybe_listed(rows: DataFrame, filter_blocks: DataFrame, blocks: int, *, broadcast: bool) -> DataFrame:
    """`rows` with `maybe`: false is certain, true means a possible hit."""
    side = F.broadcast(filter_blocks) if broadcast else filter_blocks
    out = rows.withColumn("block", _block(F.col("canon"), blocks)).join(side, "block", "left")
    hit = F.lit(True)
    for w in range(WORDS):
        power = F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(BITS)]), _bit(F.col("canon"), w) + 1)
        hit = hit & (F.col(f"w{w}").bitwiseAND(power) != 0)
    return out.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{w}" for w in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    `listed` has a column `url`. A rule decides first; else a URL whose canonical form is listed is
    blocked and any other allowed. The filter has no false negatives and the exact join removes
    its false positives, so verdicts do not depend on its size. A list of up to BROADCAST_IDS names
    meets the possible hits in one pass; a longer one by a shuffle of the hits, without hot names. A null url, or one without `://`,
    has an empty host and path, fits no rule and is allowed. Repeated rows are judged each; other
    columns are ignored; empty tables give no rows.
    """
    url = F.col("url")
    names = listed.select(canonical(host_of(url), path_of(url)).alias("canon")).where("canon is not null").distinct()
    names = saved(names)
    blocks = max(1, -(-names.count() // PER_BLOCK))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = rows.select("page_id", "host", "path", rule_of(host, path, rules, "name").alias("rule"), rule_of(host, path, rules, "verdict").alias("ruled"), canonical(host, path).alias("canon"))
    probed = maybe_listed(rows, bloom_blocks(names, blocks), blocks, broadcast=blocks <= BROADCAST_BLOCKS)
    open_ = F.col("maybe") & F.col("ruled").isNull()
    out = ["page_id", "host", "path", "rule"]
    if names.count() <= BROADCAST_IDS:
        named = F.broadcast(names.select(F.col("canon").alias("_listed")))
        exact = probed.join(named, open_ & (F.col("canon") == F.col("_listed")), "left")
        return exact.select(*out, F.coalesce("ruled", F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")).alias("verdict"))
    settled = probed.where(~open_).select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    hits = probed.where(open_)
    found = saved(hits.groupBy("canon").agg(F.count("*").alias("m")).join(names, "canon").withColumn("found", F.lit(True)))
    exact = hot_join(hits, found, ["canon"], "left", F.col("m") > HOT)
    return settled.unionByName(exact.select(*out, F.when(F.col("found"), "block").otherwise("allow").alias("verdict")))


def feed_urls(pages: DataFrame) -> DataFrame:
    """The list that the query uses: URLs seen with a feed's tracking parameter are syndicated copies."""
    return pages.where(F.col("url").rlike(r"[?&]utm_source=feed(&|#|$)")).select("url")

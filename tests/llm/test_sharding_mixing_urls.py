import hashlib
import math
import re
import zlib

import pytest
from lyceum.llm import common, mixing, sharding, url_filter
from pyspark.sql import functions as F


def draw(key, name, weight):
    return -math.log((int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight


def descend(doc_id, tree):
    """The shard of a key, level by level."""
    key, inside = "" if doc_id is None else str(doc_id), [x for x in tree if x.weight > 0]
    for name in (lambda x: f"g{x.region}", lambda x: f"g{x.region}r{x.rack}", lambda x: str(x.shard)):
        weights = {}
        for x in inside:
            weights[name(x)] = weights.get(name(x), 0) + x.weight
        best = min(weights, key=lambda n: draw(key, n, weights[n]))
        inside = [x for x in inside if name(x) == best]
    return inside[0].shard


def test_shards_match_a_plain_descent_and_grow_into_the_new_one_only(docs, monkeypatch):
    monkeypatch.setattr(common, "RANGE_ROWS", 10)
    got = sharding.shard_rows(docs).collect()
    assert len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in got:
        assert r.shard == descend(r.doc_id, sharding.founded_tree(40))
        assert r.grown_shard == descend(r.doc_id, sharding.founded_tree(41, 40))
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
        assert (r.size, r.text_crc32) in {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts[r.doc_id]}
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_every_further_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    for n in (40, 41, 46, 12):
        founded = min(n, 40)
        rows = sharding.descend(ids, F.col("doc_id"), sharding.founded_tree(n, founded), "a")
        rows = sharding.descend(rows, F.col("doc_id"), sharding.founded_tree(n + 1, founded), "b").collect()
        assert {r.b for r in rows if r.a != r.b} == {n}
        assert abs(sum(r.b == n for r in rows) / 3000 - 1 / (n + 1)) < 0.02


def test_weights_confine_movement_to_changed_subtrees(spark):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    tree = sharding.reweighted(sharding.founded_tree(40), {3: 2.0, 11: 0.5, 30: 0.0})
    heavier = sharding.reweighted(tree, {7: 4.0})
    rows = sharding.descend(sharding.descend(ids, F.col("doc_id"), tree, "a"), F.col("doc_id"), heavier, "b").collect()
    for r in rows[:300]:
        assert (r.a, r.b) == (descend(r.doc_id, tree), descend(r.doc_id, heavier))
    assert all(r.a != 30 for r in rows)
    place = {x.shard: (x.region, x.rack) for x in tree}
    moved = [r for r in rows if r.a != r.b]
    assert moved
    for r in moved:
        (a, x), (b, y) = place[r.a], place[r.b]
        # Between regions only into the heavier one, between its racks only into the heavier one, within a rack only to the shard.
        assert b == 0 and (a != b or y == 1) and ((a, x) != (b, y) or r.b == 7)
    for shard, weight in ((3, 2.0), (11, 0.5), (7, 4.0), (25, 1.0)):
        assert abs(sum(r.b == shard for r in rows) / 6000 - weight / (40 + 1 - 0.5 - 1 + 3)) < 0.012


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_sums_match_a_plain_sort(spark, monkeypatch, size):
    monkeypatch.setattr(common, "RANGE_ROWS", size)
    rows = [(k % 3 if k % 5 else None, k % 4, k % 7 + 1) for k in range(60)] + [(1, 2, 5)] * 40
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(4)
    got = [tuple(r) for r in common.running_sums(df, "g", ["o", "v"], "v").collect()]
    want = []
    for g in {r[0] for r in rows}:
        at, total = 0, sum(r[2] for r in rows if r[0] == g)
        for r in sorted(x for x in rows if x[0] == g):
            want.append((*r, at, total))
            at += r[2]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert common.running_sums(df.limit(0), "g", ["o"], "v").count() == 0


def test_empty_tables(empty, spark):
    assert sharding.shard_rows(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.materialised(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages, pages.select("url")).count() == 0


def test_mix_meets_targets_and_materialises_them(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert sum(r.taken for r in rows) == math.floor(rows[0].target + 1e-9)
    made = mixing.materialised(docs)
    assert made.columns == docs.columns
    words = {}
    for r in made.collect():
        words[r.source] = words.get(r.source, 0) + len(re.findall(mixing.WORD, r.text or ""))
        assert r.n_chars == len(r.text)
    for source, rows in by.items():
        assert words[source] == sum(r.taken for r in rows)


def test_mix_reruns_agree(docs):
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


URLS = [
    (1, "http://a.example.net/en/1"), (2, "https://Example.NET/fr/"), (3, "ftp://x.org/fr/2?q#f"), (4, "http://x.org/de/9.html"), (5, None), (6, "no host"),
    (7, "http://www.x.org/de/9/?utm_source=feed"), (8, "http://example.com/de/x"), (9, "http://myexample.com/de/x"), (10, "http://net"), (11, ""), (12, "http://x.org:80/de/9#frag"), (12, "http://x.org:80/de/9#frag"),
]


def test_urls_by_rules_and_list(spark):
    pages = spark.createDataFrame([(*u, "clash", "b") for u in URLS], "page_id long, url string, host string, block string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.feed_urls(pages)).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr/", "net/", "block")
    assert got[3] == ("x.org", "/fr/2", "org/fr/", "allow")
    assert got[4][2:] == (None, "block") and got[7][2:] == (None, "block") and got[12][2:] == (None, "block")
    assert got[5] == got[6] == got[11] == ("", "", None, "allow")
    assert got[8][2:] == ("example.com/de/", "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("net", "", None, "allow")
    assert url_filter.judge_urls(pages, pages.select("url")).count() == len(URLS)


def test_long_lists_are_joined_by_a_shuffle_without_hot_names(spark, monkeypatch):
    pages = spark.createDataFrame([(*u, "clash", "b") for u in URLS] + [(100 + k, "http://x.org/de/9?k", "c", "b") for k in range(30)], "page_id long, url string, host string, block string")
    short = sorted(map(tuple, url_filter.judge_urls(pages, url_filter.feed_urls(pages)).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_IDS", 0)
    monkeypatch.setattr(url_filter, "HOT", 5)
    assert sorted(map(tuple, url_filter.judge_urls(pages, url_filter.feed_urls(pages)).collect())) == short


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    names = spark.range(3000).selectExpr("concat('h', id, '/p') as canon")
    blocks = 3000 // url_filter.PER_BLOCK + 1
    made = url_filter.bloom_blocks(names, blocks)
    for broadcast in (True, False):
        assert url_filter.maybe_listed(names, made, blocks, broadcast=broadcast).where("not maybe").count() == 0
    others = spark.range(20_000).selectExpr("concat('other', id) as canon")
    assert url_filter.maybe_listed(others, made, blocks, broadcast=True).where("maybe").count() < 400


def test_a_repeated_id_loses_no_words(spark):
    rows = [(1, f"w{i % 4} " * 10, "b") for i in range(20)] + [(2, "x " * 5, "a")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix(docs).collect()
    made = mixing.materialised(docs).collect()
    for source in "ab":
        assert sum(r.taken for r in plan if r.source == source) == sum(len(r.text.split()) for r in made if r.source == source)


def test_ties_at_a_cut_are_taken_exactly(spark):
    rows = [(None, f"w{i % 7} " * 10, "a") for i in range(60)] + [(None, "same text of the b " * 2, "b")] * 30 + [(i, "c " * 9, "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix(docs).collect()
    for source in "abc":
        want = sum(r.taken for r in plan if r.source == source)
        got = [len(r.text.split()) for r in mixing.materialised(docs).where(F.col("source") == source).collect()]
        assert sum(got) == want == int(next(r.target for r in plan if r.source == source) + 1e-9)
        assert sorted(got) == sorted(n for r in plan if r.source == source for n in [r.size] * (r.taken // r.size) + [r.taken % r.size] if n)

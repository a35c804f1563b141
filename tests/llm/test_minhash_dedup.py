import re

import numpy as np
import pyarrow as pa
from lyceum.llm import components, minhash_dedup
from lyceum.llm.common import shingle_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Component of each text by comparing all pairs; texts: list of (id, text)."""
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_awkward_rows_match_brute_force(docs):
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)
    nameless = [(r.component_id, r.kept) for r in got if r.doc_id is None]
    assert sorted(nameless, key=str) == [(0, True), (None, True)]


def test_chain_and_dense_group_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 80)]
    texts, drift = [], list(base)
    for i in range(60):
        other = list(base)
        for p in rng.choice(80, 3, replace=False):
            other[p] = f"n{rng.integers(0, 10_000)}"
        texts.append((i, " ".join(other)))
    for i in range(60, 90):
        drift[int(rng.integers(0, 80))] = f"d{i}"
        texts.append((i, " ".join(drift)))
    want = brute(texts)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_empty_table(empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_each_group(docs):
    got = minhash_dedup.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert sum(r.doc_id is None for r in got.collect()) == 2
    assert set(ids) == {i for i, (_, c) in want.items() if c == i}


def test_rows_of_one_id_with_different_texts(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcde"}
    rows = [(3, "b", 1), (5, "a", 2), (5, "b", 3), (7, "c", 4), (7, "d", 5), (9, "c", 6), (8, "d", 7), (7, "c", 4), (7, "c", 9), (None, "e", 8), (None, "e", 8)]
    docs = spark.createDataFrame([(i, text[k], n, "x") for i, k, n in rows], "doc_id long, text string, row long, _drop string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == sorted([(3, 3, True), (5, 5, True), (5, 3, False), (7, 7, True), (7, 7, True), (9, 7, False), (8, 7, False), (7, 7, True), (7, 7, True), (-1, -1, True), (-1, -1, True)])
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.row) for r in kept.collect()) == sorted([(3, 1), (5, 2), (7, 4), (7, 5), (-1, 8), (-1, 8)])


def test_hot_bands_and_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "HOT", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(30):
            other = list(base)
            for p in rng.choice(60, int(rng.integers(0, 4)), replace=False):
                other[p] = f"n{rng.integers(0, 50)}"
            texts.append(" ".join(other))
        texts += [" ".join(base)] * 6
    rows = list(enumerate(texts))
    want = brute(rows)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_groups_of_a_band_are_bounded_and_meet_every_foreign_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 10)
    rng = np.random.default_rng(2)
    comps = {0: [*([7] * 90), *range(100, 160)], 1: [5] * 30, 2: list(range(40))}
    rows = [(band, 1000 * band + k, 50, comp) for band, members in comps.items() for k, comp in enumerate(members)]
    order = rng.permutation(len(rows))
    made = minhash_dedup._blocks(spark.createDataFrame([rows[k] for k in order], "bkey long, node long, n long, comp long")).collect()
    groups = {}
    for r in made:
        groups.setdefault((r.bkey, r.i, r.j), []).append(r)
    assert max(map(len, groups.values())) <= 45 and not any(b == 1 for b, _, _ in groups)
    met = set()
    for members in groups.values():
        c = {name: np.array([getattr(m, name) for m in members]) for name in ("comp", "side", "j", "node")}
        for x in range(len(members)):
            y = np.arange(len(members))
            for z in y[minhash_dedup._foreign(c, np.full(len(y), x), y)]:
                met.add((int(c["node"][x]), int(c["node"][z])))
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3]}
    assert want == met


def test_shingles_agree_with_words():
    texts = ["A b c d e f", "a B", "", None, " x\ty\nz  w v u t ", "a b c d e f"]
    sizes = [len(s) for s in shingle_rows(pa.array(texts))]
    assert sizes == [len(shingles(t)) for t in texts]
    first, last = (list(shingle_rows(pa.array([t])))[0] for t in (texts[0], texts[-1]))
    assert (first == last).all()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = minhash_dedup.signature(x[:3000]), minhash_dedup.signature(x[500:3500])
    assert abs((a == b).mean() - 2500 / 3500) < 0.13


def test_components_of_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0

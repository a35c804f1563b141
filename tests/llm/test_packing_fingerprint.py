import hashlib
import zlib

import numpy as np
import pytest
from lyceum.llm import fingerprint, packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def check(rows, docs, tokenizer):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, texts in docs.items():
        got = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[doc_id])
        total = 0
        for text in texts:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
            total += len(ids)
            at = 0
            while at < len(ids):
                piece = next(p for p in got if p[0] == at and p[3] == len(ids) and zlib.crc32(ids[at : at + p[1]].tobytes()) == p[2])
                got.remove(piece)
                at += piece[1]
        assert not got
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
        assert at == packing.LENGTH or at & (at - 1) == 0


def test_pieces_are_an_exact_round_trip(docs, tokenizer):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    check(packing.pack(docs).collect(), texts, tokenizer)


def test_special_tokens_in_a_text_are_the_named_tokenizer_s_ids(spark, tokenizer):
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]
    assert names
    texts = [f"a {x} b{x}{x}" for x in names] + ["plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.pack(docs).collect(), {i: [t] for i, t in enumerate(texts)}, tokenizer)
    assert any(set(tokenizer.encode(t, add_special_tokens=False).ids) & set(tokenizer.get_added_tokens_decoder()) for t in texts)


def test_many_partitions_merge_in_levels(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 4)
    docs = spark.range(200).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), int(id)) as text").repartition(40)
    check(packing.pack(docs).collect(), {r.doc_id: [r.text] for r in docs.collect()}, tokenizer)


def test_pack_empty(empty):
    assert packing.pack(empty).count() == 0


def test_encoder_matches_the_tokenizer(tokenizer):
    enc = packing.encoder()
    for text in ("", " a  b\n\n c", "don't I'LL 12 345", "éçñ x\u0085y\u001cz", "你好 ١٢ \U0001f600", "<|endoftext|>", "a <|endoftext|> b", "a" * 5000):
        assert enc.ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("size", [1_000, 1 << 24])
def test_fingerprints_match_brute_force(spark, docs, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", size)
    monkeypatch.setattr(fingerprint, "SAMPLE", 2)
    hot = spark.createDataFrame([(77, f"t{k % 9}" * (k % 9)) for k in range(60)] + [(None, "same")] * 40 + [(None, f"n{k}" * 30) for k in range(40)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(hot)
    got = fingerprint.fingerprint_rows(docs).collect()
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text")).collect()
    rows = sorted(((r.doc_id, r.mark, r.text) for r in marked), key=lambda r: (-r[0] if r[0] is not None else 1e30, r[1]))
    want = []
    for k, (doc_id, _, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        edit = fingerprint.edited(text, after).encode()
        a, b, c = fingerprint.fingerprint(text.encode()), fingerprint.fingerprint(edit), fingerprint.fingerprint(after.encode())
        want.append((doc_id, len(text), hashlib.sha256(edit).hexdigest(), a.hex(), b.hex(), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fingerprint_of_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    r = fingerprint.fingerprint_rows(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0
    assert fingerprint.fingerprint_rows(empty).count() == 0


def test_likeness_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.9):
        raw = rng.integers(97, 123, 30_000, dtype=np.uint8).tobytes()
        other = raw[: int(len(raw) * share)] + rng.integers(97, 123, len(raw) - int(len(raw) * share), dtype=np.uint8).tobytes()
        true = share / (2 - share)
        assert abs(fingerprint.likeness(fingerprint.fingerprint(raw), fingerprint.fingerprint(other)) - true) < 0.12
    assert fingerprint.likeness(b"", b"") == 1.0 and fingerprint.likeness(b"", fingerprint.fingerprint(b"x")) == 0.0
    assert len(fingerprint.fingerprint(b"x")) == fingerprint.BINS * fingerprint.LOW_BITS // 8

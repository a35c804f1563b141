import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lyceum.llm import chroma, langid, pii, quality
from lyceum.llm.common import text_buffer


def plain_code_length(samples, text):
    """Bits of a text under order-3 contexts with escapes, byte by byte."""
    seen = [defaultdict(Counter) for _ in range(4)]
    for raw in samples:
        raw = b"\n\n\n" + raw
        for i in range(3, len(raw)):
            for k in range(4):
                seen[k][raw[i - k : i]][raw[i]] += 1
    raw, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0):
            c = seen[k][raw[i - k : i]]
            n, kinds = sum(c.values()), len(c)
            if raw[i] in c:
                bits -= math.log2(c[raw[i]] / (n + kinds))
                break
            if n:
                bits -= math.log2(kinds / (n + kinds))
        else:
            bits += 8
    return bits


def test_table_gives_exact_code_lengths():
    samples = {"a": [b"the cat sat on the mat", b"the rat"], "b": ["der Hund läuft über".encode(), b"die Katze"]}
    model = langid.train(samples | {"none": [b"", b""]})
    assert model.langs == ["a", "b"]
    texts = ["the hat", "die über", "", "q", "üq zz", "the cat sat on the mat and more"]
    raw, offsets = text_buffer(pa.array(texts))
    got = langid.code_lengths(model, raw, offsets)
    for k, text in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert got[k, j] == pytest.approx(plain_code_length(samples[lang], text.encode()), rel=1e-4, abs=1e-4)


def test_many_languages_keep_every_context(monkeypatch):
    rng = np.random.default_rng(3)
    samples = {f"l{k:02d}": [rng.integers(97, 123, 60, dtype=np.uint8).tobytes() for _ in range(3)] for k in range(20)}
    model = langid.train(samples)
    assert len(model.groups) == 3
    texts = [samples[x][0].decode() for x in sorted(samples)] + ["zz top"]
    got = langid.code_lengths(model, *text_buffer(pa.array(texts)))
    assert got[:-1].argmin(axis=1).tolist() == list(range(20))
    for k in (0, 9, 20):
        for j in (0, 7, 8, 19):
            assert got[k, j] == pytest.approx(plain_code_length(samples[model.langs[j]], texts[k].encode()), rel=1e-4)


def test_predictions_match_a_plain_model(spark):
    rng = np.random.default_rng(5)
    parts = {"x": ["tion", "the", "and", "ing"], "y": ["sch", "der", "und", "ein"], "z": [""]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(8)) if lang != "z" else "", lang) for i, lang in enumerate(["x", "y", "x", "y", "x", "y", "z"] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    learned = {lang: [t.encode() for i, t, x in rows if x == lang and not held[i]] for lang in "xy"}
    assert all(learned.values()) and any(not held[i] for i, _, x in rows if x == "z")
    for r in langid.identify(docs).collect():
        text = rows[r.doc_id][1]
        assert r.held_out == held[r.doc_id]
        if not text:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        bits = {lang: plain_code_length(samples, text.encode()) for lang, samples in learned.items()}
        assert r.lang_pred == min(sorted(bits), key=bits.__getitem__)
        size = len(text.encode())
        odds = sum(2 ** (-(b - min(bits.values())) / size * min(size, 64)) for b in bits.values())
        assert r.score == pytest.approx(1 / odds, rel=1e-3)


def test_rejections_rest_on_texts_that_were_not_counted(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(["tion", "the", "and", "ing", "er"], 2))
    rows = [(i, " ".join(word() for _ in range(40)), "x") for i in range(120)]
    rows += [(500 + i, "".join(chr(c) for c in rng.integers(33, 127, 400)), None) for i in range(5)]
    kept = {r.doc_id: r.lang for r in langid.known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(kept) == set(range(120))


def test_languages_of_awkward_rows(docs, empty, spark):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    by = {r.doc_id: r for r in got}
    assert by[6].lang_pred == by[7].lang_pred == by[8].lang_pred == by[11].lang_pred == "und"
    assert langid.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"
    kept = langid.known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({6, 7, 8, 11})
    assert langid.known(unlabelled).count() == 1


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    parts = {"x": ["tion", "the", "and", "ing"], "y": ["sch", "der", "und", "ein"], "z": ["que", "los", "ado", "ente"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(12)), lang) for i, lang in enumerate(["x", "y", "z"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    want = {r[0]: r[2] for r in rows}
    assert len(got) > 20 and sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.95 * len(got)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(4)
    pieces = ["a.b@c.de", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+12", "é", "-", ".", "9", " ", "\n", "%+", "00000000000000"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 9)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000])
def test_base_spans_of_long_runs_take_linear_time(text):
    pii.base_spans(text)


def test_tagger_learns_and_adds_disguised_spans():
    model = pii.trained()
    rng = np.random.default_rng(99)
    hit = total = 0
    for _ in range(150):
        text, spans = pii.labelled(rng)
        found = pii.find(model, [text])[0][1]
        total += len(spans)
        hit += sum(any(k == kind and a <= start + 2 and b >= end - 2 for a, k, b in found) for start, kind, end in spans)
    assert hit >= 0.9 * total
    base, spans = pii.find(model, ["call ann (at) mail (dot) com or (555) 123-4567 now"])[0]
    assert base == [] and {k for _, k, _ in spans} == {0, 3}
    assert pii.find(model, ['version 3.0, token = "0123456789abcdef0123456789abcdef01234567", year 1999'])[0] == ([], [])


def test_both_directions_run_together_as_a_plain_network():
    model = pii.Tagger(5)
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 130, n).astype(np.int32) for n in (7, 40, 1, 40, 23)]
    for piece, got in zip(pieces, model.scores(pieces), strict=True):
        states = model.states(piece[:, None])[0][:, 0]
        assert np.allclose(got, states @ model.p["w"] + model.p["b"], atol=1e-5)


def test_margins_are_run_only_where_they_warm_up(monkeypatch):
    model, rng, steps, run = pii.Tagger(6), np.random.default_rng(8), [], pii._run
    monkeypatch.setattr(pii, "_run", lambda x, *rest: steps.append(len(x)) or run(x, *rest))
    pieces = [rng.integers(0, 130, n).astype(np.int32) for n in (90, 90, 50, 33)]
    kept = [(20, 70), (20, 70), (9, 40), (8, 33)]
    whole, parts = model.scores(pieces), model.scores(pieces, kept)
    for all_of_it, part, (a, b) in zip(whole, parts, kept, strict=True):
        assert np.allclose(part, all_of_it[a:b], atol=1e-6)
    assert steps == [90, 70]
    steps.clear()
    pii.tags(model, ["ab " * 1000])
    # Every window is run, but none that has a neighbour on both sides needs all its steps both ways.
    assert steps == [pii.WINDOW]
    pii.tags(model, ["ab " * 1000], chunk=1)
    assert sum(steps[2:-1]) == (len(steps) - 3) * (pii.WINDOW - pii.MARGIN)


def test_gates_far_from_zero_neither_overflow_nor_lose_their_value():
    model, rng = pii.Tagger(7), np.random.default_rng(3)
    for k in ("xf", "xb"):
        model.p[k] = model.p[k] * np.float32(400)
    pieces = [rng.integers(0, 130, n).astype(np.int32) for n in (60, 31)]
    for piece, got in zip(pieces, model.scores(pieces), strict=True):
        assert np.allclose(got, model.states(piece[:, None])[0][:, 0] @ model.p["w"] + model.p["b"], atol=1e-4)


def test_equal_texts_are_judged_once_and_passes_are_filled(monkeypatch):
    passes = []
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int8))
    monkeypatch.setattr(pii, "PASS_CHARS", 10)
    monkeypatch.setattr(pii, "tags", lambda model, texts: passes.append(list(texts)) or [empty] * len(texts))
    texts = ["a@b.cd", "xyz", "a@b.cd", "", "x" * 30, "1.2.3.4", "xyz", "qq"]
    found = pii.find(None, texts)
    assert passes == [["a@b.cd", "xyz", ""], ["x" * 30], ["1.2.3.4", "qq"]]
    assert [base for base, _ in found] == [pii.base_spans(t) for t in texts] == [spans for _, spans in found]
    assert pii.find(None, []) == []


def test_long_stretches_are_decoded_block_by_block(monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = np.random.default_rng(22)
    for k in range(60):
        model = pii.Tagger(k)
        model.p["trans"] = (rng.normal(0, 2, (5, 5)) + np.eye(5)).astype(np.float32)
        model.p["first"] = rng.normal(0, 2, 5).astype(np.float32)
        sizes = rng.integers(1, 20, 5)
        e = rng.normal(0, 2, (sizes.sum(), 5)).astype(np.float32)
        opening, closing = rng.random(5) < 0.5, rng.random(5) < 0.5
        got, at = model.decoded(e, sizes, opening, closing), 0
        for n, opens, closes in zip(sizes, opening, closing, strict=True):
            def score(path, at=at, opens=opens, closes=closes, model=model, e=e):
                ends = (model.p["first"] if opens else model.p["trans"][0])[path[0]] + (0 if closes else model.p["trans"][path[-1], 0])
                return ends + sum(e[at + i, x] for i, x in enumerate(path)) + sum(model.p["trans"][x, y] for x, y in zip(path, path[1:]))

            best = (model.p["first"] if opens else model.p["trans"][0]) + e[at].astype(float)
            for x in e[at + 1 : at + n]:
                best = (best[:, None] + model.p["trans"]).max(0) + x
            assert score(got[at : at + n]) == pytest.approx((best + (0 if closes else model.p["trans"][:, 0])).max(), abs=1e-4)
            at += n


def test_batches_of_whole_texts_and_recordings_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    vectors = spark.createDataFrame([(i, [float(i % 7 - 3), 1.0] * 32) for i in range(600)], "vec_id long, embedding array<double>").coalesce(1)
    media = chroma.recordings(vectors)
    assert max(r.n for r in media.mapInArrow(sizes, "n long").collect()) < 10 << 20
    assert media.where("pcm is not null").count() == 600


def test_decoding_finds_the_best_of_all_paths():
    rng = np.random.default_rng(21)
    for k in range(60):
        model = pii.Tagger(k)
        model.p["trans"] = (rng.normal(0, 2, (5, 5)) + 3 * np.eye(5)).astype(np.float32)
        model.p["first"] = rng.normal(0, 2, 5).astype(np.float32)
        sizes = rng.integers(1, 6, 4)
        base = np.concatenate([[0], np.cumsum(sizes)])
        e = rng.normal(0, 2, (base[-1], 5)).astype(np.float32)
        e[:, 0] += rng.choice([0, 4, 8])
        place, tag = model.decode(e, base)
        got = np.zeros(base[-1], int)
        got[place] = tag
        for a, b in zip(base, base[1:]):
            def score(path, a=a, model=model, e=e):
                return model.p["first"][path[0]] + sum(e[a + i, x] for i, x in enumerate(path)) + sum(model.p["trans"][x, y] for x, y in zip(path, path[1:]))

            best = max(itertools.product(range(5), repeat=int(b - a)), key=score)
            assert score(got[a:b]) == pytest.approx(score(best), abs=1e-4)


def plain_scores(model, text):
    """Scores of each character of a text from the window in which it lies farthest from an edge, by a plain LSTM."""
    step = pii.WINDOW - 2 * pii.MARGIN
    starts = [k for k in range(0, len(text), step) if k == 0 or k + 2 * pii.MARGIN < len(text)]
    sym, out = pii.symbols(text), np.full((len(text), 5), np.nan)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    h_size = pii.HIDDEN
    for n, start in enumerate(starts):
        piece = sym[start : start + pii.WINDOW]
        both = []
        for way, order in (("f", piece), ("b", piece[::-1])):
            h = c = np.zeros(h_size)
            states = []
            for x in order:
                z = model.p["x" + way][x] + h @ model.p["u" + way]
                i, f, o, g = sigmoid(z[:h_size]), sigmoid(z[h_size : 2 * h_size]), sigmoid(z[2 * h_size : 3 * h_size]), np.tanh(z[3 * h_size :])
                c = f * c + i * g
                h = o * np.tanh(c)
                states.append(h)
            both.append(np.array(states[:: 1 if way == "f" else -1]))
        e = np.concatenate(both, axis=1) @ model.p["w"] + model.p["b"]
        a = pii.MARGIN if n else 0
        out[start + a : start + len(piece)] = e[a:]  # the next window overwrites the far margin
    return out


def test_windows_of_whole_texts_are_reconciled_by_one_decoding(monkeypatch):
    monkeypatch.setattr(pii, "WINDOW", 60)
    monkeypatch.setattr(pii, "MARGIN", 8)
    model, rng = pii.trained(), np.random.default_rng(31)
    texts = [" ".join(pii.labelled(rng)[0] for _ in range(k)) for k in (1, 0, 2, 1)] + ["x" * 44, "x" * 45, "1" * 200, "é"]
    for text, (place, tag) in zip(texts, pii.tags(model, texts, chunk=5), strict=True):
        if not text:
            assert not len(place)
            continue
        e = plain_scores(model, text)
        back, best = [], e[0] + model.p["first"]
        for x in e[1:]:
            step = best[:, None] + model.p["trans"]
            back.append(step.argmax(0))
            best = step.max(0) + x
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        got = np.zeros(len(text), int)
        got[place] = tag
        assert got.tolist() == path[::-1]


def test_precision_and_recall_of_each_kind_on_planted_spans():
    model, rng = pii.trained(), np.random.default_rng(77)
    planted = [pii.labelled(rng) for _ in range(300)]
    hit, total, right, found, base_hit = (Counter() for _ in range(5))
    for (_, spans), (base, spans_found) in zip(planted, pii.find(model, [t for t, _ in planted]), strict=True):
        near = lambda s, many: any(k == s[1] and abs(a - s[0]) <= 2 and abs(b - s[2]) <= 2 for a, k, b in many)
        for s in spans:
            total[s[1]] += 1
            hit[s[1]] += near(s, spans_found)
            base_hit[s[1]] += near(s, base)
        for s in spans_found:
            found[s[1]] += 1
            right[s[1]] += near(s, spans)
    for kind in range(4):
        assert hit[kind] >= 0.93 * total[kind] and right[kind] >= 0.93 * found[kind] and hit[kind] > base_hit[kind] + 0.2 * total[kind]


def test_gradients_are_those_of_the_likelihood():
    model = pii.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii._SYMBOLS, (6, 3)), rng.integers(0, 5, (6, 3))
    _, grad = model.gradients(x, y)
    for name in ("w", "trans", "first", "uf", "ub"):
        at = tuple(rng.integers(0, n) for n in model.p[name].shape)
        old, step = model.p[name][at], 1e-3
        model.p[name][at] = old + step
        up = model.gradients(x, y)[0]
        model.p[name][at] = old - step
        down = model.gradients(x, y)[0]
        model.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_personal_data_of_awkward_rows(spark, docs, empty):
    got = pii.personal_data(docs).collect()
    assert len(got) == docs.count()
    assert pii.personal_data(empty).count() == 0
    one = spark.createDataFrame([(1, "x a.b@c.de y", 12, "z"), (2, None, None, "z"), (3, "clean", 5, "z")], "doc_id int, text string, n_chars long, spans string")
    rows = {r.doc_id: r for r in pii.redact(one).collect()}
    assert rows[1].text == "x <email> y" and rows[1].n_chars == 11 and rows[2].text is None and rows[3].text == "clean"
    assert {r.doc_id: r.spans for r in pii.personal_data(one).collect()} == {1: "email:2:10", 2: "", 3: ""}


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(6)
    good = rng.random(20_000) < 0.8
    right = np.array([0.9, 0.8, 0.95, 0.7, 0.85, 0.9, 0.75, 0.8])
    patterns = np.zeros(len(good), np.int64)
    for k, r in enumerate(right):
        vote = np.where((rng.random(len(good)) < r) == good, 2, 0)
        vote[rng.random(len(good)) < 0.3] = 1
        patterns += vote * 3**k
    kinds, counts = np.unique(patterns, return_counts=True)
    model = quality.estimate(kinds, counts.astype(float))
    assert np.abs(np.array(list(model.accuracy().values())) - right).max() < 0.03
    assert ((model.posterior(patterns) >= 0.5) == good).mean() > 0.95


def plain_votes(text):
    """The vote of each labeller on one text, by its words, lines and characters."""
    raw = (text or "").encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    n, size = len(ws), max(len(raw), 1)
    upper, lower, high = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw), sum(b >= 128 for b in raw)
    symbols, marks = sum(b in b"#$%&*|<>{}\\^~=" for b in raw), raw.count(b"!")
    repeats = sum(a == b for a, b in zip(ws, ws[1:])) / max(n, 1)
    variety = len(set(ws)) / n if n > 1 else 1
    fresh = len(set(lines)) / len(lines) if len(lines) > 1 else 1
    letters, cased = (upper + lower + high) / size, max(upper + lower, 1)
    judge = lambda bad, good: 0 if bad else 2 if good else 1
    return [
        judge(symbols > 0.03 * size, symbols == 0), judge(upper > 0.5 * cased, upper < 0.15 * cased), judge(repeats > 0.2, repeats < 0.05), judge(n >= 50 and variety < 0.4, n >= 50 and variety > 0.6),
        judge(len(lines) >= 4 and fresh < 0.6, len(lines) >= 2 and fresh == 1), judge(marks > 0.2 * max(n, 1), False), judge(letters < 0.7, letters > 0.78), judge(n < 1, n >= 30),
    ], [repeats, 1 - fresh, 10 * symbols / size, upper / cased], ws


def plain_label_model(votes, rounds=60):
    """Expectation-maximisation over single documents."""
    good = [1 / (1 + math.exp(-1.5 * (sum(v - 1 for v in d) - 3 * d.count(0)))) for d in votes]
    for _ in range(rounds):
        sides = [[1 - g for g in good], good]
        prior = min(max((sum(good) + 1) / (len(good) + 2), 0.01), 0.99)
        table = []
        for k in range(8):
            row = []
            for side in sides:
                count = [sum(w for w, d in zip(side, votes) if d[k] == v) for v in (0, 2)]
                row.append([(c + 0.5) / (sum(count) + 1) for c in count])
            table.append(row)
        good = []
        for d in votes:
            odds = [math.log(1 - prior), math.log(prior)]
            for k, v in enumerate(d):
                if v != 1:
                    odds = [o + math.log(table[k][c][v // 2]) for c, o in enumerate(odds)]
            good.append(1 / (1 + math.exp(odds[0] - odds[1])))
    return good


def test_quality_matches_a_plain_version(spark, docs):
    rng = np.random.default_rng(13)
    texts = [r.text for r in docs.select("text").collect() if r.text is None or len(r.text) < 20_000]
    texts += [" ".join(rng.choice(["spam", "spam!!", "SHOUT", "x%%", "word", "other", "fine"], int(rng.integers(1, 90)))) + str(rng.choice(["", "\n", "\nline\nline\nline\nline"])) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [plain_votes(t) for t in texts]
    want = {i: sum(v * 3**k for k, v in enumerate(p[0])) for i, p in enumerate(plain)}
    rows = {r.doc_id: r for r in quality.classify(frame).collect()}
    assert {i: r.votes for i, r in rows.items()} == want
    for i, g in enumerate(plain_label_model([p[0] for p in plain])):
        assert rows[i].posterior == pytest.approx(g, abs=1e-6)
    _, _, scorer = quality.fit(frame)
    mask, mix = np.uint64(quality.BINS - 1), lambda x: quality.mix64(np.array([x], np.uint64))[0]

    def hashed(word):
        raw = np.frombuffer(word, np.uint8)
        return quality.window_hashes(raw, np.array([0]), np.array([len(raw)]))[0]

    for i in range(0, len(texts), 3):
        _, shape, ws = plain[i]
        total = scorer.bias + sum(scorer.weights[int(mix(np.uint64(k) + np.uint64(1)) & mask)] * v for k, v in enumerate(shape))
        for w in ws:
            total += (scorer.weights[int(mix(hashed(w) + np.uint64(1)) & mask)] + scorer.weights[int(mix(hashed(w[-3:]) + np.uint64(2)) & mask)]) / len(ws)
        assert rows[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_quality_of_awkward_rows(docs, empty):
    got = quality.classify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(empty).count() == 0


def test_quality_finds_weak_texts(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["an", "the", "er", "ti", "on", "ou", "re", "st", "ha", "nd", "wh", "ly"], rng.integers(2, 5)))
    rows = []
    for i in range(300):
        text = " ".join(word() for _ in range(80)) + ".\n" + " ".join(word() for _ in range(30)) + "."
        weak = i % 6 == 0
        if weak:
            text = " ".join(w + "%%%" for w in text.split()) if i % 12 else (word() + " ") * 120
        rows.append((i, text, weak))
    got = {r.doc_id: r.kept for r in quality.classify(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert sum(got[i] != weak for i, _, weak in rows) >= 285


def vectors(rng):
    base = rng.normal(size=64)
    near = base.copy()
    near[:4] = rng.normal(size=4)
    shifted = np.concatenate([rng.normal(size=10), base[:54]])
    rows = [(20, base), (21, base), (22, near), (23, shifted), (24, np.zeros(64)), (25, [])] + [(100 + i, rng.normal(size=64)) for i in range(40)]
    return [(i, [float(x) for x in v]) for i, v in rows] + [(26, None), (21, [float(x) for x in base]), (None, [float(x) for x in base])]


def test_recordings_are_aligned(spark):
    rows = vectors(np.random.default_rng(9))
    media = chroma.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = chroma.match_recordings(media).collect()
    assert len(got) == len(rows)
    by = {r.rec_id: r for r in got}
    assert by[21].class_id == by[20].class_id == 20 and by[21].match_id != 20
    assert by[22].match_id == 20 and by[22].offset == 0 and by[22].bit_error < 0.2
    assert by[23].match_id == 20 and by[23].offset == -10
    assert by[24].class_id is None and by[25].fingerprint == "" and by[26].n_frames == 0


def test_every_match_of_a_recording_is_listed(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    rows = [(1, base)] + [(20 * k, np.concatenate([base[:60], rng.normal(size=4)])) for k in range(1, 6)]
    rows += [(3, base), (7, rng.normal(size=64))]
    media = chroma.recordings(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>"))
    by = {r.rec_id: r for r in chroma.match_recordings(media).collect()}
    assert {x.match_id for x in by[1].links} == {20, 40, 60, 80, 100} and by[1].n_links == by[3].n_links == 5
    assert {x.match_id for x in by[40].links} == {20, 60, 80, 100}
    assert by[1].links[0].match_id == by[1].match_id and by[3].class_id == 1 and by[3].links is None
    assert by[7].n_links == 0 and by[7].links == []


def test_short_overlaps_do_not_displace_a_match(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    near = base.copy()
    near[20:23] = rng.normal(size=3)
    rows = [(1, base), (20, near)] + [(40 + 20 * k, np.concatenate([base[-(9 + k) :], rng.normal(size=55 - k)])) for k in range(4)]
    media = spark.createDataFrame([(i, chroma.tones(v)) for i, v in rows], "rec_id long, pcm binary")
    got = {r.rec_id: r for r in chroma.match_recordings(media).collect()}[1]
    assert (got.match_id, got.offset, got.n_links) == (20, 0, 1)
    assert chroma.least_overlap(57, 57) == 29 and chroma.least_overlap(10, 57) == 8 and chroma.least_overlap(3, 57) == 3


def brute_matches(marks):
    """Pairs of rows that align at some offset, by comparing all of them at all offsets."""
    out = set()
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            for k in range(1 - len(b), len(a)):
                x, y = a[max(0, k) :], b[max(0, -k) :]
                w = min(len(x), len(y))
                if i != j and w >= chroma.least_overlap(len(a), len(b)) and np.bitwise_count(x[:w] ^ y[:w]).sum() <= chroma.MATCH * 32 * w:
                    out.add((i, j))
    return out


def test_noisy_copies_are_found_as_by_brute_force(spark):
    rng = np.random.default_rng(4)
    bases = rng.normal(size=(12, 64))
    rows = [b + rng.normal(size=64) * noise for b in bases for noise in (0, 0.05, 0.1, 0.2)]
    media = chroma.recordings(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()
    marks = [chroma.packed(chroma.chroma(np.frombuffer(r.pcm, "<i2"))) for r in sorted(media, key=lambda r: r.rec_id)]
    want = brute_matches(marks)
    got = {(x.match_id, r.rec_id) for r in chroma.match_recordings(spark.createDataFrame(media), every=1).collect() for x in r.links}
    whole = {(i, j) for i, j in want if not set(marks[i].tolist()) & set(marks[j].tolist())}
    assert got <= want and len(got & want) >= 0.95 * len(want)
    assert whole and len(got & whole) >= 0.9 * len(whole)


def test_integral_image_filters_match_plain_sums():
    rng = np.random.default_rng(1)
    image = rng.random((20, 12)).astype(np.float32)
    got = chroma.packed(image)
    for t in (0, 5, len(got) - 1):
        value = 0
        for shape, y, height, width in chroma.filters():
            box = image[t : t + width, y : y + height].astype(float)
            whole, half, mid = box.sum(), width // 2, height // 2
            a = (box[:half].sum(), box[:, :mid].sum(), box[:half, :mid].sum() + box[half:, mid:].sum(), box[:, 1:3].sum())[shape]
            ratio = math.log((0.05 + a) / (0.05 + whole - a))
            level = (ratio > -0.6) + (ratio > 0) + (ratio > 0.6)
            value = (value << 2) | (level ^ (level >> 1))
        assert value == got[t]


def test_recordings_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert chroma.match_recordings(chroma.recordings(none)).count() == 0

"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions, all in numpy.

The tagger learns from labelled spans that a seeded generator writes: plain and disguised e-mail
addresses, addresses of machines, card and phone numbers in many notations, and look-alikes. It
scores every character of every text in overlapping windows; each character takes the scores of the
window in which it lies farthest from an edge, and one decoding runs over these scores of the whole
text. Characters that no best path can tag are recognised by their margin over any transitions, so
only the stretches between them are decoded, with the same result. Spans of the tagger that overlap
a base span, or lack what their kind needs, are dropped; base spans stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and of the margin at its edges that a neighbouring window decides.
WINDOW, MARGIN = 384, 20
#: Characters of the texts that one pass scores; a longer single text is a pass of its own.
PASS_CHARS = 1 << 19
#: Steps of the network whose states are kept at once.
STEPS = 32
#: Characters of a stretch that are decoded one after another.
BLOCK = 64
#: Hidden units each way, training batches, windows in a batch, characters of a training window, seed.
HIDDEN, BATCHES, BATCH, LEARNED, SEED = 16, 240, 64, 112, 20240607

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"@|[\[(] ?at ?[\])]")
_DIGITS = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost non-overlapping in each kind; linear in the text."""
    out: list[tuple[int, int, int]] = []
    at, stop = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > stop and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                stop = domain.end()
                out.append((start, 0, stop))
        at = text.find("@", max(at + 1, stop))
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:] if len(x) > 4 else x) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


# ---- labelled spans ----


def _word(rng: np.random.Generator) -> str:
    parts = ("an", "the", "er", "ti", "on", "ver", "un", "la", "que", "des", "lo", "mi", "ka", "sch", "ez", "ou", "é", "ü", "ñ", "re", "st", "wh", "a", "o")
    w = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 5)))
    return w.capitalize() if rng.random() < 0.1 else w


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(str(x) for x in rng.integers(0, 10, n))


def _card(rng: np.random.Generator) -> str:
    body = str(rng.integers(3, 7)) + _number(rng, int(rng.choice([13, 14, 14, 14, 17])))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _email(rng: np.random.Generator) -> str:
    name = "".join(_word(rng) for _ in range(rng.integers(1, 3))).encode("ascii", "ignore").decode() or "a"
    name += ("." + _number(rng, 2)) * bool(rng.random() < 0.4)
    host = [x.encode("ascii", "ignore").decode() or "x" for x in (_word(rng), _word(rng))][: rng.integers(1, 3)]
    host.append(str(rng.choice(["com", "org", "net", "example.com", "de", "fr"])))
    style = rng.random()
    if style < 0.6:
        return name + "@" + ".".join(host)
    if style < 0.75:
        return name + " @ " + ".".join(host)
    opened, closed = ("(", ")") if style < 0.88 else ("[", "]")
    return f"{name} {opened}at{closed} " + f" {opened}dot{closed} ".join(host)


def _ip(rng: np.random.Generator) -> str:
    return str(rng.choice([".", ".", ".", "[.]", " . "])).join(str(x) for x in rng.integers(0, 256, 4))


def _phone(rng: np.random.Generator) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    forms = (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_number(rng, 2)} {a} {b} {c}", f"00{a[:2]} {b} {c} {_number(rng, 2)}", f"+1.{a}.{b}.{c}", f"1-{a}-{b}-{c}")
    return str(forms[rng.integers(0, len(forms))])


def _spread(rng: np.random.Generator, digits: str) -> str:
    sep = str(rng.choice(["", "", " ", "-", ".", "/"]))
    return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _decoy(rng: np.random.Generator) -> str:
    k = rng.integers(0, 8)
    return (
        f'token = "{rng.bytes(20).hex()}"', f"version {rng.integers(0, 20)}.{rng.integers(0, 9)}", str(rng.integers(1900, 2030)), _number(rng, int(rng.integers(1, 8))),
        f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1990, 2030)}", f"{rng.integers(0, 24)}:{_number(rng, 2)}", f"@{_word(rng)}", f"CC BY-NC {rng.integers(1, 5)}.0",
    )[k]


def labelled(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its labelled spans (start, kind number, end)."""
    text, spans = "", []
    for _ in range(rng.integers(2, 5)):
        text += " ".join(_word(rng) for _ in range(rng.integers(1, 12))) + str(rng.choice([" ", " ", " ", ". ", ", ", "\n"]))
        kind = int(rng.integers(0, 7))
        piece = (_email, _ip, lambda r: _spread(r, _card(r)), _phone)[kind](rng) if kind < 4 else _decoy(rng)
        if kind < 4:
            spans.append((len(text), kind, len(text) + len(piece)))
        text += piece + str(rng.choice([" ", " ", ". ", ", ", "\n", "*** "]))
    return text + " ".join(_word(rng) for _ in range(rng.integers(1, 12))), spans


# ---- the tagger ----

#: Input symbols: ASCII, other letters, other characters, outside of the text.
_LETTER, _OTHER, _PAD, _SYMBOLS = 128, 129, 130, 131
_TAGS = len(KINDS) + 1


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, np.where((codes >= 0xC0) & (codes < 0x2000), _LETTER, _OTHER)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(inputs: np.ndarray, hidden: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States [time, row, unit] of gates `inputs` [time, row, 4 * unit]."""
    steps, rows, width = inputs.shape
    units = width // 4
    h = c = np.zeros((rows, units), np.float32)
    out, tape = np.empty((steps, rows, units), np.float32), []
    for t in range(steps):
        z = inputs[t] + h @ hidden
        gates, new = _sigmoid(z[:, : 3 * units]), np.tanh(z[:, 3 * units :])
        before = c
        c = gates[:, units : 2 * units] * before + gates[:, :units] * new
        squashed = np.tanh(c)
        if keep:
            tape.append((h, before, gates, new, squashed))
        h = out[t] = gates[:, 2 * units :] * squashed
    return out, tape


def _lstm_back(grad: np.ndarray, tape: list, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of `hidden`."""
    steps, rows, units = grad.shape
    dh = dc = np.zeros((rows, units), np.float32)
    dz, du = np.empty((steps, rows, 4 * units), np.float32), np.zeros_like(hidden)
    for t in reversed(range(steps)):
        h, before, gates, new, squashed = tape[t]
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        z = dz[t]
        z[:, :units] = dc * new * i * (1 - i)
        z[:, units : 2 * units] = dc * before * f * (1 - f)
        z[:, 2 * units : 3 * units] = dh * squashed * o * (1 - o)
        z[:, 3 * units :] = dc * i * (1 - new**2)
        du += h.T @ z
        dh, dc = z @ hidden.T, dc * f
    return dz, du


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters: input gates of each symbol and direction, recurrent weights, output weights, transitions."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "xf": rng.normal(0, 0.3, (_SYMBOLS, 4 * HIDDEN)), "xb": rng.normal(0, 0.3, (_SYMBOLS, 4 * HIDDEN)),
            "uf": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), "ub": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)),
            "w": rng.normal(0, 0.2, (2 * HIDDEN, _TAGS)), "b": np.zeros(_TAGS), "trans": np.eye(_TAGS), "first": np.zeros(_TAGS),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, list]:
        """Both directions' states for symbols [time, row]."""
        f, tape_f = _lstm(self.p["xf"][x], self.p["uf"], keep)
        b, tape_b = _lstm(self.p["xb"][x[::-1]], self.p["ub"], keep)
        return np.concatenate([f, b[::-1]], axis=2), tape_f, tape_b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood per character of labels y [time, row] under the CRF, and its gradients."""
        steps, rows = x.shape
        s, tape_f, tape_b = self.states(x, True)
        e, trans = s @ self.p["w"] + self.p["b"], self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["first"]
        for t in range(1, steps):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        r = np.arange(rows)
        gold = self.p["first"][y[0]] + e[np.arange(steps)[:, None], r, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        scale = 1.0 / (steps * rows)
        de = np.exp(alpha + beta - z[:, None])
        g = {"first": de[0].sum(0)}
        np.add.at(g["first"], y[0], -1)
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        g["trans"] = pair.sum((0, 1))
        np.add.at(g["trans"], (y[:-1].ravel(), y[1:].ravel()), -1)
        de[np.arange(steps)[:, None], r, y] -= 1
        g["w"], g["b"] = np.tensordot(s, de, ((0, 1), (0, 1))), de.sum((0, 1))
        ds = de @ self.p["w"].T
        for way, tape, d, sym in (("f", tape_f, ds[:, :, :HIDDEN], x), ("b", tape_b, ds[::-1, :, HIDDEN:], x[::-1])):
            dz, g["u" + way] = _lstm_back(d, tape, self.p["u" + way])
            g["x" + way] = np.zeros_like(self.p["x" + way])
            np.add.at(g["x" + way], sym.ravel(), dz.reshape(-1, 4 * HIDDEN))
        return float((z - gold).sum() * scale), {k: v * scale for k, v in g.items()}

    def scores(self, pieces: list[np.ndarray], kept: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
        """Scores [character, tag] of the `kept` places (all, if not given) of each window of symbols; the windows do not see each other.

        What lies behind the last kept place matters to the way back only, and what lies before the
        first to the way ahead only, so that neither runs over a margin that it does not warm up on.
        """
        kept = kept or [(0, len(p)) for p in pieces]
        runs = [[p[:b] for p, (_, b) in zip(pieces, kept, strict=True)], [p[a:][::-1] for p, (a, _) in zip(pieces, kept, strict=True)]]
        sizes = np.array([[len(p) for p in way] for way in runs])
        order = np.argsort(-sizes, axis=1, kind="stable")
        steps = int(sizes.max())
        x = np.full((steps, 2, len(pieces)), _PAD, np.int32)
        for way in range(2):
            for r, k in enumerate(order[way]):
                x[: sizes[way, k], way, r] = runs[way][k]
        alive = (sizes[:, :, None] > np.arange(steps)).sum(1).max(0)
        found = _run(x, alive, (self.p["xf"], self.p["xb"]), (self.p["uf"], self.p["ub"]), self.p["w"].reshape(2, HIDDEN, _TAGS))
        found[0] += self.p["b"]
        row = np.argsort(order, axis=1)
        return [found[0, row[0, k], a:b] + found[1, row[1, k], len(p) - b : len(p) - a][::-1] for k, (p, (a, b)) in enumerate(zip(pieces, kept, strict=True))]

    def doubtful(self, e: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Places that the best path may tag; e [character, tag] are the scores of texts that begin at `base`.

        A tagged run gains over no tags at most the sum of its characters' best gains, each with
        the best inner transition, and a constant for its ends. A place is doubtful if a run over
        it could gain: the greatest such sum over a place comes from running sums and their
        extremes, and a place without one is untagged in every best path.
        """
        t, inner = self.p["trans"].astype(np.float64), self.p["trans"][1:, 1:].max()
        ends = max((t[0, 1:] - t[0, 0]).max(), (self.p["first"][1:] - self.p["first"][0]).max()) + max((t[1:, 0] - t[0, 0]).max(), 0) + t[0, 0] - inner
        most = np.maximum.reduce([e[:, k] for k in range(1, _TAGS)])
        gain = (most - e[:, 0]).astype(np.float64) + inner - t[0, 0]
        # A wall before each text keeps runs inside it.
        walls = np.insert(gain, base[:-1], -1e6)
        sums = np.cumsum(walls)
        low = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
        high = np.maximum.accumulate(np.append(sums, -np.inf)[::-1])[::-1][:-1]
        high = np.where(walls > -5e5, high, 0)
        reach = high - low + ends
        return np.flatnonzero((reach > -1e-3)[walls > -5e5])

    def decode(self, e: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, tags) of the best paths of texts with scores e [character, tag] that begin at `base`; other places are untagged."""
        place = self.doubtful(e, base)
        owner = np.searchsorted(base, place, "right") - 1
        new = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
        if not len(new):
            return place, np.zeros(0, np.int8)
        sizes = np.diff(np.append(new, len(place)))
        ends = new + sizes - 1
        return place, self.decoded(e[place], sizes, place[new] == base[owner[new]], place[ends] + 1 == base[owner[ends] + 1])

    def decoded(self, e: np.ndarray, sizes: np.ndarray, opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """Best tags of consecutive stretches of `sizes` characters; a stretch that opens or closes a text has no untagged neighbour there.

        A long stretch is cut into blocks. Each block but the first has a best path for every tag
        before it, and the best of the whole stretch is chosen from these, block by block.
        """
        trans, parts = self.p["trans"], -(-sizes // BLOCK)
        owner, block_0 = np.repeat(np.arange(len(sizes)), parts), np.cumsum(parts) - parts
        part = np.arange(len(owner)) - block_0[owner]
        n, at = np.minimum(sizes[owner] - part * BLOCK, BLOCK), (np.cumsum(sizes) - sizes)[owner] + part * BLOCK
        # A column is a block with a tag before it; columns are kept by falling length.
        ways = np.where(part, _TAGS, 1)
        column_0, block = np.cumsum(ways) - ways, np.repeat(np.arange(len(n)), ways)
        before = np.arange(len(block)) - column_0[block]
        order = np.argsort(-n[block], kind="stable")
        block, before, place = block[order], before[order], np.argsort(order)
        long, first = n[block], at[block]
        alive = np.searchsorted(-long, -np.arange(long[0]))
        by_tag = np.ascontiguousarray(e.T)
        best = by_tag[:, first] + np.where((part[block] == 0) & opening[owner[block]], self.p["first"][:, None], trans[before].T)
        bests, last = [best], best.copy()
        for t in range(1, long[0]):
            m = alive[t]
            best = (best[:, None, :m] + trans[:, :, None]).max(0)
            best += by_tag.take(first[:m] + t, axis=1)
            last[:, :m] = best
            bests.append(best)
        # The column that each block's best path takes, and the tag at its end.
        ends, column = np.where(closing, np.float32(0), trans[:, :1]), place[column_0]
        tag = (last[:, column] + ends[:, owner]).argmax(0)
        for k in np.flatnonzero(parts > 1):
            blocks = range(block_0[k], block_0[k] + parts[k])
            total, choices = last[:, column[blocks[0]]].astype(np.float64), []
            for b in blocks[1:]:
                both = total[:, None] + last[:, place[column_0[b] : column_0[b] + _TAGS]].T
                choices.append(both.argmax(0))
                total = both.max(0)
            end = int((total + ends[:, k]).argmax())
            for b, choice in zip(reversed(blocks), reversed(choices), strict=False):
                tag[b], end = end, int(choice[end])
                column[b] = place[column_0[b] + end]
            tag[blocks[0]] = end
        by_length = np.argsort(column)
        tag, column, n, at = tag[by_length], column[by_length], n[by_length], at[by_length]
        out = np.zeros(len(e), np.int8)
        out[at + n - 1] = tag
        alive = np.searchsorted(-n, -np.arange(n[0]))
        for t in range(n[0] - 1, 0, -1):
            m = alive[t]
            tag[:m] = (bests[t - 1].take(column[:m], axis=1) + trans[:, tag[:m]]).argmax(0)
            out[at[:m] + t - 1] = tag[:m]
        return out


def _run(x: np.ndarray, alive: np.ndarray, inputs: tuple[np.ndarray, np.ndarray], hidden: tuple[np.ndarray, np.ndarray], heads: np.ndarray) -> np.ndarray:
    """What the states of both LSTMs add to the scores [way, row, time, tag] by `heads` [way, unit, tag], over symbols [time, way, row].

    The rows of a way are sorted by length, and at most `alive` of them last until a step; what lies
    behind the end of a row means nothing. Gates lie apart [gate, way, row, unit], so that every step
    works on whole blocks. As sigmoid(z) is 1 / (1 + exp(-z)) and tanh(z) is 2 * sigmoid(2 * z) - 1,
    exponentials serve all gates, which numpy computes faster than tanh; to multiply by a gate is to
    divide by 1 + exp(-z), and one that overflows closes the gate. Cells are kept times -2 and states
    are halved; scaling by powers of two changes no digit.
    """
    scale = np.full(4 * HIDDEN, -1, np.float32)
    scale[3 * HIDDEN :] = -2
    # [gate, symbol of a way, unit] and [gate, way, unit before, unit]
    table = np.ascontiguousarray((np.concatenate(inputs) * scale).astype(np.float32).reshape(-1, 4, HIDDEN).swapaxes(0, 1))
    weights = np.ascontiguousarray((np.stack(hidden) * scale * np.float32(2)).astype(np.float32).reshape(2, HIDDEN, 4, HIDDEN).transpose(2, 0, 1, 3))
    heads = (heads * np.float32(2)).astype(np.float32)
    x = x.astype(np.intp) + np.array([[0], [len(inputs[0])]])
    steps, _, rows = x.shape
    half, one, four = np.float32(0.5), np.float32(1), np.float32(-4)
    out = np.empty((2, rows, steps, heads.shape[2]), np.float32)
    states = np.zeros((2, STEPS, rows, HIDDEN), np.float32)
    room = np.empty((2, 4 * 2 * rows * HIDDEN), np.float32)
    h = c = np.zeros((2, rows, HIDDEN), np.float32)
    n = 0
    with np.errstate(over="ignore"):
        for t in range(steps):
            if alive[t] != n:
                n = alive[t]
                z, added = room[:, : 4 * 2 * n * HIDDEN].reshape(2, 4, 2, n, HIDDEN)
                i, f, o, new = z
                c = np.ascontiguousarray(c[:, :n])
            np.matmul(h[:, :n], weights, out=z)
            table.take(x[t, :, :n], axis=1, out=added, mode="clip")
            z += added
            np.exp(z, out=z)
            z += one
            np.reciprocal(new, out=new)
            new -= half
            new *= four
            new /= i
            c /= f
            c += new
            np.exp(c, out=i)
            i += one
            h = states[:, t % STEPS, :n]
            np.reciprocal(i, out=h)
            h -= half
            h /= o
            if (t + 1) % STEPS == 0 or t + 1 == steps:
                k = t % STEPS + 1
                out[:, :, t + 1 - k : t + 1] = np.matmul(states[:, :k].reshape(2, k * rows, HIDDEN), heads).reshape(2, k, rows, -1).swapaxes(1, 2)
    return out


def windows(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels [time, row] of windows of labelled texts."""
    x, y = np.full((n, LEARNED), _PAD, np.int32), np.zeros((n, LEARNED), np.int64)
    for k in range(n):
        text, spans = labelled(rng)
        sym, tags = symbols(text), np.zeros(len(text), np.int64)
        for start, kind, end in spans:
            tags[start:end] = kind + 1
        lo = int(rng.integers(-LEARNED // 3, max(1, len(text) - LEARNED // 2)))
        a, b = max(lo, 0), min(lo + LEARNED, len(text))
        x[k, a - lo : b - lo], y[k, a - lo : b - lo] = sym[a:b], tags[a:b]
    return x.T.copy(), y.T.copy()


@cache
def trained(batches: int = BATCHES, seed: int = SEED) -> Tagger:
    """The tagger after `batches` steps of Adam; the same for the same arguments."""
    model, rng = Tagger(seed), np.random.default_rng(seed + 1)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, batches + 1):
        rate = 0.02 * min(1.0, 2 * (1 - step / (batches + 1)))
        _, grad = model.gradients(*windows(rng, BATCH))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g**2
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ---- spans of texts ----


def _plausible(kind: int, piece: str) -> bool:
    if kind == 0:
        at = _AT.search(piece)
        return bool(at) and any(c.isalpha() for c in piece[: at.start()]) and any(c.isalpha() for c in piece[at.end() :]) and len(piece) >= 6 and bool(re.search(r"\.|dot", piece[at.end() :]))
    if any(c.isalpha() for c in piece):
        return False
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = "".join(_DIGITS.findall(piece))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(piece) <= 2 * len(digits) and any(c in " ().-" for c in piece)


def _windows(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first and last place it decides) of the windows of a text of n characters."""
    step, start = WINDOW - 2 * MARGIN, 0
    while True:
        end = min(start + WINDOW, n)
        yield start, end, start + MARGIN if start else 0, n if end == n else end - MARGIN
        if end == n:
            return
        start += step


def tags(model: Tagger, texts: list[str], chunk: int = 2048) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, tags) of the characters of each whole text that may have a tag, by one decoding over the scores of its windows."""
    base = np.cumsum([0, *map(len, texts)])
    e = np.empty((base[-1], _TAGS), np.float32)
    pieces: list[np.ndarray] = []
    wanted: list[tuple[int, int, int]] = []  # place of the first decided character, and what is decided in the window

    def flush() -> None:
        for found, (p, _, _) in zip(model.scores(pieces, [w[1:] for w in wanted]), wanted, strict=True):
            e[p : p + len(found)] = found
        pieces.clear()
        wanted.clear()

    for k, text in enumerate(texts):
        if text:
            sym = symbols(text)
            for start, end, a, b in _windows(len(text)):
                pieces.append(sym[start:end])
                wanted.append((int(base[k]) + a, a - start, b - start))
                if len(pieces) == chunk:
                    flush()
    if pieces:
        flush()
    place, found = model.decode(e, base)
    cut = np.searchsorted(place, base)
    return [(place[cut[k] : cut[k + 1]] - base[k], found[cut[k] : cut[k + 1]]) for k in range(len(texts))]


def model_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) that the tagger finds in each whole text."""
    out: list[list[tuple[int, int, int]]] = []
    size, cuts = 0, [0]
    for k, text in enumerate(texts):
        if size and size + len(text) > PASS_CHARS:
            cuts.append(k)
            size = 0
        size += len(text)
    tagged = (x for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True) for x in tags(model, texts[a:b]))
    for text, (place, tag) in zip(texts, tagged, strict=True):
        spans = []
        place, tag = place[tag > 0], tag[tag > 0]
        change = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(tag, prepend=0) != 0))
        for i, j in zip(change, np.append(change[1:], len(place)), strict=False):
            start, end = int(place[i]), int(place[j - 1]) + 1
            piece = text[start:end]
            start, end = start + len(piece) - len(piece.lstrip(" \n\t.,;:*")), end - (len(piece) - len(piece.rstrip(" \n\t.,;:*(")))
            if start < end and _plausible(int(tag[i]) - 1, text[start:end]):
                spans.append((start, int(tag[i]) - 1, end))
        out.append(spans)
    return out


def find(model: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text; equal texts are judged once."""
    out, kinds = {}, list(dict.fromkeys(texts))
    for text, extra in zip(kinds, model_spans(model, kinds), strict=True):
        base = base_spans(text)
        new = [s for s in extra if not any(s[0] < b[2] and b[0] < s[2] for b in base)]
        out[text] = base, sorted({*base, *new})
    return [out[text] for text in texts]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    The counts and the digest are of the base spans, `spans` of all. A null text is empty and has
    none. Repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(s[1] == kind for s in base) for base, _ in found], pa.int64()) for kind in range(4)]
            digest = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([shown(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with personal data in `text` replaced and `n_chars` counted anew where there is such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = find(shared.value, [t or "" for t in texts])
            new = [t if not s else redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            cols = {c: batch.column(c) for c in names}
            cols["text"] = pa.array(new, pa.string())
            if "n_chars" in cols:
                old = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([len(t) if s else n for t, n, (_, s) in zip(new, old, found, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)

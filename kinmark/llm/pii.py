"""Personal data: a character-level bidirectional LSTM with CRF transitions, in numpy.

Types are EMAIL, PHONE, IP and CARD. The network is trained from labelled spans by
``python -m kinmark.llm.pii`` (``synthetic_examples`` makes them from a seed; any list of (text, spans)
will do in ``train``), which writes the weights that ``default_tagger`` loads (about 40 kB).

1. A text is tiled with overlapping windows of ``WINDOW`` characters, ``STRIDE`` apart. The network runs on
   every window of every text; nothing is left out beforehand.
2. Both LSTMs give each character of a window its tag scores. Where windows overlap,
   scores are averaged with weights that fall towards a window's ends.
3. The joined scores of a whole text are decoded by one Viterbi pass with the CRF's transitions, so
   no span is cut where windows meet. A character that no stretch of other tags with a gain over staying at 0
   can hold is 0 on the best path for certain (``may_differ``), so only the rest is stepped through.

The LSTM's input and forget gates are coupled (f = 1 - i), and x / (1 + |x|) stands in for tanh: together a
third of the time. The scan is map-only, and
memory does not grow with a text's length.
"""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

TYPES = ("EMAIL", "PHONE", "IP", "CARD")
#: Tags: 0 is outside; 2 i + 1 begins a span of type i and 2 i + 2 continues it.
TAGS = 1 + 2 * len(TYPES)
WINDOW, STRIDE, HIDDEN, STEPS, BATCH, RATE, SEED, EXAMPLES = 256, 224, 12, 4000, 96, 0.012, 5, 24_000
#: Windows in training are shorter, as there a span is near.
TRAIN_WINDOW = 64
#: Windows that the network runs at once.
RUN_WINDOWS = 512
#: Characters of one text that are held at once; a longer text goes on in pieces.
HELD = 1 << 20
#: What a transition costs that the tags' meaning forbids: a type goes on only after its own beginning.
NEVER = np.float32(-1e4)
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
PAD, LETTER, OTHER, VOCABULARY = 0, 128, 129, 130

Spans = list[tuple[int, int, str]]


@cache
def _id_table() -> np.ndarray:
    """Id of each code point of the basic plane: ASCII as it is, decimal digits of any script as ASCII ones."""
    table = np.where(np.arange(1 << 16) < 128, np.arange(1 << 16), np.where(np.arange(1 << 16) >= 0xC0, LETTER, OTHER)).astype(np.int32)
    for c in range(128, 1 << 16):
        if (digit := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = ord("0") + digit
        elif 0xFF01 <= c <= 0xFF5E:
            table[c] = c - 0xFEE0  # full-width forms
    return table


def char_ids(points: np.ndarray) -> np.ndarray:
    """ASCII characters as they are (digits of other scripts and full-width forms as their ASCII ones), one id for other letters (from U+00C0 on) and one for the rest."""
    return np.where(points < 1 << 16, _id_table()[np.minimum(points, 0xFFFF)], LETTER).astype(np.int32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


# ---- Labelled examples


def synthetic_examples(n: int, seed: int) -> list[tuple[str, Spans]]:
    """Texts of invented words with personal data at known spans, and look-alikes that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    low = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    up = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    octet = lambda: str(r.choice([r.randint(0, 255), r.randint(0, 255), r.randint(0, 99), r.randint(0, 9)]))
    common = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ß ch ung é ção ñ ü ä ö è ê lich que la".split()
    syllables = common

    def invented() -> list[str]:
        """Syllables of a language of its own, so that no text looks odd for its words alone."""
        letters = r.choice(["abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu" * 3 + "abcdefghijklmnopqrstuvwxyzäöüßéèêñçãõ"])
        return ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 2, 2, 3, 3, 4]))) for _ in range(r.randint(5, 60))]

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 5])))
        return w.capitalize() if r.random() < 0.12 else w

    def prose(n: int) -> str:
        """Words with punctuation, now and then one of them over and over."""
        if r.random() < 0.12:
            return " ".join([word() + r.choice(["", "", ".", ","])] * n)
        return "".join(word() + r.choice([" "] * 12 + [", ", ". ", ".\n", ".\n\n", "; ", ": ", " - ", "? ", "\n"]) for _ in range(n)).strip()

    def plain() -> str:
        """Text of the many kinds that hold nothing personal."""
        kind = r.randrange(9)
        if kind == 0:
            return "".join(word() for _ in range(r.randint(4, 20)))
        if kind == 1:
            return r.choice([" ", "\n", ".", "-", "=", "*", "#", "_", "0", "x", "\t"]) * r.randint(3, 60)
        if kind == 2:
            return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-!@#$%^&*() \n") for _ in range(r.randint(5, 70)))
        if kind == 3:
            return "".join(chr(r.choice([r.randint(0x4E00, 0x9FFF), r.randint(0x400, 0x44F), r.randint(0x1F300, 0x1F5FF), r.randint(0x2000, 0x206F), r.randint(1, 31)])) for _ in range(r.randint(3, 30)))
        if kind == 4:
            return " ".join(r.choice([word().upper(), f"{word()}-{word()}", f"{word()}'s", f'"{word()}"', f"{word()}:", f"{word()}/{word()}", f"{word()}_{word()}()"]) for _ in range(r.randint(2, 10)))
        if kind == 5:
            return "; ".join(f"{low(r.randint(1, 6))} = {d(r.randint(1, 5))}" for _ in range(r.randint(1, 6)))
        if kind == 6:
            return " ".join(d(r.randint(1, 6)) for _ in range(r.randint(2, 9)))
        if kind == 7:
            return f"<{low(4)} {low(5)}=\"{low(6)}\">{word()} {word()}</{low(4)}>"
        return prose(r.randint(5, 40))

    def email() -> str:
        local = r.choice([lambda: low(r.randint(2, 9)), lambda: f"{low(r.randint(1, 8))}.{low(r.randint(2, 9))}", lambda: f"{low(r.randint(2, 9))}.{d(r.randint(1, 4))}", lambda: f"{low(r.randint(3, 9))}.{d(2)}", lambda: f"{low(r.randint(2, 7))}{d(r.randint(1, 4))}", lambda: f"{low(4)}_{low(5)}", lambda: f"{low(5)}+{low(3)}", lambda: f"{low(1).upper()}{low(5)}-{low(4)}"])()
        host = ".".join([low(r.randint(2, 9)) + (d(1) if r.random() < 0.4 else "") for _ in range(r.randint(1, 3))])
        return f"{local}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'edu', 'info', 'example', low(3)])}"

    def phone() -> str:
        return r.choice([lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{r.randint(1, 99)} {d(2)} {d(4)} {d(4)}", lambda: f"+{r.randint(1, 99)}-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", lambda: f"+{r.randint(1, 99)}{d(10)}"])()

    def card() -> str:
        first = r.choice("3456") + d(3)
        return r.choice([lambda: first + d(12), lambda: first + d(12), lambda: " ".join([first, d(4), d(4), d(4)]), lambda: "-".join([first, d(4), d(4), d(4)])])()

    def other() -> str:
        return r.choice(
            [
                lambda: d(r.randint(1, 3)), lambda: str(r.randint(1800, 2100)), lambda: f"{d(1)}.{d(r.randint(1, 2))}", lambda: f"Version {d(1)}.{d(1)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(2)}.{d(1)}.{d(3)}",
                lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)},{d(3)}", lambda: f"${d(2)},{d(3)}.{d(2)}", lambda: f"{d(2)}%", lambda: d(r.randint(4, 8)),
                lambda: f'token = "{hexa(40)}"', lambda: f"password={hexa(r.choice([8, 12, 16, 18, 24]))}", lambda: hexa(r.choice([16, 32, 40, 64])), lambda: f"{word()}.{word()}", lambda: f"{word()}.{word()}", lambda: f"AKIA{up(16)}", lambda: up(r.randint(16, 32)), lambda: f"@{low(6)}", lambda: f"{word()} @ {word()}",
                lambda: f"{low(4)}{d(3)}", lambda: f"http://{low(6)}.example.com/{low(3)}/{d(5)}", lambda: f"CC BY-NC {d(1)}.0", lambda: f"({d(1)})", lambda: f"[{d(2)}]", lambda: f"p. {d(3)}-{d(3)}", lambda: f"10.{d(4)}/{low(4)}.{d(4)}", lambda: d(r.randint(20, 30)), lambda: f"{word()}### {word()}%%%", lambda: f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}",
            ]
        )()

    def ip() -> str:
        return ".".join(octet() for _ in range(4))

    makers = [email, phone, ip, card]
    out = []
    for _ in range(n):
        syllables = common if r.random() < 0.3 else invented()
        text, spans = prose(r.choice([0, r.randint(0, 14), r.randint(0, 50)])), []
        for _ in range(r.randint(1, 4)):
            text += r.choice([" ", " ", " ", " ", " ", "\n", ": ", ", ", " (", ' "', "\t"]) if text else ""
            if r.random() < 0.6:
                k = r.randrange(len(makers))
                own = makers[k]()
                spans.append((len(text), len(text) + len(own), TYPES[k]))
                text += own + r.choice(["", "", "", ".", ",", ";", ")", '"', "!"])
            elif r.random() < 0.4:
                text += plain()
            else:
                text += other()
            if r.random() < 0.75:  # else the next one follows at once
                text += r.choice([" ", " ", " ", "\n", ". "]) + prose(r.randint(1, 12)) + r.choice(["", "", ".", ",", "?"])
        out.append((text, spans))
    return out


def tag_row(length: int, spans: Spans) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for a, b, kind in spans:
        i = TYPES.index(kind)
        tags[a:b] = 2 * i + 2
        tags[a] = 2 * i + 1
    return tags


# ---- The network


def soft(x: np.ndarray, room: np.ndarray, out: np.ndarray) -> None:
    """x / (1 + |x|); ``room`` is overwritten."""
    np.abs(x, out=room)
    room += x.dtype.type(1)
    np.divide(x, room, out=out)


class Tagger:
    """Parameters: per direction and gate (input, output, new) input rows E (with the bias) and recurrence U; output W, b; CRF transitions A, start s, end e."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        e = r.normal(0, 0.4, (2, 3, VOCABULARY, hidden))
        e[:, 0] -= 2.0  # what is there stays at first
        self.p = {"E": e, "U": r.normal(0, 1.5 / np.sqrt(hidden), (2, 3, hidden, hidden)), "W": r.normal(0, 1 / np.sqrt(2 * hidden), (2, hidden, TAGS)), "b": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS), "e": np.zeros(TAGS)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, ids: np.ndarray, keep: bool):
        """Tag scores (T, B, TAGS) of windows ids (B, T), and what the gradient needs."""
        h_size, (n, length) = self.hidden, ids.shape
        places = np.ascontiguousarray(ids.T, np.int64)
        kind = self.p["U"].dtype
        hs, tape, x = np.empty((2, length, n, h_size), kind), ([], []), np.empty((3, n, h_size), kind)
        g, room, new = np.empty_like(x), np.empty_like(x), np.empty((n, h_size), kind)
        for way in (0, 1):
            u, e = self.p["U"][way], self.p["E"][way]
            h, c = np.zeros((n, h_size), kind), np.zeros((n, h_size), kind)
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                if keep:
                    g, before = np.empty_like(x), (h, c.copy())
                np.matmul(h, u, out=g)
                np.take(e, places[t], axis=1, out=x, mode="clip")
                g += x
                soft(g, room, g)
                s = g[:2]
                s *= kind.type(0.5)
                s += kind.type(0.5)
                np.subtract(g[2], c, out=new)
                new *= g[0]
                c += new
                h = hs[way, t]
                soft(c, new, h)
                if keep:
                    tape[way].append((g, h.copy(), *before))
                h *= g[1]
        score = hs[0].reshape(-1, h_size) @ self.p["W"][0]
        score += hs[1].reshape(-1, h_size) @ self.p["W"][1]
        score += self.p["b"]
        return score.reshape(length, n, TAGS), hs, places, tape

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self._forward(ids, False)[0].transpose(1, 0, 2)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        n, length = ids.shape
        p = self.p
        score, hs, places, tape = self._forward(ids, True)
        a, kind = p["A"], p["A"].dtype
        rows, tags = np.arange(n), tags.T

        def lse(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            """log(exp(x) @ exp(w)), row by row."""
            m = x.max(1, keepdims=True)
            return m + np.log(np.exp(x - m) @ w)

        forth, back = np.exp(a), np.exp(a).T.copy()
        alpha, beta = np.empty((length, n, TAGS), kind), np.empty((length, n, TAGS), kind)
        alpha[0] = p["s"] + score[0]
        for t in range(1, length):
            alpha[t] = lse(alpha[t - 1], forth) + score[t]
        beta[-1] = p["e"]
        for t in range(length - 2, -1, -1):
            beta[t] = lse(score[t + 1] + beta[t + 1], back)
        last = alpha[-1] + p["e"]
        top = last.max(1, keepdims=True)
        total = (top + np.log(np.exp(last - top).sum(1, keepdims=True)))[:, 0]
        gold = p["s"][tags[0]] + p["e"][tags[-1]] + np.take_along_axis(score, tags[:, :, None], 2)[:, :, 0].sum(0) + a[tags[:-1], tags[1:]].sum(0)
        d_score = np.exp(alpha + beta - total[None, :, None])
        at_end = d_score[-1].sum(0)
        # Of exp(alpha[t] + A + score[t + 1] + beta[t + 1] - total), scaled on both sides so that nothing overflows.
        ahead = score[1:] + beta[1:]
        mx, my = alpha[:-1].max(2, keepdims=True), ahead.max(2, keepdims=True)
        left = np.exp(alpha[:-1] - mx).reshape(-1, TAGS)
        right = (np.exp(ahead - my) * np.exp(mx + my - total[None, :, None])).reshape(-1, TAGS)
        pair = (left.T @ right) * forth
        np.add.at(pair, (tags[:-1], tags[1:]), -1)
        d_score[np.arange(length)[:, None], rows, tags] -= 1
        grad = {"A": pair, "s": d_score[0].sum(0), "b": d_score.sum((0, 1)), "e": at_end - np.bincount(tags[-1], minlength=TAGS)}
        flat = lambda x: x.reshape(-1, x.shape[-1])
        grad["W"] = np.stack([flat(hs[k]).T @ flat(d_score) for k in (0, 1)])
        grad["E"], grad["U"] = np.zeros_like(p["E"]), np.zeros_like(p["U"])
        slope = lambda y: (1 - np.abs(y)) ** 2
        order = np.argsort(places.ravel(), kind="stable")
        own = places.ravel()[order]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for way in (0, 1):
            dh_out = np.matmul(d_score, p["W"][way].T)
            dh, dc = np.zeros((n, self.hidden), kind), np.zeros((n, self.hidden), kind)
            ut = p["U"][way].transpose(0, 2, 1)
            dgs = np.empty((length, 3, n, self.hidden), kind)
            turns = list(range(length) if way == 0 else range(length - 1, -1, -1))
            for j in range(length - 1, -1, -1):
                t = turns[j]
                g, w, h0, c0 = tape[way][j]
                i, o, z = g
                dh = dh + dh_out[t]
                dc = dc + dh * o * slope(w)
                dg = dgs[t]
                dg[0] = dc * (z - c0) * slope(2 * i - 1) * 0.5
                dg[1] = dh * w * slope(2 * o - 1) * 0.5
                dg[2] = dc * i * slope(z)
                grad["U"][way] += np.matmul(h0.T, dg)
                dh, dc = np.matmul(dg, ut).sum(0), dc * (1 - i)
            for k in range(3):
                grad["E"][way, k][own[cut]] = np.add.reduceat(dgs[:, k].reshape(-1, self.hidden)[order], cut, axis=0)
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    @cached_property
    def moves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transitions, starts and ends for decoding, where a type goes on only after its own beginning."""
        a, s = self.p["A"].copy(), self.p["s"].copy()
        for on in range(2, TAGS, 2):
            s[on] = NEVER
            a[[x for x in range(TAGS) if x not in (on, on - 1)], on] = NEVER
        return a, s, self.p["e"]

    def viterbi(self, score: np.ndarray, ends: bool = True) -> np.ndarray:
        """The best tags (B, T) for scores (B, T, TAGS); without ``ends`` those of start and end are in the scores."""
        n, length, _ = score.shape
        a, s, e = self.moves
        back = np.empty((length, n, TAGS), np.int8)
        best = score[:, 0] + (s if ends else 0)
        for t in range(1, length):
            all_ = best[:, :, None] + a
            back[t] = all_.argmax(1)
            best = all_.max(1) + score[:, t]
        out = np.empty((n, length), np.int8)
        out[:, -1] = (best + (e if ends else 0)).argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out


def train(examples: list[tuple[str, Spans]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED, hidden: int = HIDDEN) -> Tagger:
    """Adam over random windows of the examples, half of them around a span where there is one."""
    model, r = Tagger(hidden, seed), np.random.default_rng(seed)
    if not examples:
        return model
    pad = TRAIN_WINDOW // 2
    ids = [np.pad(char_ids(code_points(t)), (pad, TRAIN_WINDOW)) for t, _ in examples]
    tags = [np.pad(tag_row(len(t), s), (pad, TRAIN_WINDOW)) for t, s in examples]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        x, y = np.empty((batch, TRAIN_WINDOW), np.int32), np.empty((batch, TRAIN_WINDOW), np.int64)
        for j, i in enumerate(r.integers(len(examples), size=batch)):
            last = len(ids[i]) - TRAIN_WINDOW
            at = int(r.integers(last + 1))
            if examples[i][1] and j % 2:
                a, b, _ = examples[i][1][int(r.integers(len(examples[i][1])))]
                at = min(int(r.integers(max(0, b + pad - TRAIN_WINDOW - 8), a + pad + 9)), last)
            x[j], y[j] = ids[i][at : at + TRAIN_WINDOW], tags[i][at : at + TRAIN_WINDOW]
        _, grad = model.loss(x, y)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] = (model.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


@cache
def default_tagger() -> Tagger:
    """The trained network that comes with the code."""
    with np.load(WEIGHTS) as kept:
        model = Tagger(kept["W"].shape[1])
        model.p = {k: kept[k] for k in model.p}
    return model


# ---- Whole texts


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def joined_scores(model: Tagger, ids: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first character, scores) of consecutive pieces of the texts in a row; no window crosses from one text to the next."""
    n = np.diff(off)
    windows = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), windows)
    begin = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    end = off[doc + 1] if len(doc) else begin
    tri = (np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)) + 1.0).astype(np.float32)[:, None]
    at, tail, weight = 0, np.zeros((0, TAGS), np.float32), np.zeros((0, 1), np.float32)
    for a in range(0, len(doc), RUN_WINDOWS):
        b = min(a + RUN_WINDOWS, len(doc))
        place = begin[a:b, None] + np.arange(WINDOW)
        inside = place < end[a:b, None]
        s = model.scores(np.where(inside, ids[np.minimum(place, len(ids) - 1)], PAD))
        upto = int(min(begin[b - 1] + WINDOW, end[b - 1]))
        acc, w = np.zeros((upto - at, TAGS), np.float32), np.zeros((upto - at, 1), np.float32)
        acc[: len(tail)], w[: len(weight)] = tail, weight
        for j in range(b - a):
            x, m = int(begin[a + j]) - at, min(WINDOW, int(end[a + j] - begin[a + j]))
            acc[x : x + m] += s[j, :m] * tri[:m]
            w[x : x + m] += tri[:m]
        done = (int(begin[b]) if b < len(doc) else upto) - at
        yield at, acc[:done] / w[:done]
        at, tail, weight = at + done, acc[done:], w[done:]


def find_spans(model: Tagger, texts: list[str]) -> list[Spans]:
    """Spans of each text, whatever its length."""
    points = [code_points(t) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in points])]).astype(np.int64)
    return _spans(model, char_ids(np.concatenate(points)) if points else np.zeros(0, np.int32), off)


def may_differ(model: Tagger, score: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the best path may be away from 0 at each character, and the most that a stretch which is away from there to the end can have gained.

    A stretch away from 0 from i to j gains at most an entry at i, steps after i and an exit, each with the transition that
    suits it best. Sums of the steps and running maxima from both sides give the most that any stretch over a character gains.
    ``begins``: first characters of texts; no stretch crosses them.
    """
    a, s, e = (x.astype(np.float64) for x in model.moves)
    at0 = score[:, 0] + a[0, 0]
    step = (score[:, 1:] + a[1:, 1:].max(0)).max(1) - at0
    entry = (score[:, 1:] + a[0, 1:]).max(1) - at0
    entry[begins] = np.maximum(entry[begins], (score[begins, 1:] + s[1:]).max(1) - score[begins, 0] - s[0])
    step[begins] = -1e6
    leave = max(a[1:, 0].max() - a[0, 0], e[1:].max() - e[0])
    total = np.cumsum(step)
    come = np.maximum.accumulate(entry - total)
    return come + np.maximum.accumulate(total[::-1])[::-1] + leave > -1e-3, come + total[-1]


def _spans(model: Tagger, ids: np.ndarray, off: np.ndarray) -> list[Spans]:
    out: list[Spans] = [[] for _ in off[1:]]
    a, first_move, last_move = model.moves
    starts, ends = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
    # Swapping a tag for another of its type gains no more than this, whatever comes.
    swap = 2 * float(np.abs(model.p["W"]).sum((0, 1)).max() + np.abs(model.p["b"]).max()) + 4 * float(np.ptp(model.p["A"]))
    regions: list[tuple[int, np.ndarray]] = []
    at, held = 0, np.zeros((0, TAGS), np.float32)

    def settle(last: bool) -> None:
        """Cut the doubtful stretches out of ``held``, which begins at ``at``; what may still change stays."""
        nonlocal at, held
        own = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(held))] - at
        away, gained = may_differ(model, held, own)
        rest = len(held)
        if not last and at + rest not in end_set:
            rest = int(own[-1]) if len(own) else 0
            if len(held) - rest > HELD:
                # A stretch that comes from before a place and goes beyond the end would do better to begin at the end.
                safe = np.flatnonzero(~away & (gained < -swap))
                rest = max(rest, int(safe[-1]) if len(safe) else 0)
        for a, b in _stretches(away[:rest]):
            # A stretch is cut at the ends of texts.
            cuts = [a, *(ends[np.searchsorted(ends, at + a, "right") : np.searchsorted(ends, at + b)] - at).tolist(), b]
            regions.extend((at + x, held[x:y].copy()) for x, y in zip(cuts[:-1], cuts[1:], strict=True))
        at, held = at + rest, held[rest:]

    begin_set, end_set = set(starts.tolist()), set(ends.tolist())
    parts: list[np.ndarray] = []
    for _, score in joined_scores(model, ids, off):
        parts.append(score)
        if sum(map(len, parts)) >= HELD:
            held, parts = np.concatenate([held, *parts]), []
            settle(False)
    held = np.concatenate([held, *parts])
    if len(held):
        settle(True)
    if not regions:
        return out
    size = np.array([-(-len(s) // 32) * 32 for _, s in regions])
    for n in np.unique(size):
        for own in np.array_split(np.flatnonzero(size == n), -(-(int((size == n).sum()) * int(n)) // (1 << 18))):
            x = np.full((len(own), n, TAGS), -1e9, np.float32)
            x[:, :, 0] = 0  # beyond a stretch the tag is 0
            for j, i in enumerate(own):
                place, s = regions[i]
                x[j, : len(s)] = s
                x[j, 0] += first_move if place in begin_set else a[0]
                if place + len(s) in end_set:
                    x[j, len(s) - 1] += last_move - (a[:, 0] if len(s) < n else 0)
                elif len(s) == n:
                    x[j, -1] += a[:, 0]
            for i, tags in zip(own, model.viterbi(x, False), strict=True):
                place, s = regions[i]
                d = int(np.searchsorted(off, place, "right")) - 1
                t = tags[: len(s)].astype(np.int64)
                kind = np.where(t > 0, (t + 1) // 2, 0)
                begin = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (t[1:] % 2 == 1)))
                end = np.append(begin[1:], len(t))
                base = place - int(off[d])
                out[d] += [(base + b, base + e, TYPES[kind[b] - 1]) for b, e in zip(begin[kind[begin] > 0].tolist(), end[kind[begin] > 0].tolist(), strict=True)]
    return [sorted(s) for s in out]


def spans_of(model: Tagger, column: pa.Array) -> list[Spans]:
    """Spans of an Arrow string column, null as the empty text."""
    data, off = tv.buffers(tv.as_strings(column))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    return _spans(model, char_ids(code_points(data.tobytes().decode())), chars.astype(np.int64))


def _scan(model: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                rows = [(i, *s) for i, spans in enumerate(spans_of(model, part.column(1))) for s in spans]
                if rows:
                    i, a, b, kind = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.string())], ["doc_id", "start", "end", "type"])

    return run


def personal_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row per span: doc_id, start and end in characters, type.

    Null and empty texts have none. Repeated rows give the same spans again; null ids stay
    null. An empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_scan(model or default_tagger()), f"doc_id {kind}, start long, end long, type string")


def masked(text: Column, model: Tagger | None = None) -> Column:
    """The text with each span replaced by its type in brackets; null stays null."""
    own = model or default_tagger()

    @F.arrow_udf("string")
    def mask_personal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for part in tv.chunks(pa.RecordBatch.from_arrays([column.cast(pa.string())], ["text"]), "text"):
                texts = part.column(0).to_pylist()
                for i, spans in enumerate(spans_of(own, part.column(0))):
                    if not spans:
                        continue
                    pieces, at = [], 0
                    for a, b, kind in spans:
                        pieces += [texts[i][at:a], f"[{kind}]"]
                        at = b
                    texts[i] = "".join([*pieces, texts[i][at:]])
                out.append(pa.array(texts, pa.string()))
            yield pa.concat_arrays(out) if out else pa.array([], pa.string())

    return mask_personal(text)


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train(synthetic_examples(EXAMPLES, SEED)).p)

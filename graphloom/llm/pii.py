"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds what they don't cover."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held, ready, spread, table, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where no digit is before it, as else it would have started there.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind: leftmost matches that don't overlap, without those that fail their test."""
    emails, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        last = at + 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            emails.append((begin, m.end()))
            last = m.end()
        at = text.find("@", last)
    spans = lambda pattern, good: [m.span() for m in pattern.finditer(text) if good(m.group())]
    ips = spans(IP, lambda s: all(map(byte_sized, s.split("."))))
    cards = spans(CARD, lambda s: 16 <= len(d := digits_of(s)) <= 19 and luhn(d))
    phones = spans(PHONE, lambda s: 8 <= len(digits_of(s)) <= 15) if "+" in text else []
    return [emails, ips, cards, phones]


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\w")
#: How often labels are struck out before the rest is decoded.
ROUNDS = 8
WORDS = frozenset("at dot call phone tel mobile fax email mail contact card visa ip host server com net org".split())


def shape_of(token: str) -> str:
    if token[0].isdigit():
        n = len(token)
        return f"d{n}" if n <= 4 else "d5-8" if n <= 8 else "d9-12" if n <= 12 else "d13-15" if n <= 15 else "d16-19" if n <= 19 else "d20"
    low = token.lower() if token.isascii() else token
    return f"w:{low}" if low in WORDS else ("X" if token.isupper() else "x") if token[0].isalpha() else token


def observations(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    """The features of each token: the shapes of it and of two to either side, and the spaces between."""
    shapes = ["<", "<", *(shape_of(t) for t, _, _ in tokens), ">", ">"]
    gaps = [True, True, *(i == 0 or tokens[i][1] > tokens[i - 1][2] for i in range(len(tokens))), True, True]
    out = []
    for i in range(2, len(shapes) - 2):
        a, b, c, d, e = shapes[i - 2 : i + 3]
        out.append([f"0{c}", f"-{b}", f"+{d}", f"-{b}|{c}|{gaps[i]}", f"+{c}|{d}|{gaps[i + 1]}", f"--{a}|{b}|{c}", f"++{c}|{d}|{e}", f"g{gaps[i]}{gaps[i + 1]}"])
    return out


def labelled_table(n: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small table of made-up sentences with the spans of their personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def marks() -> str:
        return "".join(r.choice("!&%*$#|;:/<>=~^?\"'_-+.,()[]{}") + r.choice(["", "", "", " "]) for _ in range(r.randint(2, 14)))

    quad = lambda s: s.join(str(r.randint(0, 255)) for _ in range(4))
    made = {
        "email": [lambda: f"{word()}@{word()}.com", lambda: f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com", lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}(dot)org", lambda: f"{word()} (at) {word()}.net", lambda: f"{word()}.{word()} [at] {word()} [dot] com", lambda: f"{word()}.{word()}(at){word()}(dot)net"],
        "ip": [lambda: quad("."), lambda: quad("[.]"), lambda: quad(" . ")],
        "card": [card, lambda: " ".join(re.findall("....", card())), lambda: "-".join(re.findall("....", card())), lambda: ".".join(re.findall("....", card())), lambda: "/".join(re.findall("....", card()))],
        "phone": [lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(2)} {d(3)} {d(6)}", lambda: f"({d(3)}) {d(3)} {d(4)}"],
    }
    other = [lambda: d(4), lambda: d(2), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(24))}"', lambda: f"password={word()}{d(3)}{word()}", lambda: f"AKIA{word().upper()}{d(3)}", lambda: f"{d(3)},{d(3)}", lambda: f"{d(1)}.{d(2)}", lambda: f"@{word()}", lambda: d(12), lambda: d(20), lambda: f"({d(4)})", lambda: f"{d(3)}-{d(3)}", lambda: f"no. {d(6)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"[{d(2)}] {word()}", lambda: f"{d(3)} {d(4)}", lambda: f"{d(4)} {d(4)}", marks, marks, marks, marks]
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 4)):
            text += "".join(f"{r.choice([word, word, word, lambda: word().capitalize(), lambda: word().upper()])()}{r.choice(['', '', '', '', '.', ',', '!', '?', ';', ':'])} " for _ in range(r.randint(0, 4)))
            if r.random() < 0.2:
                text += r.choice(["call ", "email ", "card ", "phone: ", "ip ", "server "])
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                x = r.choice(made[kind])()
                spans.append((kind, len(text), len(text) + len(x)))
            else:
                x = r.choice(other)()
            text += x + r.choice([" ", " ", ". ", ", "])
        rows.append((text + word(), spans))
    return rows


class Field:
    """Weights of a linear-chain conditional random field; features that training didn't see have none."""

    def __init__(self, rows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 40, rate: float = 0.25):
        self.at: dict[str, int] = {}
        sequences = []
        for text, spans in rows:
            tokens = [(m.group(), *m.span()) for m in TOKEN.finditer(text)]
            y = [0] * len(tokens)
            for kind, a, b in spans:
                inside = [i for i, t in enumerate(tokens) if a <= t[1] and t[2] <= b]
                for i in inside:
                    y[i] = LABELS.index(f"{'B' if i == inside[0] else 'I'}-{kind}")
            sequences.append(([[self.at.setdefault(f, len(self.at)) for f in o] for o in observations(tokens)], y))
        n, width, k, kinds = len(sequences), max(len(y) for _, y in sequences), len(LABELS), len(self.at)
        per = len(sequences[0][0][0])
        x, gold, live = np.full((width, n, per), kinds), np.zeros((width, n), np.int64), np.zeros((width, n), bool)
        for i, (fs, y) in enumerate(sequences):
            x[: len(y), i], gold[: len(y), i], live[: len(y), i] = fs, y, True
        self.emit, self.move = np.zeros((kinds + 1, k)), np.zeros((k, k))
        gold_emit, gold_move = np.zeros((kinds + 1, k)), np.zeros((k, k))
        np.add.at(gold_emit, (x[live], gold[live][:, None]), 1)
        np.add.at(gold_move, (gold[:-1][live[1:]], gold[1:][live[1:]]), 1)
        seen = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for _ in range(epochs):
            score = self.emit[x].sum(axis=2)
            a, b = np.zeros((width, n, k)), np.zeros((width, n, k))
            a[0] = score[0]
            over = lambda z, axis: np.log(np.exp(z - (top := z.max(axis=axis, keepdims=True))).sum(axis=axis)) + top.squeeze(axis)
            for t in range(1, width):
                a[t] = np.where(live[t][:, None], over(a[t - 1][:, :, None] + self.move, 1) + score[t], a[t - 1])
            for t in range(width - 2, -1, -1):
                b[t] = np.where(live[t + 1][:, None], over(self.move + (score[t + 1] + b[t + 1])[:, None, :], 2), 0)
            z = over(a[-1], 1)
            p = np.exp(a + b - z[None, :, None]) * live[:, :, None]
            model_emit, model_move = np.zeros_like(self.emit), np.zeros_like(self.move)
            for j in range(per):
                np.add.at(model_emit, x[:, :, j], p)
            for t in range(1, width):
                q = np.exp(a[t - 1][:, :, None] + self.move + (score[t] + b[t])[:, None, :] - z[:, None, None]) * live[t][:, None, None]
                model_move += q.sum(axis=0)
            for w, g, s in ((self.emit, gold_emit - model_emit - 0.05 * self.emit, seen[0]), (self.move, gold_move - model_move - 0.05 * self.move, seen[1])):
                s += g * g
                w += rate * g / (np.sqrt(s) + 1e-6)
        self.emit[kinds] = 0

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """The best labels of each sequence (Viterbi, all sequences a step at a time)."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        none = len(self.emit) - 1
        for lo in range(0, len(order), 256):
            own = [i for i in order[lo : lo + 256] if sequences[i]]
            if not own:
                continue
            width = len(sequences[own[0]])
            lens = np.array([len(sequences[i]) for i in own])
            score = np.zeros((width, len(own), len(LABELS)))
            for j, i in enumerate(own):
                score[: lens[j], j] = self.emit[[[self.at.get(f, none) for f in o] for o in sequences[i]]].sum(axis=1)
            best, back = score[0], np.zeros((width, len(own), len(LABELS)), np.int8)
            for t in range(1, width):
                z = best[:, :, None] + self.move
                back[t] = z.argmax(axis=1)
                best = np.where((lens > t)[:, None], z.max(axis=1) + score[t], best)
            y = best.argmax(axis=1)
            path = np.zeros((width, len(own)), np.int64)
            for t in range(width - 1, -1, -1):
                path[t] = y
                y = np.where(lens > t, back[t][np.arange(len(own)), y] if t else y, y)
            for j, i in enumerate(own):
                out[i] = path[: lens[j], j]
        return out


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Bits for each code point: 1 part of a word, 2 a digit, 4 a token of its own, 8 upper case, 16 of other case; white space has none."""
    if not _classes:
        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if "0" <= c <= "9":
                out[i] = 2
            elif c.isalnum() and not c.isdecimal():
                out[i] = 1 + 8 * c.isupper() + 16 * (c.islower() or c.istitle() and not c.isupper())
            elif not c.isspace():
                out[i] = 4
        _classes.append(out)
    return _classes[0]


class Tagger:
    """A field's labels for all tokens of whole texts, many at a time.

    A token's emission scores come from tables over the shapes that the field knows. A label that O is ahead of by more than the transitions from and to any label still possible beside it can make up is not on the best path; so it is struck out, which leaves fewer beside its neighbours. Where only O is left the chain is cut without changing the path, and only the runs between go through Viterbi.
    """

    def __init__(self, model: Field):
        known = sorted({f[1:] for f in model.at if f[0] == "0"})
        self.shapes = ["<", ">", *known, None]  # the last: any other
        self.number = {s: i for i, s in enumerate(known, 2)}
        n, none = len(self.shapes), len(model.emit) - 1
        row = lambda feature: model.emit[model.at.get(feature, none)]
        table = lambda feature, *sides: np.array([row(feature(*x)) for x in product(*sides)]).reshape(*map(len, sides), -1)
        s, g = self.shapes, (False, True)
        self.one = [table(lambda x, p=p: f"{p}{x}", s) for p in "0-+"]
        self.two = [table(lambda x, y, gap, p=p: f"{p}{x}|{y}|{gap}", s, s, g) for p in "-+"]
        self.three = [table(lambda x, y, z, p=p: f"{p}{x}|{y}|{z}", s, s, s) for p in ("--", "++")]
        self.gaps = table(lambda x, y: f"g{x}{y}", g, g)
        self.other, self.move = n - 1, model.move
        sets = np.arange(1 << len(LABELS))[:, None, None] >> np.arange(len(LABELS)) & 1 == 1
        most = lambda gain: np.r_[np.where(sets.squeeze(1)[:, :, None], gain, -np.inf).max(axis=1), np.zeros((1, len(LABELS)))]
        #: The most that a label can gain over O from what stands before or after it, by the set of labels possible there; the last row: nothing stands there.
        self.before, self.after = most(self.move - self.move[:, :1]), most((self.move - self.move[:1]).T)
        self.words = np.array(sorted((self._key(w), self.number.get(f"w:{w}", self.other)) for w in WORDS), np.int64).reshape(-1, 2)
        self.single = np.full(0x110000, self.other, np.int32)
        for shape, i in self.number.items():
            if len(shape) == 1 and not shape.isalnum():
                self.single[ord(shape)] = i
        self.letter = np.full(0x110000, 31, np.int64)
        self.letter[65:91] = self.letter[97:123] = np.arange(1, 27)

    @staticmethod
    def _key(word: str) -> int:
        return sum((ord(c) - 96) << 5 * i for i, c in enumerate(word))

    def tokens(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and shapes of the tokens of some code points."""
        kind = classes()[points]
        run = kind & 7
        new = np.r_[True, run[1:] != run[:-1]] | (run == 4)
        starts = np.flatnonzero(new & (run > 0))
        ends = np.r_[np.flatnonzero(new)[1:], len(points)][np.searchsorted(np.flatnonzero(new), starts)]
        size, first = ends - starts, run[starts]
        shape = np.where(first == 4, self.single[points[starts]], self.other)
        digits = np.array([self.number.get(shape_of("1" * k), self.other) for k in range(1, 21)])
        shape = np.where(first == 2, digits[np.minimum(size, 20) - 1], shape)
        has = [np.r_[0, np.cumsum((kind & bit) > 0)] for bit in (8, 16)]
        upper, lower = (h[ends] - h[starts] for h in has)
        x, capital = (self.number.get(c, self.other) for c in "xX")
        shape = np.where(first == 1, np.where((upper > 0) & (lower == 0), capital, x), shape)
        short = np.flatnonzero((first == 1) & (size <= 7))
        key = np.zeros(len(short), np.int64)
        for i in range(7):
            inside = size[short] > i
            key[inside] |= self.letter[points[starts[short[inside]] + i]] << 5 * i
        at = np.minimum(np.searchsorted(self.words[:, 0], key), len(self.words) - 1)
        hit = self.words[at, 0] == key
        shape[short[hit]] = self.words[at[hit], 1]
        return starts, ends, shape

    def labels(self, shape: np.ndarray, apart: np.ndarray, text: np.ndarray) -> np.ndarray:
        """shape, whether white space stands before, and the text of each token, in order -> the best path's labels."""
        n = len(shape)
        if not n:
            return np.zeros(0, np.int64)
        first = np.r_[True, text[1:] != text[:-1]]
        at = np.arange(n) + 4 * (np.cumsum(first) - 1) + 2  # with two places to either side of a text
        s = np.zeros(at[-1] + 3, np.int64)
        ends = np.flatnonzero(np.r_[first[1:], True])
        s[at[ends] + 1] = s[at[ends] + 2] = 1
        s[at] = shape
        gap = np.ones(len(s), np.int64)
        gap[at] = apart | first
        left, right = gap[at], gap[at + 1]
        size = len(self.shapes)
        key = left * 2 + right
        for k in (-2, -1, 0, 1, 2):
            key = key * size + s[at + k]
        key, nth = np.unique(key, return_inverse=True)  # few of them in any text
        sides = []
        for _ in range(5):
            key, shape_ = np.divmod(key, size)
            sides.append(shape_)
        (e, d, c, b, a), (left, right) = sides, np.divmod(key, 2)
        score = self.one[0][c] + self.one[1][b] + self.one[2][d] + self.two[0][b, c, left] + self.two[1][c, d, right]
        score += self.three[0][a, b, c] + self.three[1][c, d, e] + self.gaps[left, right]
        behind = score[:, :1] - score
        every, nothing = (1 << len(LABELS)) - 1, 1 << len(LABELS)
        possible = np.full(n, every, np.int16)
        last = np.r_[first[1:], True]
        left_of = lambda t: np.where(first[t], nothing, possible[t - 1])
        right_of = lambda t: np.where(last[t], nothing, possible[np.minimum(t + 1, n - 1)])
        easy = ((behind - self.before[every] - self.after[every])[:, 1:] > 1e-9).all(axis=1)[nth]
        possible[easy] = 1
        look = np.flatnonzero(~easy)
        for _ in range(ROUNDS):  # what then is left goes through Viterbi
            own = possible[look]
            stays = behind[nth[look]] - self.before[left_of(look)] - self.after[right_of(look)] <= 1e-9
            stays[:, 0] = True
            now = own & (stays @ (1 << np.arange(len(LABELS)))).astype(np.int16)
            possible[look] = now
            changed = look[now != own]
            again = np.zeros(n + 2, bool)
            for d in (0, 1, 2):
                again[changed + d] = True
            look = np.flatnonzero(again[1:-1] & (possible != 1))
            if not len(look):
                break
        open_ = possible != 1
        out = np.zeros(n, np.int64)
        begin = np.flatnonzero(open_ & (first | np.r_[True, ~open_[:-1]]))
        end = np.flatnonzero(open_ & np.r_[first[1:] | ~open_[1:], True]) + 1
        order = np.argsort(begin - end, kind="stable")
        lo = 0
        while lo < len(order):
            width = int(end[order[lo]] - begin[order[lo]])
            own = order[lo : lo + max(1, (1 << 21) // (width * len(LABELS)))]
            lo += len(own)
            self._best(score, nth, begin[own], end[own], first, out)
        return out

    def _best(self, score: np.ndarray, nth: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        """Viterbi over runs of tokens, the longest first; a run that isn't at its text's border has O beside it."""
        sizes, width = end - begin, int(end[0] - begin[0])
        live = np.searchsorted(-sizes, -np.arange(width), "left")
        best = score[nth[begin]] + np.where(first[begin][:, None], 0, self.move[0])
        back = np.zeros((width, len(begin), len(LABELS)), np.int8)
        for t in range(1, width):
            n = live[t]
            z = best[:n, :, None] + self.move
            back[t, :n] = z.argmax(axis=1)
            best[:n] = z.max(axis=1) + score[nth[begin[:n] + t]]
        whole = np.r_[first, True][end]  # the run ends its text
        y = (best + np.where(whole[:, None], 0, self.move[:, 0])).argmax(axis=1)
        for t in range(width - 1, -1, -1):
            n = live[t]
            out[begin[:n] + t] = y[:n]
            y[:n] = back[t, np.arange(n), y[:n]] if t else y[:n]


def fits(kind: str, text: str) -> bool:
    """Whether a span that the field proposes can be of its kind."""
    d = digits_of(text)
    if kind == "email":
        return bool(re.search(r"@|[\[({] ?at ?[\])}]", text, re.I)) and bool(re.search(r"\.|[\[({] ?dot ?[\])}]", text, re.I)) and text[-1].isalnum() | (text[-1] in "])}") and text[0].isalnum()
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(byte_sized, parts))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and text[0].isdigit() and text[-1].isdigit()
    return 8 <= len(d) <= 15 and text[-1].isdigit() and (text[0].isdigit() or text[0] in "+(") and not re.search(r"[^\W\d_]", text)


def whole_groups_of(texts: list[str], chars: int = 1 << 20) -> Iterator[range]:
    """Places of texts that come to about `chars` characters, or of one longer text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= chars:
            yield range(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield range(begin, len(texts))


def proposed(texts: list[str], tagger: Tagger) -> Iterator[tuple[int, str, int, int]]:
    """Spans (text, kind, start, end) that the field's labels give, in order."""
    for own in whole_groups_of(texts):
        lens = np.array([len(texts[i]) + 1 for i in own])
        points = np.frombuffer("".join(texts[i] + "\n" for i in own).encode("utf-32-le", "surrogatepass"), "<u4")
        starts, ends, shape = tagger.tokens(points)
        begin = np.cumsum(lens) - lens
        text = np.searchsorted(begin, starts, "right") - 1
        apart = np.r_[True, starts[1:] > ends[:-1]][: len(starts)]
        y = tagger.labels(shape, apart, text)
        last = -1
        for j in np.flatnonzero(y).tolist():
            if j <= last:
                continue
            kind, last = LABELS[y[j]][2:], j
            while last + 1 < len(y) and text[last + 1] == text[j] and LABELS[y[last + 1]] == f"I-{kind}":
                last += 1
            yield own[text[j]], kind, int(starts[j] - begin[text[j]]), int(ends[last] - begin[text[j]])


def added_spans(texts: list[str], tagger: Tagger, base: list[list[list[tuple[int, int]]]]) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text beside its base spans, without overlaps."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken = [sorted(s for kind in own for s in kind) for own in base]
    for i, kind, a, b in proposed(texts, tagger):
        if fits(kind, texts[i][a:b]) and not any(x < b and a < e for x, e in taken[i]) and not any(x < b and a < e for _, x, e in out[i][-1:]):
            out[i].append((kind, a, b))
    return out


_field: list[Field] = []


def field() -> Field:
    """The field that the labelled table gives, trained once in a process."""
    if not _field:
        _field.append(Field(labelled_table()))
    return _field[0]


def find(texts: list, model: Tagger) -> Iterator[tuple[list[list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text its base spans, and all spans by kind and start."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    for own, more in zip(base, added_spans(texts, model, base), strict=True):
        spans = [(KINDS[k], a, b) for k, found in enumerate(own) for a, b in found] + more
        yield own, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, then n_email_all ... n_phone_all (with those that the field adds); a row for each row.

    A null text is empty: no spans, an empty string for both lists. Offsets are code points. Spans that the field adds don't overlap others; repeated rows get equal results, and an empty table none; other columns aren't read. The field labels whole texts: a worker needs some 150 bytes for each character of a long one.
    """
    model = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held("personal data", lambda: Tagger(model))
        for b in batches:
            counts, digests, spans = [], [], []
            for base, every in find(texts_of(b), tagger):
                counts.append([*map(len, base), *(sum(s[0] == k for s in every) for k in KINDS)])
                line = ",".join(f"{KINDS[k]}:{a}:{e}" for k, found in enumerate(base) for a, e in found)
                digests.append(hashlib.sha256(line.encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{e}" for k, a, e in every))
            n = list(map(pa.array, np.array(counts, np.int64).reshape(-1, 8).T.copy()))
            yield pa.record_batch([b.column(0), *n[:4], pa.array(digests, pa.string()), pa.array(spans, pa.string()), *n[4:]], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"n_{k}_all" for k in KINDS)])

    ready(docs.sparkSession)
    counts = [", ".join(f"n_{k}{end} long" for k in KINDS) for end in ("", "_all")]
    return spread(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {counts[0]}, base_sha256 string, spans string, {counts[1]}")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with every span in `column` replaced by its kind in angle brackets; other columns and null texts stay."""
    model = field()
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held("personal data", lambda: Tagger(model))
        for b in batches:
            out, texts = [], b.column(place).to_pylist()
            for t, (_, spans) in zip(texts, find(texts, tagger), strict=True):
                parts, last = [], 0
                for kind, a, e in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= last:
                        parts += [t[last:a], f"<{kind.upper()}>"]
                    last = max(last, e)
                out.append(t if t is None else "".join(parts) + t[last:])
            yield b.set_column(place, column, pa.array(out, pa.string()))

    ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))

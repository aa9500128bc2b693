"""Toxicity: gradient-boosted trees over dense features of a document, with isotonic calibration."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, fold, groups, spread, table
from .scoring import in_order, labelled, scored

#: Labelled rows to learn from (whole texts), and the lexicon's size.
SAMPLE_ROWS, LEXICON = 6000, 64
#: A toxic document asks for so many terms of its own.
COVER = 4
WORD = re.compile(r"[^\W_][\w'@$*!]*", re.U)
#: Words of the second person, and characters that stand for letters.
SECOND = frozenset("you your yours yourself u ur du dich dir dein ihr tu te toi vous ton ta tes vos tú ti usted tus".split())
STAND = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "'": None})
NEAR = 4


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def plain(word: str) -> str:
    """In lower case, with characters that stand for letters undone where the word has letters too."""
    low = word.lower().rstrip("!'*$@")
    return low if low.isalpha() or not any(map(str.isalpha, low)) else low.translate(STAND)


def letters_of(word: str) -> str:
    """What the lexicon compares: without letters in a row of three or more."""
    return re.sub(r"(.)\1{2,}", r"\1", plain(word))


def terms(word: str) -> tuple[str, ...]:
    """What the lexicon may hold of a word: it, and its beginnings of three to seven letters."""
    p = letters_of(word)
    return (p, *(f"{p[:n]}~" for n in (7, 6, 5, 4, 3) if len(p) > n))


class Features:
    """A row of numbers for each text. lexicon: word -> weight."""

    NAMES = ("hits", "weighted", "density", "kinds", "strongest", "first", "second person", "near you", "capitals", "capital hits", "obfuscated", "punctuation", "exclamation", "words", "digits", "bunched")

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.names = {w: i + 1 for i, w in enumerate(sorted(lexicon))}
        self.memo = Memo(self._rows, 5)

    def _rows(self, words: list[str]) -> np.ndarray:
        rows = np.zeros((len(words), 5), np.float32)
        for i, w in enumerate(words):
            p = max((t for t in terms(w) if t in self.lexicon), key=self.lexicon.__getitem__, default="")
            rows[i] = (self.names.get(p, 0), self.lexicon.get(p, 0), plain(w) in SECOND, len(w) > 1 and w.isupper(), p != "" and letters_of(w) != w.lower())
        return rows

    def __call__(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), len(self.NAMES)))
        sums = np.zeros((len(texts), 12))
        kinds: dict[int, set] = {}
        for owners, parts in groups(texts):
            words, counts = [], []
            for t in parts:
                own = words_of(t)
                counts.append(len(own))
                words += own
            at = self.memo(words)
            r = self.memo.table[at]
            owner = np.repeat(np.array(owners), counts) if words else np.zeros(0, np.int64)
            for i, t in zip(owners, parts, strict=True):
                sums[i, 0] += len(t)
                sums[i, 1] += t.count("!") + t.count("?")
                sums[i, 2] += t.count(".") + t.count(",") + t.count("#") + t.count("*") + t.count("$") + t.count("%") + t.count("&") + t.count("|")
            n = len(texts)
            sums[:, 3] += np.bincount(owner, minlength=n)
            sums[:, 4] += np.bincount(owner, r[:, 2], n)
            sums[:, 5] += np.bincount(owner, r[:, 3], n)
            hit = np.flatnonzero(r[:, 0])
            of, row = owner[hit], r[hit]
            sums[:, 6] += np.bincount(of, minlength=n)
            sums[:, 7] += np.bincount(of, row[:, 1], n)
            sums[:, 8] += np.bincount(of, row[:, 3], n)
            sums[:, 9] += np.bincount(of, row[:, 4], n)
            np.maximum.at(out[:, 4], of, row[:, 1])
            you = np.flatnonzero(r[:, 2])
            if len(you) and len(hit):
                after = np.searchsorted(you, hit)
                gap = np.full(len(hit), NEAR + 1)
                for j in (np.minimum(after, len(you) - 1), np.maximum(after - 1, 0)):
                    gap = np.minimum(gap, np.where(owner[you[j]] == of, abs(you[j] - hit), NEAR + 1))
                sums[:, 10] += np.bincount(of, gap <= NEAR, n)
            if len(hit) > 1:
                sums[:, 11] += np.bincount(of[1:], (np.diff(hit) <= 12) & (of[1:] == of[:-1]), n)
            for i, k in zip(of.tolist(), row[:, 0].tolist(), strict=True):
                kinds.setdefault(i, set()).add(k)
        size, n = np.maximum(sums[:, 0], 1), np.maximum(sums[:, 3], 1)
        out[:, 0], out[:, 1], out[:, 2] = sums[:, 6], sums[:, 7], 100 * sums[:, 7] / n
        for i, k in kinds.items():
            out[i, 3] = len(k)
        out[:, 5] = np.log1p(sums[:, 6]) - np.log1p(n / 100)
        out[:, 6], out[:, 7] = sums[:, 4] / n, sums[:, 10]
        out[:, 8], out[:, 9], out[:, 10] = sums[:, 5] / n, sums[:, 8], sums[:, 9]
        out[:, 11], out[:, 12], out[:, 13] = sums[:, 2] / size, sums[:, 1] / size, np.log1p(sums[:, 3])
        out[:, 14], out[:, 15] = sums[:, 0] / n, sums[:, 11]
        return out


class Trees:
    """Gradient-boosted trees of fixed depth on logistic loss, split on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 4.0):
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        z = np.full(len(y), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            at = np.zeros(len(y), np.int64)
            splits = []
            for level in range(depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-6)
                feature, cut_at = np.zeros(nodes, np.int64), np.full(nodes, bins + 1)
                for f, b in enumerate(binned):
                    key = at * (bins + 1) + b
                    sg = np.bincount(key, g, nodes * (bins + 1)).reshape(nodes, -1).cumsum(axis=1)
                    sh = np.bincount(key, h, nodes * (bins + 1)).reshape(nodes, -1).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sh < least) | (th - sh < least)] = 0
                    j = gain.argmax(axis=1)
                    better = gain[np.arange(nodes), j] > best
                    best[better] = gain[np.arange(nodes), j][better]
                    feature[better], cut_at[better] = f, j[better]
                at = 2 * at + (binned[feature[at], np.arange(len(y))] > cut_at[at])
                splits.append((feature, cut_at))
            leaf = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + 1)
            z += leaf[at]
            self.trees.append((splits, leaf))

    def logit(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        z, all_rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for feature, cut_at in splits:
                at = 2 * at + (binned[feature[at], all_rows] > cut_at[at])
            z += leaf[at]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function of z with the least squares to y, by pooling neighbours that fall: points and values to interpolate between."""
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(z[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools[-1]
            pools[-1] = [(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2]
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, curve: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def scorer(self):
        features = Features(self.lexicon)

        def score(texts: list) -> np.ndarray:
            if self.trees is None:
                return np.zeros(len(texts))
            z = self.trees.logit(features(texts))
            # a small share of the uncalibrated score keeps the order within a step
            return 0.98 * np.interp(z, *self.curve) + 0.02 / (1 + np.exp(-z))

        return score


class Terms:
    """The terms of each text, as numbers."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        self.of = [np.fromiter({known.setdefault(t, len(known)) for w in set(words_of(x)) for t in terms(w)}, np.int32) for x in texts]
        self.names = list(known)


def learn_lexicon(words: Terms, y: np.ndarray, rows: np.ndarray, most: int = LEXICON, candidates: int = 1500) -> dict[str, float]:
    """The terms whose documents are toxic far more often than others, with their log-odds: the best by a chi test first, then the best on the toxic documents that fewer than COVER of the others are in; none begins another."""
    count = lambda label: np.bincount(np.concatenate([words.of[i] for i in rows[y[rows] == label]] or [np.zeros(0, np.int32)]), minlength=len(words.names))
    toxic, clean = count(1), count(0)
    t, c = int(y[rows].sum()), int((1 - y[rows]).sum())
    if not t or not c:
        return {}
    least = max(3, t // 200)
    test = lambda a, b: (a - t * (a + b) / (t + c)) / np.sqrt(np.maximum(t * (a + b) / (t + c), 1e-9))
    odds = np.log((toxic + 0.5) / (t - toxic + 0.5) * (c - clean + 0.5) / (clean + 0.5))
    good = np.flatnonzero((toxic >= least) & (odds > 1.5))
    names = words.names
    good = good[sorted(range(len(good)), key=lambda i: (-test(toxic[good[i]], clean[good[i]]), -len(names[good[i]]), names[good[i]]))[:candidates]]
    place = np.full(len(names), -1)
    place[good] = np.arange(len(good))
    own = rows[y[rows] == 1]
    has = np.zeros((len(good), len(own)), bool)
    for j, i in enumerate(own):
        at = place[words.of[i]]
        has[at[at >= 0], j] = True
    out, cover, stems = {}, np.zeros(len(own), np.int64), [names[i].rstrip("~") for i in good]
    free = np.ones(len(good), bool)
    while len(out) < most and free.any():
        left = has[:, cover < COVER].sum(axis=1)
        score = np.where(free & (left >= least), test(left, clean[good]), 0)
        k = int(score.argmax())
        if score[k] < 3:
            break
        out[names[good[k]]] = float(odds[good[k]])
        cover += has[k]
        free &= [not (s.startswith(stems[k]) or stems[k].startswith(s)) for s in stems]
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic) -> a model, learned from the whole texts of about `most` labelled rows. Lexicon, trees and calibration each see rows that the one before wasn't learned from, by five folds. Without rows of both kinds it scores 0 always."""
    rows = in_order(labelled(docs, labels, "toxic", most).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").collect())
    y = np.array([r.y for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, None, None)
    texts, words = [r.text for r in rows], Terms([r.text for r in rows])
    part, every = np.random.default_rng(5).integers(0, 5, len(y)), np.arange(len(y))
    x, z = np.zeros((len(y), len(Features.NAMES))), np.zeros(len(y))
    for k in range(5):
        own = np.flatnonzero(part == k)
        x[own] = Features(learn_lexicon(words, y, every[part != k]))([texts[i] for i in own])
    for k in range(5):
        other = part != k
        if other.any() and not other.all():
            z[~other] = Trees(x[other], y[other]).logit(x[~other])
    return Model(learn_lexicon(words, y, every), Trees(x, y), isotonic(z, y))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "labels")
    held = fold(5) == 0
    model = fit(docs.where(~held), labels.where(~held))
    return scored(docs, model.scorer, [F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")])

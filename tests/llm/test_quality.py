"""Word vectors and pooled features against plain loops, the network's gradients, and the held-out rows."""

import numpy as np
import pytest

from graphloom.llm import quality as q
from graphloom.llm.common import table
from test_operators import auc

SF = "/root/testdata/sf0.01"
TEXTS = ["the cat sat on the mat", "", "Cat\tsat\n\n12 WORDS, ünï—x\nsat", "a\na\na b", " \n ", "x" * 30 + " 3.5 !! the cat"]


def plain_hash(word):
    h = sum((b + 1) * pow(q.BASE, i, 1 << 64) for i, b in enumerate(word.encode())) % (1 << 64)
    h ^= h >> 31
    h = h * q._MIX % (1 << 64)
    return h ^ (h >> 32)


def words_of(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def test_tokens_are_words():
    t = q.Tokens(TEXTS)
    assert [(p, h) for p, h in zip(t.part.tolist(), t.hash.tolist())] == [(i, plain_hash(w)) for i, x in enumerate(TEXTS) for w in words_of(x)]
    part, h = t.lines()
    lines = [(i, line) for i, x in enumerate(TEXTS) for line in x.split("\n")]
    assert [(p, g) for p, g, (_, line) in zip(part.tolist(), h.tolist(), lines) if line] == [(i, plain_hash(line)) for i, line in lines if line]
    assert len(q.Tokens([]).part) == 0


def test_word_vectors_are_sums_of_contexts(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None] * 3)]
    got = q.word_vectors(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    index, sums = q.index_vectors().astype(int), np.zeros((q.BUCKETS, q.WIDTH))
    for _, t in rows:
        words = [plain_hash(w) >> 48 for w in words_of(t or "")]
        for i, w in enumerate(words):
            for j in range(max(0, i - q.WINDOW), min(len(words), i + q.WINDOW + 1)):
                if j != i:
                    sums[w] += index[words[j]]
    norm = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, sums / norm, atol=1e-6)
    cat, mat = (got[plain_hash(w) >> 48] for w in ("cat", "mat"))
    assert not np.allclose(cat, mat)  # words of one shape


def test_pool_is_a_mean_over_words():
    vectors = np.random.default_rng(1).normal(size=(q.BUCKETS, q.WIDTH)).astype(np.float32)
    got = q.Pool(vectors)([*TEXTS, None])
    for row, t in zip(got, [*TEXTS, ""]):
        words, lines = words_of(t), t.split("\n")
        n = max(1, len(words))
        assert np.allclose(row[: q.WIDTH], sum((vectors[plain_hash(w) >> 48] for w in words), np.zeros(q.WIDTH)) / n, atol=1e-5)
        letters = [sum(c.isalpha() or ord(c) > 127 for c in w) for w in words]
        assert np.allclose(row[q.WIDTH : q.WIDTH + 2], [sum(k > 0 for k in letters) / n, sum(k / len(w) for k, w in zip(letters, words)) / n])
        assert np.allclose(row[-4:], [np.log1p(len(words)) / 8, len(set(words)) / n, (len(lines) - len(set(lines))) / len(lines), not words])


def test_gradients_are_slopes():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(9, 5)), rng.integers(0, 2, 9).astype(float), rng.random(9)
    p = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    _, grads = q.loss_and_gradients(p, x, y, w)
    for a, g in zip(p, grads):
        for at in np.ndindex(a.shape):
            old, a[at] = a[at], a[at] + 1e-6
            up = q.loss_and_gradients(p, x, y, w)[0]
            a[at] = old - 1e-6
            down = q.loss_and_gradients(p, x, y, w)[0]
            a[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


@pytest.mark.parametrize("columns, least", [(slice(None), 0.99), (slice(0, q.WIDTH), 0.9)])
def test_held_out_rows(spark, columns, least):
    """All features, and the word vectors alone."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    vectors = q.word_vectors(docs)
    held = q.fold(3) == 1
    (x, y), (hx, hy) = (q.pooled(docs.where(f), labels, vectors) for f in (~held, held))
    assert auc(hy, q.Network(x[:, columns], y).probability(hx[:, columns])) > least

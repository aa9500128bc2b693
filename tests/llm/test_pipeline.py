"""The corpus pipeline, stage by stage, against plain versions."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import packing, pii, quality, simhash
from graphloom.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_groups(rows, least=0.8):
    """rows (doc_id, text) -> the smallest doc_id of each one's group."""
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    ids = sorted(sets)
    of = {i: i for i in ids}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / both if both else 1.0) >= least:
                a, b = sorted((top(i), top(j)))
                of[b] = a
    return {i: top(i) for i in ids}


def test_near_copies_are_brute_force(spark, odd):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = rng.choice(words, 150).tolist()
        for k in range(10):
            own = list(base)
            for at in rng.integers(0, 150, k // 4):
                own[at] = "other"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == brute_groups(rows)
    kept = simhash.keep_one(odd).collect()
    assert len(kept) == len({r.doc_id for r in kept}) and {r.doc_id for r in kept} == {1, 3, 6, 7, None, 9}
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_long_texts_near_the_threshold_are_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.integers(0, 5000, 800)]
        for n in (0, *rng.integers(15, 21, 2)):  # replaced words: similarities from 0.76 to 0.84
            own = list(base)
            for at in rng.choice(160, n, replace=False) * 5:
                own[at] = f"other{len(rows)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want
    monkeypatch.setattr(simhash, "BYTES", 10_000)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want


def test_copies_that_differ_by_repeats_of_a_line(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(8):
        base, line = ([f"w{i}" for i in rng.integers(0, 5000, n)] for n in (400, 8))
        rows += [(len(rows) + k, " ".join(base + line * n)) for k, n in enumerate((1, 20, 60))]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(rows) == {i: i - i % 3 for i in range(24)}


def test_crowds_beyond_a_block_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = [(i, " ".join(f"w{j}" for j in range(200)) + f" x{i}") for i in range(60)]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_run_is_the_plain_version(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    score = quality.fit(docs, table(spark, SF, "labels")).scorer()
    good = [i for i, s in zip(rows, score([r.text for r in rows.values()])) if s >= 0.5]
    single = sorted({top for top in brute_groups([(i, rows[i].text) for i in good]).values()})
    texts = {}
    for i, (_, spans) in zip(single, pii.find([rows[i].text for i in single], pii.Tagger(pii.field()))):
        t = rows[i].text
        for kind, a, b in sorted(spans, key=lambda s: -s[1]):
            t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        texts[i] = t
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == set(single)
    times = {}
    for r in found:
        if r.start == 0:
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(1 <= n <= corpus_pipeline.REPETITION for n in times.values())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    want = {}
    for i, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[i, at] = (len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids))
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in found} == want
    assert len(found) == sum(times[i] for i, _ in want)


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[1:]])
def test_stages_on_odd_rows(spark, odd, stage):
    own = odd.select("doc_id", "text", "lang", "source", "n_chars")
    stage(spark, own, SF).collect()
    assert stage(spark, own.limit(0), SF).count() == 0

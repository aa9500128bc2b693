"""Removal of repeats, and its transforms, against brute force."""

import hashlib

import numpy as np
import pytest

from graphloom.llm import merged_bwt, substrings
from graphloom.llm.common import table


def brute(rows, length=50):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if i is not None:
                seen[k] = min(seen.get(k, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if i is not None and seen[b[s : s + length]] < i:
                gone[s : s + length] = True
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def ask(docs):
    return sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=str)


@pytest.mark.parametrize("shard", [40, 200, 1 << 17])
def test_merged_transforms_order_suffixes(shard):
    rng = np.random.default_rng(shard)
    strings = [bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) for _ in range(60)]
    strings += strings[:5]
    t = merged_bwt.of_strings(strings, shard)
    whole, starts = b"\0".join(strings) + b"\0", np.cumsum([0, *(len(s) + 1 for s in strings)])
    suffix = lambda p: whole[p : starts[np.searchsorted(starts, p, "right")] - 1]
    own = [suffix(p) for p in t.order.tolist()]
    assert sorted(t.order.tolist()) == list(range(len(whole))) and own == sorted(own)
    for i in range(1, len(own)):
        n = next((k for k, (x, y) in enumerate(zip(own[i], own[i - 1])) if x != y), min(len(own[i]), len(own[i - 1])))
        assert t.common[i] == n


def test_anchors_are_alike_in_equal_strings():
    rng = np.random.default_rng(1)
    for kinds in (2, 4, 200):
        data = rng.integers(0, kinds, 3000).astype(np.uint8)
        data[2000:2200] = data[100:300]
        sizes = np.array([1000, 900, 40, 1060])
        ends, owner = np.cumsum(sizes), np.repeat(np.arange(4), sizes)
        at, h = substrings.anchors(data, ends, owner, 50, 16)
        of = {}
        for s in range(2951):
            if ends[owner[s]] - s >= 50:
                inside = [(a - s, x) for a, x in zip(at.tolist(), h.tolist()) if s <= a <= s + 34]
                assert inside
                low = min(x for _, x in inside)
                mine = [p for p, x in inside if x == low]
                assert of.setdefault(data[s : s + 50].tobytes(), (mine[0], low))[1] == low


def test_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert ask(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, spark):
    assert ask(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert ask(odd.limit(0)) == []


@pytest.mark.parametrize("split", [1, 3, 4096])
def test_overlaps_and_crowds(spark, monkeypatch, split):
    monkeypatch.setattr(substrings, "SPLIT", split)
    rng = np.random.default_rng(split)
    passage = "".join(rng.choice(list("abcdefgh "), 120))
    rows = [(i, "".join(rng.choice(list("xyz "), int(rng.integers(0, 40)))) + passage[int(rng.integers(0, 60)) : int(rng.integers(60, 121))] + "".join(rng.choice(list("uvw "), int(rng.integers(0, 40))))) for i in range(60)]
    rows += [(60, passage), (61, passage), (62, "ab" * 80), (63, "ba" * 90), (64, passage[:49]), (65, passage[:50]), (3, passage * 2)]
    assert ask(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("length,shard", [(50, 64), (50, 1 << 15), (7, 32), (12, 100)])
def test_repeats_are_those_of_brute_force(length, shard):
    rng = np.random.default_rng(length + shard)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 90)).astype(np.uint8)) for _ in range(40)]
    strings += [strings[0], strings[1][3:], b"x" * 80, b"x" * (length - 1)]
    places, interval = merged_bwt.repeats(strings, length, shard)
    whole, starts, of = b"".join(strings), np.cumsum([0, *map(len, strings)]), {}
    for s, lo in zip(strings, starts):
        for i in range(len(s) - length + 1):
            of.setdefault(s[i : i + length], []).append(int(lo) + i)
    want = sorted(tuple(v) for v in of.values() if len(v) > 1)
    assert sorted(tuple(sorted(places[interval == k].tolist())) for k in np.unique(interval)) == want


def test_each_string_has_one_anchor():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 100):
        data = rng.integers(0, kinds, 3000).astype(np.uint8)
        sizes = np.array([1000, 900, 40, 1060])
        ends, owner = np.cumsum(sizes), np.repeat(np.arange(4), sizes)
        at, h, first, last = substrings.owned(data, ends, owner, 50, 16)
        strings = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(first, last)])
        assert sorted(strings.tolist()) == [s for s in range(2951) if ends[owner[s]] - s >= 50]
        assert (at >= last).all() and (at + 16 <= first + 50).all()


def test_packed_anchors_come_back():
    rng = np.random.default_rng(3)
    n = 500
    of = np.sort(rng.integers(0, 40, n))
    m, tid, lo = of.astype(np.int64), of * 7919 - 5, rng.integers(0, 1 << 31, n)
    h, c, s, size = rng.integers(-(1 << 62), 1 << 62, n), rng.integers(0, 1 << 48, n), rng.integers(0, 1 << 32, n).astype(np.uint32), rng.integers(50, 85, n)
    back = substrings._unpack(substrings._pack(h, c, s, lo, size, m, tid))
    for x, y in zip(back, (h, c, s, m, tid, lo * substrings.SPAN + size), strict=True):
        assert np.array_equal(x, y)


def test_contexts_that_an_earlier_row_has():
    rng = np.random.default_rng(5)
    for low, all_ in ((0, True), (-20, False)):  # below zero, h and c have clashing keys: such rows may be left, none may be added
        h, c, m = (rng.integers(low, 20, 3000) for _ in range(3))
        want = np.array([min(m[(h == a) & (c == b)]) < x for a, b, x in zip(h, c, m)])
        got = substrings._earlier(h, c, m)
        assert got.any() and not (got & ~want).any() and (not all_ or (got == want).all())
    none = np.zeros(0, np.int64)
    assert not len(substrings._earlier(none, none, none))

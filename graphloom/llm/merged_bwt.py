"""Burrows-Wheeler transforms of shards, merged by refining their interleave; common prefixes come out of the refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """order: the suffixes in order, as places in the joined strings; before: the symbol before each (0: an end); ends: the number of strings; common: symbols that a suffix shares with the one before it."""

    order: np.ndarray
    before: np.ndarray
    ends: int
    common: np.ndarray | None = None


def joined(strings: list[bytes]) -> np.ndarray:
    """The strings as symbols (byte + 1), each with an end (0)."""
    out = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    out[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
    return out


def transform(symbols: np.ndarray) -> Transform:
    """By doubling of prefixes; ends are all different, in order of place."""
    ends, n = np.flatnonzero(symbols == 0), len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    k = 63 // bits
    rank, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):  # as many symbols as a number holds, none beyond an end
        symbol = np.r_[symbols[i:], np.zeros(min(i, n), symbols.dtype)].astype(np.int64)
        rank = rank << bits | np.where(open_, symbol, 0)
        open_ &= symbol != 0
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank)
    fresh = np.r_[False, rank[order][1:] != rank[order][:-1]]
    fresh[: len(ends)] = True
    rank[order] = np.cumsum(fresh)
    while not fresh[1:].all() and k < n:
        key = rank * (n + 512)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        key = key[order]
        fresh = np.r_[False, key[1:] != key[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        k *= 2
    return Transform(order, symbols[order - 1], len(ends))


def merge(a: Transform, b: Transform, shift: int, enough: int | None = None) -> Transform:
    """Of the strings of both, b's places moved by shift. Each round sorts the interleave by one symbol more, by dealing it stably by the symbol before; where two neighbours first come apart is their common prefix's end. It ends when a round changes nothing, or, for a last merge, when `enough` symbols are sorted by: common prefixes are then told up to that."""
    n, ends = len(a.order) + len(b.order), a.ends + b.ends
    side = np.r_[np.zeros(len(a.order), bool), np.ones(len(b.order), bool)]
    of_ends = np.r_[np.zeros(a.ends, bool), np.ones(b.ends, bool)]
    block, apart, common, h = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, np.int32), 0
    before = np.empty(n, a.before.dtype)
    while True:
        h += 1
        before[~side], before[side] = a.before, b.before
        by = np.argsort(before, kind="stable")
        symbol, was, to = before[by], block[by], side[by]
        to[:ends] = of_ends
        now = np.r_[True, (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])]
        now[:ends] = True
        new = now & ~apart
        common[new] = h - 1
        done = h == enough or not new.any() and np.array_equal(to, side)
        side, apart, block = to, now, np.cumsum(now, dtype=np.int32)
        if done:
            break
    common[~apart] = h
    order = np.empty(n, np.int64)
    order[~side], order[side] = a.order, b.order + shift
    before[~side], before[side] = a.before, b.before
    return Transform(order, before, ends, common)


NOTHING = Transform(np.zeros(0, np.int64), np.zeros(0, np.uint8), 0)


def of_strings(strings: list[bytes], shard: int = 1 << 16, enough: int | None = None) -> Transform:
    """Strings are dealt into shards of about so many symbols; shards' transforms are merged in pairs, the last up to `enough` symbols."""
    parts, own, size = [], [], 0
    for s in strings:
        own.append(s)
        size += len(s) + 1
        if size >= shard:
            parts.append(own)
            own, size = [], 0
    if own:
        parts.append(own)
    return _merged([joined(own) for own in parts], enough)


def _merged(shards: list[np.ndarray], enough: int | None) -> Transform:
    made = [(transform(symbols), len(symbols)) for symbols in shards]
    if len(made) == 1:
        return merge(made[0][0], NOTHING, 0, enough)
    while len(made) > 1:
        made = [(merge(x[0], y[0], x[1], enough if len(made) == 2 else None), x[1] + y[1]) if y else x for x, y in zip(made[::2], [*made[1::2], None], strict=False)]
    return made[0][0]


def blocks(strings: list[bytes], width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each string as up to `width` strings of blocks of `width` bytes, from its first bytes on, as far as `length` bytes follow: numbers of blocks, each string with an end (0), and each symbol's place in the strings, one after another (-1: an end)."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    starts, fits = np.cumsum(sizes) - sizes, sizes - width + 1
    phases = np.clip(sizes - length + 1, 0, width)
    each, more = fits // width, fits % width
    total = np.where(phases > 0, phases * each + np.minimum(phases, more) + phases, 0)
    base = np.cumsum(total) - total
    of = np.repeat(np.arange(len(strings)), sizes)
    at = np.arange(len(data)) - starts[of]
    place = np.flatnonzero((at < fits[of]) & (at % width < phases[of]))
    of, at = of[place], at[place]
    value = np.zeros(len(place), np.int64)
    for i in range(width):
        value = value << 8 | data[place + i]
    phase = at % width
    to = base[of] + phase * each[of] + np.minimum(phase, more[of]) + phase + at // width
    known, number = np.unique(value, return_inverse=True)
    symbols = np.zeros(int(total.sum()), np.uint16 if len(known) < 1 << 16 else np.int32)
    places = np.full(len(symbols), -1)
    symbols[to], places[to] = number + 1, place
    return symbols, places


def repeats(strings: list[bytes], length: int, shard: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The places (in the strings, one after another) where a string of `length` bytes begins that begins elsewhere too, and the number of its interval; intervals ascend. Transforms are of blocks of bytes, so that a round of a merge sorts by a whole block."""
    width = max(d for d in range(1, 7) if length % d == 0)
    symbols, places = blocks(strings, width, length)
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(symbols == 0) + 1
    cuts = ends[np.flatnonzero(np.diff(ends // shard, prepend=0))]
    t = _merged([x for x in np.split(symbols, cuts) if len(x)], length // width)
    at, interval = repeated(t, length // width)
    return places[at], interval


def repeated(t: Transform, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of suffixes that share `least` symbols with another, and the number of the interval each is in; intervals ascend."""
    same = t.common >= least
    inside = same | np.r_[same[1:], False]
    return t.order[inside], np.cumsum(~same[inside])

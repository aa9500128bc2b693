"""Murmur3 digests as columns: 32 bits, and 128 bits from four lanes of 32 or two of 64, reckoned by numpy over values of one length at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

# Fixed values of the public algorithm, and the default seed: the factors of each lane, what is added to it, by how far it is turned; the last mix.
FACTORS_32, ADD_32 = (0xCC9E2D51, 0x1B873593), 0xE6546B64
LANES = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
LANE_ADDS = (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
LANE_TURNS = ((15, 19), (16, 17), (17, 15), (18, 13))
FACTORS_64 = (0x87C37B91114253D5, 0x4CF5AD432745937F)
ADDS_64 = (0x52DCE729, 0x38495AB5)
TURNS_64 = ((31, 27), (33, 31))
MIX_32, MIX_64 = (0x85EBCA6B, 0xC2B2AE35), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SEED = 65765745


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return (x << x.dtype.type(by)) | (x >> x.dtype.type(bits - by))


def _finish(x: np.ndarray) -> np.ndarray:
    if x.dtype == np.uint32:
        shifts, factors = (16, 13, 16), MIX_32
    else:
        shifts, factors = (33, 33, 33), MIX_64
    for shift, factor in zip(shifts, (*factors, 1), strict=True):
        x = (x ^ (x >> x.dtype.type(shift))) * x.dtype.type(factor)
    return x


def _spread(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """The first gets the sum of all, the others then the first."""
    total = lanes[0]
    for x in lanes[1:]:
        total = total + x
    return [total, *(x + total for x in lanes[1:])]


def _lanes(data: np.ndarray, seed: int, kind: type, factors: tuple, turns: tuple, adds: tuple) -> np.ndarray:
    """The 128 bits of each row of bytes (all of one length), in memory order of a little-endian machine."""
    rows, size = data.shape
    n = 16 // np.dtype(kind).itemsize
    words = np.zeros((rows, -(-size // 16) * 16), np.uint8)
    words[:, :size] = data
    words = words.view(np.dtype(kind).newbyteorder("<")).astype(kind).reshape(rows, -1, n)
    state = [np.full(rows, seed, kind) for _ in range(n)]

    def mixed(block: int, i: int) -> np.ndarray:
        return _turn(words[:, block, i] * kind(factors[i]), turns[i][0]) * kind(factors[(i + 1) % n])

    for block in range(size // 16):
        for i in range(n):
            state[i] = (_turn(state[i] ^ mixed(block, i), turns[i][1]) + state[(i + 1) % n]) * kind(5) + kind(adds[i])
    if size % 16:
        state = [x ^ mixed(size // 16, i) for i, x in enumerate(state)]
    state = _spread([x ^ kind(size) for x in state])
    state = _spread([_finish(x) for x in state])
    return np.stack(state, axis=1).astype(np.dtype(kind).newbyteorder("<")).view(np.uint8)


def murmur128_lanes(data: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Four lanes of 32 bits."""
    return _lanes(data, seed, np.uint32, LANES, LANE_TURNS, LANE_ADDS)


def murmur128_words(data: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Two lanes of 64 bits."""
    return _lanes(data, seed, np.uint64, FACTORS_64, TURNS_64, ADDS_64)


def murmur32(data: np.ndarray, seed: int = SEED) -> np.ndarray:
    rows, size = data.shape
    words = np.zeros((rows, -(-size // 4) * 4), np.uint8)
    words[:, :size] = data
    words = words.view("<u4").astype(np.uint32)
    k = _turn(words * np.uint32(FACTORS_32[0]), 15) * np.uint32(FACTORS_32[1])
    h = np.full(rows, seed, np.uint32)
    for i in range(size // 4):
        h = _turn(h ^ k[:, i], 13) * np.uint32(5) + np.uint32(ADD_32)
    if size % 4:
        h = h ^ k[:, -1]
    return _finish(h ^ np.uint32(size)).astype("<u4").reshape(-1, 1).view(np.uint8)


def digests(values: list[bytes], variant: Callable[[np.ndarray, int], np.ndarray], seed: int = SEED) -> list[bytes]:
    out: list[bytes] = [b""] * len(values)
    sizes: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        sizes.setdefault(len(v), []).append(i)
    for size, own in sizes.items():
        data = np.frombuffer(b"".join(values[i] for i in own), np.uint8).reshape(len(own), size)
        for i, d in zip(own, variant(data, seed), strict=True):
            out[i] = d.tobytes()
    return out


def _column(variant: Callable[[np.ndarray, int], np.ndarray]):
    """Upper-case hex digits of a text's digest; null for null. Equal values in a batch are hashed once."""

    @F.pandas_udf(T.StringType())
    def hex_digest(values: pd.Series) -> pd.Series:
        own = values.dropna().unique().tolist()
        found = digests([v.encode() for v in own], variant)
        known = {v: d.hex().upper() for v, d in zip(own, found, strict=True)}
        return pd.Series([known.get(v) for v in values], dtype=object)

    return hex_digest


murmur128_hex, murmur128_words_hex, murmur32_hex = _column(murmur128_lanes), _column(murmur128_words), _column(murmur32)

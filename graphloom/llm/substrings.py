"""Removal of byte strings that an earlier document has, by merged Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ready, spread, table
from .merged_bwt import repeats

LENGTH, GRAM = 50, 16
#: Contexts of one anchor beyond which its strings are dealt one by one, contexts that are transformed together, and anchors of a partition.
SPLIT, TOGETHER, ANCHORS = 4096, 800, 1_500_000
#: Anchors that a task packs before it sends them.
PACKED = 1_000_000
#: A place and a context's length in one number.
SPAN = 1 << 10
P = np.uint64(0x9E3779B97F4A7C15)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tid, text) with their texts compressed, as all later shuffles carry them."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array(map(squeeze, b.column(2).to_pylist()), pa.binary())], names=["doc_id", "tid", "text"])


def _opener():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(P), n, 1 << 64))


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over a[i : i + width], for each i that has them."""
    size, out = 1, a
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(a) - width + 1], out[width - size : width - size + len(a) - width + 1]) if width > size else out


def _grams(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and the smallest in each string of `length` bytes; 0 where a text has none."""
    whole, done, h, powers = data.astype(np.uint64) + np.uint64(1), 0, None, {1: data.astype(np.uint64) + np.uint64(1)}
    size = 1
    while 2 * size <= gram:
        x = powers[size]
        powers[2 * size] = x[:-size] * _power(size) + x[size:]
        size *= 2
    for size in sorted(powers, reverse=True):
        if gram - done >= size:
            x = powers[size][done:]
            h = x if h is None else h[: len(x)] * _power(size) + x[: len(h)]
            done += size
    h = h[: len(whole) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * P
    h = (h ^ (h >> np.uint64(29))) | np.uint64(1)
    least = _slide(h, length - gram + 1, np.minimum)
    least[ends[owner[: len(least)]] - np.arange(len(least)) < length] = 0
    return h, least


def _anchors(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    width = len(h) - len(least) + 1
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum)[: len(h)] == h)


def anchors(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """data: texts' bytes, one after another; ends[owner[i]]: the end of byte i's text -> places and hashes of the grams that are smallest in some string of `length` bytes of a text. Equal strings so have equal anchors at equal places."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, least = _grams(data, ends, owner, length, gram)
    at = _anchors(h, least)
    return at, h[at]


def owned(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors' places and hashes, and the first and last place where a string begins that is the anchor's own: of its smallest grams, the anchor is the leftmost. So each string has one anchor, which depends on the string only."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, least = _grams(data, ends, owner, length, gram)
    at = _anchors(h, least)
    string = np.flatnonzero(least)
    flags = np.zeros(len(h) + 1, np.int64)
    flags[at + 1] = 1
    of = np.cumsum(flags)[string]
    wrong = np.flatnonzero(h[at[of]] != least[string])
    while len(wrong):
        of[wrong] += 1
        wrong = wrong[h[at[of[wrong]]] != least[string[wrong]]]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    at = at[of[first]]
    return at, h[at], string[first], string[np.r_[first[1:], len(string)] - 1]


_POWERS: list[np.ndarray] = []


def digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of data[lo : hi] for each pair, from running sums of powers."""
    n = len(data)
    if not _POWERS or len(_POWERS[1]) < n + 1:
        table_ = np.random.default_rng(53).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        inverse = np.uint64(pow(int(P), -1, 1 << 64))
        grown = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 20), x)], dtype=np.uint64)
        _POWERS[:] = [table_, grown(P), grown(inverse)]
    table_, up, down = _POWERS
    sums = np.r_[np.uint64(0), np.cumsum(table_[data] * up[:n], dtype=np.uint64)]
    x = (sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)
    return (x ^ (x >> np.uint64(31))) * P


def sides(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Four 8-bit hashes for each anchor. A string of the anchor's own has it at one of the places that a hash stands for, so two anchors that share such a string share that hash; where none of its strings has it there, it is the place's own."""
    rest = length - gram
    out = np.zeros(len(at), np.uint64)
    for i in range(4):
        left, right, end = i * rest // 4, rest - (i + 1) * rest // 4, (i + 1) * rest // 4 + i // 3
        inside = (at - last < end) & (at - first >= left)
        x = digests(data, np.where(inside, at - left, at), np.where(inside, at + gram + right, at))
        x = np.where(inside, x, (at * 4 + i).astype(np.uint64) * P)
        out |= (x >> np.uint64(56)) << np.uint64(8 * i)
    return out.astype(np.uint32)


def _pack(h: np.ndarray, c: np.ndarray, s: np.ndarray, lo: np.ndarray, size: np.ndarray, m: np.ndarray, tid: np.ndarray) -> bytes:
    """Anchors' rows, those of a text together, as bytes: each text's m and tid once, numbers with empty bytes by planes of bytes, so that they compress."""
    new = np.r_[True, (tid[1:] != tid[:-1]) | (m[1:] != m[:-1])]
    step = np.diff(lo.astype(np.uint32), prepend=np.uint32(0))
    head = np.array([len(h), np.count_nonzero(new)], np.int64)
    planes = lambda x: x.view(np.uint8).reshape(-1, x.itemsize).T
    return b"".join(x.tobytes() for x in (head, h, planes(c), s, planes(m[new]), tid[new], planes(step), planes(size.astype(np.uint16)), np.packbits(new)))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """h, c, s, m, tid and the context's span of packed anchors."""
    n, texts = np.frombuffer(data, np.int64, 2).tolist()
    at = 16

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    def planes(kind, count: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return take(np.uint8, width * count).reshape(width, count).T.copy().view(kind).ravel()

    h, c, s, m, tid = take(np.int64, n), planes(np.int64, n), take(np.uint32, n), planes(np.int64, texts), take(np.int64, texts)
    lo, size = np.cumsum(planes(np.uint32, n), dtype=np.uint32).astype(np.int64), planes(np.uint16, n).astype(np.int64)
    of = np.cumsum(np.unpackbits(take(np.uint8, (n + 7) // 8), count=n)) - 1
    return h, c, s, m[of], tid[of], lo * SPAN + size


def _earlier(h: np.ndarray, c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether a row with the same h and c has a smaller m; of rows whose keys clash, those unlike the first are left for later."""
    if not len(h):
        return np.zeros(0, bool)
    key = h.view(np.uint64) ^ (c.view(np.uint64) * P)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])
    head = order[np.repeat(first, sizes)]
    same = (h[order] == h[head]) & (c[order] == c[head])
    least = np.repeat(np.minimum.reduceat(np.where(same, m[order], np.iinfo(np.int64).max), first), sizes)
    out = np.zeros(len(h), bool)
    out[order] = same & (m[order] > least)
    return out


def _anchor_rows(length: int, gram: int, parts: int):
    """Rows (doc_id, tid, text) -> (part, done, rows): packed for each part, each anchor's hash, 48 bits of its context's, its sides, m, tid and the context's span. A context is the bytes of the anchor's own strings.

    Where the same task has met a context in an earlier document, it is done: only tid and span are sent. So of a passage that very many documents have, a task sends one row to the anchor's part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            found.clear()
            known = _earlier(columns[0], columns[1], columns[5])
            lo, size, tid = (columns[i][known] for i in (3, 4, 6))
            columns = [x[~known] for x in columns]
            part = (columns[0].view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, columns = part[order], [x[order] for x in columns]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            packed = [_pack(*(x[lo:hi] for x in columns)) for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)]
            to, done = part[first].tolist(), [False] * len(packed)
            if len(tid):
                none = np.zeros(len(tid), np.int64)
                packed.append(_pack(none, none, none.astype(np.uint32), lo, size, none, tid))
                to.append(int(tid[0]) % parts)
                done.append(True)
            return pa.record_batch([pa.array(to, pa.int32()), pa.array(done, pa.bool_()), pa.array(packed, pa.binary())], names=["part", "done", "rows"])

        opened = _opener()
        for b in batches:
            whole, ids, tids = b.column(2), b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            lo, texts, size = 0, [], 0
            for hi in range(1, len(whole) + 1):
                texts.append(opened(whole[hi - 1].as_py()))
                size += len(texts[-1])
                if hi < len(whole) and size < 1 << 20:
                    continue
                sizes = np.fromiter(map(len, texts), np.int64, hi - lo)
                ends, owner = np.cumsum(sizes), np.repeat(np.arange(hi - lo), sizes)
                data = np.frombuffer(b"".join(texts), np.uint8)
                at, h, from_, last = owned(data, ends, owner, length, gram)
                of = owner[at]
                c = digests(data, from_, last + length) >> np.uint64(16)
                s = sides(data, at, from_, last, length, gram)
                found.append((h.view(np.int64), c.view(np.int64), s, from_ - (ends[of] - sizes[of]), last + length - from_, ids[lo + of], tids[lo + of]))
                if sum(len(x[0]) for x in found) > PACKED:
                    yield send()
                lo, texts, size = hi, [], 0
        if found:
            yield send()

    return run


def _shared(split: int):
    """Rows (part, done, packed anchors), all of an anchor's hash in one partition -> (tid, kind, g, span) of anchors that two documents have.

    kind 0: an earlier document has the whole context. 1: no earlier one has it, but other contexts of the anchor share a side, so strings in it may repeat; g is the anchor. 2: the same, of an anchor with more than `split` contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for done, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows = _unpack(x)
                if not done:
                    held.append(rows)
                    continue
                h, tid, span = rows[0], rows[4], rows[5]
                yield pa.record_batch([pa.array(x) for x in (tid, np.zeros(len(h), np.int32), h, span)], names=["tid", "kind", "g", "span"])
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        del held
        order = np.argsort(columns[0], kind="stable")
        h = columns[0][order]
        fresh = np.r_[True, h[1:] != h[:-1]]
        order = order[~(fresh & np.r_[fresh[1:], True])]
        h, c, s, m, tid, span = (x[order] for x in columns)
        del columns
        order = np.lexsort((m, c, h))
        h, c, s, m, tid, span = (x[order] for x in (h, c, s, m, tid, span))
        if not len(h):
            return
        fresh = np.r_[True, h[1:] != h[:-1]]
        new = fresh | np.r_[True, c[1:] != c[:-1]]
        first, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        several = (np.maximum.reduceat(m, first) > np.minimum.reduceat(m, first))[group]
        contexts = np.add.reduceat(new.astype(np.int64), first)[group]
        covered = m > m[np.flatnonzero(new)][np.cumsum(new) - 1]
        kind = np.where(covered, 0, np.where(contexts > split, 2, 1)).astype(np.int32)
        heads = np.flatnonzero(new)
        alike = np.zeros(len(heads), bool)
        for i in range(4):
            side = (group[heads] << 8) | (s[heads] >> np.uint32(8 * i) & np.uint32(0xFF)).astype(np.int64)
            _, of, n = np.unique(side, return_inverse=True, return_counts=True)
            alike |= n[of] > 1
        keep = covered | (several & (contexts > 1) & alike[np.cumsum(new) - 1])
        for at in range(0, len(h), 1 << 17):
            k = keep[at : at + (1 << 17)]
            yield pa.record_batch([pa.array(x[at : at + (1 << 17)][k]) for x in (tid, kind, h, span)], names=["tid", "kind", "g", "span"])

    return run


def _runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Their union, in order."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def _contexts(length: int):
    """Rows (m, tid, text, anchors) -> (g, context, m, tid, lo, hi): the bytes around anchors, or, for split ones, each string of `length` bytes there; and what is covered already, without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        opened = _opener()
        for b in batches:
            out = []
            for m, tid, text, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = opened(text)
                done = _runs([(a["span"] // SPAN, a["span"] // SPAN + a["span"] % SPAN) for a in found if not a["kind"]])
                out += [(tid, None, m, tid, lo, hi) for lo, hi in done]
                for a in found:
                    lo, hi = a["span"] // SPAN, a["span"] // SPAN + a["span"] % SPAN
                    if a["kind"] == 1:
                        out.append((a["g"], text[lo:hi], m, tid, lo, hi))
                    elif a["kind"] == 2:
                        for s in range(lo, hi - length + 1):
                            x = text[s : s + length]
                            out.append((xxhash.xxh64_intdigest(x, a["g"] & 0xFFFFFFFF) - (1 << 63), x, m, tid, s, s + length))
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), *[pa.int64()] * 4), strict=True)], names=["g", "context", "m", "tid", "lo", "hi"])


def _covers(length: int):
    """Rows (g, context, m, tid, lo, hi) sorted by g, context, m -> (tid, lo, hi): bytes that strings of an earlier document cover.

    Rows without context say so themselves; where an earlier document has a row's whole context, all of it is covered. For the first rows of each context, contexts are transformed and merged, group by group until TOGETHER are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[list] = []  # (context, m, [(tid, lo)]) of groups that are whole
        group: list[list] = []
        key = None
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            nonlocal heads, group
            if len(group) > 1:
                heads += group
            group = []

        def solve() -> None:
            nonlocal heads
            if not heads:
                return
            strings = [x[0] for x in heads]
            sizes = np.fromiter(map(len, strings), np.int64, len(strings))
            starts = np.cumsum(sizes) - sizes
            places, interval = repeats(strings, length)
            if len(places):
                of = np.searchsorted(starts, places, "right") - 1
                ms = np.array([x[1] for x in heads], np.int64)[of]
                first = np.flatnonzero(np.diff(interval, prepend=-1))
                low = np.repeat(np.minimum.reduceat(ms, first), np.diff(np.r_[first, len(ms)]))
                gone = np.sort(places[ms > low])
                of = np.searchsorted(starts, gone, "right") - 1
                first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(gone, prepend=0) > length))
                ends = gone[np.r_[first[1:], len(gone)] - 1] + length if len(gone) else gone
                for i, at, end in zip(of[first].tolist(), (gone - starts[of])[first].tolist(), (ends - starts[of[first]]).tolist(), strict=True):
                    out.extend((tid, lo + at, lo + end) for tid, lo in heads[i][2])
            heads = []

        def ready_rows() -> pa.RecordBatch:
            nonlocal out
            columns, out = list(zip(*out, strict=True)) or [[]] * 3, []
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["tid", "lo", "hi"])

        for b in batches:
            for g, context, m, tid, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if context is None:
                    out.append((tid, lo, hi))
                    continue
                if g != key:
                    close()
                    key = g
                    if len(heads) >= TOGETHER:
                        solve()
                if not group or group[-1][0] != context:
                    group.append([context, m, [(tid, lo)]])
                elif m == group[-1][1]:
                    group[-1][2].append((tid, lo))
                else:
                    out.append((tid, lo, lo + len(context)))
            if out:
                yield ready_rows()
        close()
        solve()
        yield ready_rows()

    return run


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, is_first, spans) -> the result."""
    opened = _opener()
    for b in batches:
        rows = []
        for doc_id, text, first, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = opened(text)
            n = len(text)
            if not first and doc_id is not None and n >= LENGTH:
                spans = [{"lo": 0, "hi": n}]
            runs = _runs([(x["lo"], x["hi"]) for x in spans or []])
            kept, last = hashlib.sha256(), 0
            for lo, hi in runs:
                kept.update(text[last:lo])
                last = hi
            kept.update(text[last:])
            rows.append((doc_id, n, sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row.

    Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller id goes. Null texts are empty; a null id is no smaller than any and has none smaller; rows with one id are no earlier than each other, whatever their texts; repeated rows have equal results; an empty table gives none.

    Whole copies of a text are told by its digest: only the smallest id's goes on. Of its strings, each has anchors, its grams of smallest hash, so a repeat shares them; anchors that two documents have are looked at with the bytes around, their contexts. A context that an earlier document has is covered (told by hashes of 64 and 48 bits); where contexts differ, transforms of them are merged, and intervals of LENGTH common bytes say which strings repeat. An anchor with very many contexts is split: each string around it then has its own group.
    """
    ready(docs.sparkSession)
    rows = spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("digest", F.md5("text")).withColumn("tid", F.xxhash64("doc_id", "digest"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("m")).select(F.xxhash64("m", "digest").alias("tid"), "m")
    packed = rows.select("doc_id", "tid", "text").mapInArrow(_squeezed, "doc_id long, tid long, text binary")
    packed = packed.withColumn("tid", F.coalesce("tid", F.lit(0)))  # not null, so all joins read one shuffle of it
    marked = packed.join(firsts, "tid", "left").select("tid", "doc_id", "text", F.col("m").isNotNull().alias("first"))
    single = marked.where("first").select("doc_id", "tid", "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(ready(docs.sparkSession).conf.get("spark.sql.shuffle.partitions")), size * 2 // (LENGTH - GRAM + 2) // ANCHORS)
    found = single.mapInArrow(_anchor_rows(LENGTH, GRAM, parts), "part int, done boolean, rows binary")
    shared = found.repartitionById(parts, F.col("part")).mapInArrow(_shared(SPLIT), "tid long, kind int, g long, span long")
    by_text = shared.groupBy("tid").agg(F.collect_list(F.struct("kind", "g", "span")).alias("anchors"))
    contexts = single.join(by_text, "tid").select("doc_id", "tid", "text", "anchors").mapInArrow(_contexts(LENGTH), "g long, context binary, m long, tid long, lo long, hi long")
    covers = contexts.repartition("g").sortWithinPartitions("g", "context", "m").mapInArrow(_covers(LENGTH), "tid long, lo long, hi long")
    spans = covers.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return marked.join(spans, "tid", "left").select("doc_id", "text", "first", "spans").mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

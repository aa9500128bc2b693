"""Copies of images, cropped or edited, by local descriptors and geometric consensus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, ready, table
from .components import components
from .simhash import group_starts, whole_groups

SCALES = (1.0, 0.7071, 0.5)
#: Radius of a descriptor's patch; corners that are described at a time; pixels of pictures that are described together.
RADIUS, CHUNK, PIXELS = 7, 4096, 1 << 20
#: Bits of a descriptor; 64-bit parts, a table for each; matches in agreement that make a copy.
BITS, TABLES, AGREE = 256, 4, 5
#: Corners of a bucket that are all paired at once; of a block of a larger one, and of a block of its largest copy group; pictures that hot parts are looked for in, and the share of them that makes a part hot.
SMALL, BUCKET, GROUP, LOOKED, HOT = 16, 256, 4096, 4096, 0.01
#: Rows that a task gathers before it looks at whole buckets.
GATHERED = 1 << 15
_RNG = np.random.default_rng(41)
TESTS = np.clip(np.round(_RNG.normal(0, RADIUS / 2.2, (BITS, 4))), -RADIUS + 1, RADIUS - 1)
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = (_X**2 + _Y**2 <= RADIUS**2).astype(np.float32)
#: Where a corner is; with its descriptor; and as a row of a table.
PLACE = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "u1"), ("turn", "u1")])
CORNER = np.dtype([("bits", "<u8", TABLES), ("place", PLACE)])
ROW = np.dtype([("g", "<i8"), ("image", "<i8"), ("place", PLACE)])
#: Spreads a part and its table over 64 bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
HEAD = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def encode(pixels: np.ndarray) -> bytes:
    """A grey image as binary PGM."""
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """Pixels of a binary PGM of 8 bits, or None."""
    m = HEAD.match(data or b"")
    if not m or int(m[3]) > 255:
        return None
    w, h = int(m[1]), int(m[2])
    body = data[m.end() : m.end() + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w).astype(np.float32) if w * h and len(body) == w * h else None


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, a.shape[0]), (w, a.shape[1])))
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 2 if a.shape[0] > 1 else 0), np.minimum(x.astype(int), a.shape[1] - 2 if a.shape[1] > 1 else 0)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    return ((a[np.ix_(y0, x0)] * (1 - fx) + a[np.ix_(y0, x1)] * fx) * (1 - fy) + (a[np.ix_(y1, x0)] * (1 - fx) + a[np.ix_(y1, x1)] * fx) * fy).astype(np.float32)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means of squares of side 2 r + 1, of each picture of a stack."""
    c = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)), "edge").astype(np.float64).cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (c[:, k:, k:] - c[:, :-k, k:] - c[:, k:, :-k] + c[:, :-k, :-k]) / (k * k)


def corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All corners of a stack of pictures, however weak beside others, that have a whole patch: picture, row, column."""
    h, w = a.shape[1:]
    gy, gx = np.gradient(a, axis=(1, 2))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = strength[:, RADIUS : h - RADIUS, RADIUS : w - RADIUS]
    good = inner > 1e-3
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            good &= inner >= strength[:, RADIUS + i : h - RADIUS + i, RADIUS + j : w - RADIUS + j]
    p, y, x = np.nonzero(good)
    return p, y + RADIUS, x + RADIUS


def describe(stack: np.ndarray) -> list[np.ndarray]:
    """Pictures of one size -> the CORNER rows of each; x and y in its own pixels, scale an index of SCALES, turn in 256ths."""
    found, of = [], []
    for k, s in enumerate(SCALES):
        h, w = int(stack.shape[1] * s), int(stack.shape[2] * s)
        if min(h, w) < 2 * RADIUS + 3:
            continue
        a = stack if s == 1 else np.stack([resized(p, h, w) for p in stack])
        pictures, rows, columns = corners(a)
        smooth = _box(a, 1)
        for begin in range(0, len(rows), CHUNK):
            p, y, x = (c[begin : begin + CHUNK, None] for c in (pictures, rows, columns))
            patch = a[p[:, :, None], y[:, :, None] + _Y, x[:, :, None] + _X] * DISC
            angle = np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

            def at(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
                px, py = np.rint(x + cos * dx - sin * dy).astype(int), np.rint(y + sin * dx + cos * dy).astype(int)
                return smooth[p, np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)]

            out = np.zeros(len(p), CORNER)
            out["bits"] = np.packbits(at(TESTS[:, 0], TESTS[:, 1]) < at(TESTS[:, 2], TESTS[:, 3]), axis=1).view("<u8")
            place = out["place"]
            place["x"], place["y"], place["scale"] = (x[:, 0] + 0.5) / s, (y[:, 0] + 0.5) / s, k
            place["turn"] = np.rint(angle / (2 * np.pi) * 256).astype(int) % 256
            found.append(out)
            of.append(p[:, 0])
    if not found:
        return [np.zeros(0, CORNER)] * len(stack)
    rows, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.split(rows[order], np.cumsum(np.bincount(of, minlength=len(stack)))[:-1])


def descriptors(images: DataFrame) -> DataFrame:
    """images (image_id, image) -> (image_id, digest, n, corners), a row for each row: the digest of its bytes (empty for null) and its n CORNER rows as bytes. Pictures of one size in a batch are described together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            found: list[np.ndarray] = [np.zeros(0, CORNER)] * len(data)
            sizes: dict[tuple[int, int], list[int]] = {}
            pixels = [decode(d) for d in data]
            for i, p in enumerate(pixels):
                if p is not None:
                    sizes.setdefault(p.shape, []).append(i)
            for (h, w), own in sizes.items():
                step = max(1, PIXELS // (h * w))
                for lo in range(0, len(own), step):
                    some = own[lo : lo + step]
                    for i, f in zip(some, describe(np.stack([pixels[i] for i in some])), strict=True):
                        found[i] = f
            digests = [b"" if d is None else hashlib.sha256(d).digest() for d in data]
            yield pa.record_batch([b.column(0), pa.array(digests, pa.binary()), pa.array(map(len, found), pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], names=["image_id", "digest", "n", "corners"])

    return images.mapInArrow(run, "image_id long, digest binary, n int, corners binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """A structured array as a column of bytes, a value for each row."""
    width = rows.dtype.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    if len(rows) * width >= 1 << 31:
        raise ValueError("too many corners in one batch")
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """The reverse of _binary."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def parts(found: DataFrame) -> DataFrame:
    """Described images -> (g, image_id, place): a row for each 64-bit part of each corner; g: a hash of table and part, place: a PLACE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images, blobs = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo in range(0, len(blobs), 64):
                own = blobs[lo : lo + 64]
                rows = np.frombuffer(b"".join(own), CORNER)
                image = pa.array(np.repeat(images[lo : lo + 64], [len(x) // CORNER.itemsize for x in own]))
                place = _binary(rows["place"])
                for t in range(TABLES):
                    g = (rows["bits"][:, t] ^ np.uint64(t)) * MIX
                    g ^= g >> np.uint64(32)
                    g = g * MIX + np.uint64(t)
                    yield pa.record_batch([pa.array(g.view(np.int64)), image, place], names=["g", "image_id", "place"])

    return found.select("image_id", "corners").mapInArrow(run, "g long, image_id long, place binary")


def hot_parts(found: DataFrame) -> DataFrame:
    """(g, image_id, place) of the parts that a hundredth or more of about LOOKED images have, with one image's place each.

    They only say where work is done: results don't depend on them. Their number is bounded by what LOOKED images have.
    """
    n = found.count()
    some = found.where(F.pmod(F.xxhash64(F.lit(5), "image_id"), F.lit(max(1, n // LOOKED))) == 0)
    most = max(BUCKET // 4, int(HOT * min(n, LOOKED)))
    counted = parts(some).groupBy("g").agg(F.count_distinct("image_id").alias("n"), F.min(F.struct("image_id", "place")).alias("first"))
    return cut(counted.where(F.col("n") >= most).select("g", "first.image_id", "first.place"))


def _matched(image: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Rows x and y, which have a part in common, as matches (a, b, m) where they are of two images: m holds the place in image a, the smaller, and that in b."""
    good = image[x] != image[y]
    x, y = x[good], y[good]
    x, y = np.where(image[x] < image[y], x, y), np.where(image[x] < image[y], y, x)
    both = np.zeros(len(x), [("a", PLACE), ("b", PLACE)])
    both["a"], both["b"] = place[x], place[y]
    return pa.record_batch([pa.array(image[x]), pa.array(image[y]), _binary(both)], names=["a", "b", "m"])


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, a distance at a time."""
    x = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    end, d = np.repeat(starts + sizes, sizes), 0
    while True:
        d += 1
        more = x + d < end
        x, end = x[more], end[more]
        if not x.size:
            return
        yield x, x + d


def _buckets(batches: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows sorted by g -> whole buckets with None, or a part of a bucket of more than SMALL rows with its first row. No large bucket is held."""
    rest, first = np.zeros(0, ROW), None
    for rows in batches:
        rows = np.concatenate([rest, rows])
        if first is not None:
            n = int(np.searchsorted(rows["g"], first["g"][0], "right"))
            if n:
                yield rows[:n], first
            rows = rows[n:]
        rest = rows
        if not len(rows):
            continue
        last = int(np.searchsorted(rows["g"], rows["g"][-1]))
        if last:
            yield rows[:last], None
        rest, first = rows[last:], None
        if len(rest) > SMALL:
            yield rest, rest[:1]
            rest, first = rest[:0], rest[:1]
    if len(rest):
        yield rest, None


def first_matches(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of parts() -> matches (a, b, m) and, with b null, the corners (a: image, m: place, g) of crowded buckets.

    A bucket of up to SMALL rows gives all its matches. In a larger one each corner is matched with the bucket's first and with the one before it, which links copies of a picture; then later_matches() sees to the rest. A hot part's corners aren't brought together: wherever they are, they are matched with the part's own one.
    """

    def match(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        b = _matched(rows["image"], rows["place"], x, y)
        return pa.record_batch([*b.columns, pa.nulls(b.num_rows, pa.int64())], names=["a", "b", "m", "g"])

    def crowd(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.record_batch([pa.array(rows["image"]), none, _binary(rows["place"]), pa.array(rows["g"])], names=["a", "b", "m", "g"])

    def large(rows: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        yield match(rows, np.arange(1, n), np.arange(n - 1))
        yield match(np.concatenate([rows, first]), np.arange(n), np.full(n, n))
        yield crowd(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hots: list[pa.RecordBatch] = []

        def cold() -> Iterator[np.ndarray]:
            held, n = [], 0
            for b in batches:
                rows = np.zeros(b.num_rows, ROW)
                rows["g"], rows["image"], rows["place"] = b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), PLACE)
                warm = b.column(3).is_valid().to_numpy(zero_copy_only=False)
                if warm.any():
                    own, other = rows[warm], np.zeros(int(warm.sum()), ROW)
                    other["image"] = b.column(3).filter(pa.array(warm)).to_numpy()
                    other["place"] = np.frombuffer(b"".join(b.column(4).filter(pa.array(warm)).to_pylist()), PLACE)
                    hots.extend([match(np.concatenate([own, other]), np.arange(len(own)), np.arange(len(own)) + len(own)), crowd(own)])
                    rows = rows[~warm]
                held.append(rows)
                n += len(rows)
                if n >= GATHERED or hots:
                    yield np.concatenate(held)
                    held, n = [], 0
            if held:
                yield np.concatenate(held)

        for rows, first in _buckets(cold()):
            yield from hots
            hots.clear()
            if first is not None:
                yield from large(rows, first)
                continue
            starts = group_starts(pa.array(rows["g"]))
            sizes = np.diff(np.r_[starts, len(rows)])
            small, more = (sizes > 1) & (sizes <= SMALL), sizes > SMALL
            for x, y in _pairs(starts[small], sizes[small]):
                yield match(rows, x, y)
            if more.any():
                begin, of = np.repeat(starts, sizes), np.flatnonzero(np.repeat(more, sizes))
                later = of[of > begin[of]]
                yield match(rows, later, later - 1)
                later = later[later > begin[later] + 1]
                yield match(rows, later, begin[later])
                yield crowd(rows[of])
        yield from hots

    marked = entries.join(F.broadcast(hot.select("g", F.col("image_id").alias("own"), F.col("place").alias("other"))), "g", "left").select("g", "image_id", "place", "own", "other")
    where = F.when(F.col("own").isNull(), F.col("g")).otherwise(F.xxhash64("g", "image_id"))
    return marked.repartition(where).sortWithinPartitions("g", "image_id").mapInArrow(run, "a long, b long, m binary, g long")


def later_matches(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """Corners of crowded buckets (a, m, g) and the links so far -> the matches (a, b, m) among them whose images aren't in one group yet.

    A bucket whose images are all in one group has none. In another, the corners of its largest group meet all others, and these meet each other, in blocks of bounded size; so the work grows with the others, and only a crowd of unlike images is squared.
    """
    member = components(links)
    rows = crowded.join(member, crowded["a"] == member["node"], "left").select("g", "a", "m", F.coalesce("component", "a").alias("c"))
    sizes = rows.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g")
    sizes = sizes.agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("n > most")
    rows = rows.join(sizes.select("g", "main", F.ceil(F.col("most") / GROUP).alias("mains"), F.ceil((F.col("n") - F.col("most")) / BUCKET).alias("others")), "g")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block = lambda n: F.pmod(F.xxhash64("a", "m"), F.col(n))
    place = lambda key, side: F.struct(key.alias("g"), side.alias("side"))
    b = block("others")
    with_main = F.when(F.col("c") == F.col("main"), F.transform(upto("others"), lambda j: place(F.xxhash64("g", F.lit(0), block("mains"), j), F.lit(-1).cast("long"))))
    with_main = with_main.otherwise(F.transform(upto("mains"), lambda i: place(F.xxhash64("g", F.lit(0), i, b), F.lit(-2).cast("long"))))
    # among the others: side is own block, doubled, plus 1 where it meets itself
    among = F.when(F.col("c") != F.col("main"), F.transform(upto("others"), lambda j: place(F.xxhash64("g", F.lit(1), F.least(b, j), F.greatest(b, j)), 2 * b + (b == j).cast("long"))))
    dealt = rows.select(F.explode(F.concat(with_main, F.coalesce(among, F.array().cast("array<struct<g:bigint,side:bigint>>")))).alias("p"), "a", "c", "m").select("p.g", "a", "c", "p.side", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            if not b.num_rows:
                continue
            image, c, side = (b.column(i).to_numpy() for i in (1, 2, 3))
            at = np.frombuffer(b"".join(b.column(4).to_pylist()), PLACE)
            starts = group_starts(b.column(0))
            sizes = np.diff(np.r_[starts, b.num_rows])
            mixed = side[starts] < 0
            for s, n in zip(starts[mixed].tolist(), sizes[mixed].tolist(), strict=True):
                own = np.arange(s, s + n)
                main = own[side[s : s + n] == -1]
                for other in own[side[s : s + n] == -2].tolist():
                    yield _matched(image, at, main, np.full(len(main), other))
            for x, y in _pairs(starts[~mixed], sizes[~mixed]):
                good = (c[x] != c[y]) & ((side[x] >> 1 != side[y] >> 1) | (side[x] & 1 == 1))
                yield _matched(image, at, x[good], y[good])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long, m binary")


def agrees(m: np.ndarray) -> bool:
    """m: a match in each row: x, y, scale, angle of either corner. Whether AGREE corners of both sides or more have one turn, one scale and one shift, within a bin's width. Bins overlap by half, so a border parts none."""
    ax, ay, az, aw, bx, by, bz, bw = m.T
    n, o = (np.unique(m[:, i : i + 4], axis=0, return_inverse=True)[1].ravel() for i in (0, 4))
    if min(n.max(), o.max()) + 1 < AGREE:
        return False
    turn, ratio = (bw - aw) % (2 * np.pi), az / bz
    x = bx - ratio * (np.cos(turn) * ax - np.sin(turn) * ay)
    y = by - ratio * (np.sin(turn) * ax + np.cos(turn) * ay)
    r = np.rint(2 * np.log2(ratio))
    for k in range(8):
        half = [0.5 * (k >> i & 1) for i in range(3)]
        bins = np.stack([r, np.floor(turn / (np.pi / 6) + half[0]) % 12, np.floor(x / 12 + half[1]), np.floor(y / 12 + half[2])], axis=1)
        _, of, size = np.unique(bins, axis=0, return_inverse=True, return_counts=True)
        for g in np.flatnonzero(size >= AGREE):
            if min(len(np.unique(n[of.ravel() == g])), len(np.unique(o[of.ravel() == g]))) >= AGREE:
                return True
    return False


def places(data: list[bytes]) -> np.ndarray:
    """Matches' bytes as x, y, scale, angle of either corner."""
    both = np.frombuffer(b"".join(data), [("a", PLACE), ("b", PLACE)])
    scales = np.array(SCALES)
    columns = [[c["x"], c["y"], scales[c["scale"]], c["turn"] * (2 * np.pi / 256)] for c in (both["a"], both["b"])]
    return np.stack([x.astype(np.float64) for side in columns for x in side], axis=1)


def agreeing(matches: DataFrame) -> DataFrame:
    """Matches (a, b, m) -> links (a, b): images whose matches agree."""
    lists = matches.groupBy("a", "b").agg(F.collect_set("m").alias("m")).where(F.size("m") >= AGREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [agrees(places(m)) for m in b.column(2).to_pylist()]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return lists.mapInArrow(run, "a long, b long")


def image_copies(images: DataFrame) -> DataFrame:
    """images (image_id, image: binary PGM) -> image_id, component_id, n_corners, a row for each row.

    Two images are linked where AGREE corners match (a 64-bit part of the descriptors in common) under one turn, scale and shift; component_id is the smallest id reachable by links. Equal bytes are one image, of the smallest id (null and undecodable ones have no links, but equal ones go together). Null ids take no part but keep a row, with null component. Of rows with one id and different bytes, those with the smallest digest are described; the others have no links. An empty table gives no rows; other columns aren't read. An image must fit a worker, with some 100 bytes for each pixel.
    """
    ready(images.sparkSession)
    rows = cut(descriptors(images.select(F.col("image_id").cast("long").alias("image_id"), "image")))
    firsts = cut(rows.groupBy("digest").agg(F.min("image_id").alias("first")))
    described = firsts.where("first is not null").groupBy(F.col("first").alias("image_id")).agg(F.min("digest").alias("digest"))
    found = rows.join(described, ["image_id", "digest"], "left_semi").select("image_id", "n", "corners")
    if rows.groupBy("image_id", "digest").count().where("count > 1 and image_id is not null").limit(1).count():
        found = found.dropDuplicates(["image_id"])
    found = cut(found)
    told = cut(first_matches(parts(found), hot_parts(found)))
    matches, crowded = told.where("b is not null").select("a", "b", "m"), told.where("b is null").select("a", "m", "g")
    links = cut(agreeing(matches))
    if crowded.limit(1).count():
        links = cut(agreeing(matches.unionByName(later_matches(crowded, links))))
    member = components(links)
    corners = found.select(F.col("image_id").alias("node"), F.col("n").cast("long").alias("n_corners"))
    known = firsts.withColumnRenamed("first", "node").join(member, "node", "left").join(corners, "node", "left")
    known = cut(known.select("digest", F.coalesce("component", "node").alias("component_id"), F.coalesce("n_corners", F.lit(0).cast("long")).alias("n_corners")))
    out = rows.select("image_id", "digest").join(known, "digest")
    return out.select("image_id", F.when(F.col("image_id").isNotNull(), F.col("component_id")).alias("component_id"), "n_corners")


SIDE = 56


def drawn(vectors: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding) -> (image_id, image): each vector as a grey picture, products of its components the knots of a smooth square. Vectors that are null, empty or hold what isn't finite have no picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                a = np.array([np.nan if x is None else x for x in v or []], np.float64)
                if not len(a) or not np.isfinite(a).all():
                    out.append(None)
                    continue
                y, x = np.mgrid[: SIDE // 2, : SIDE // 2]
                a = a[2 * y % len(a)] * a[(5 * x + 3 * y + 1) % len(a)]
                a = (a - a.min()) / max(1e-9, a.max() - a.min()) * 255
                out.append(encode(np.rint(resized(a.astype(np.float32), SIDE, SIDE))))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["image_id", "image"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "image_id long, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images, so the embeddings are drawn."""
    return image_copies(drawn(table(spark, sf_dir, "embeddings")))

"""SimHash near-duplicates, linked by BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, held, ready, spread, table
from .components import components
from .forest import links

RADIUS = 2
#: A shard of more fingerprints than this is dealt again by further bits.
SHARD = 1024


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of the text in lower case (A-Z only), in order, repeats included; of the whole where words are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-n] + 1]
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp long): a row for each row; a null or wordless text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t or b"", shingle)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    ready(docs.sparkSession)
    return spread(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keys(value, width: int, parts: int, free: int, tag):
    """Keys of a value of `width` bits in `parts` equal blocks: values that differ in at most `free` bits are equal in all but `free` blocks, and share a key."""
    size = width // parts
    block = lambda i: F.shiftrightunsigned(value, i * size).bitwiseAND(F.lit((1 << size) - 1))
    return F.array(*[F.xxhash64(tag, F.lit(k), *map(block, kept)) for k, kept in enumerate(combinations(range(parts), parts - free))])


def group_starts(keys: pa.Array) -> np.ndarray:
    g = keys.to_numpy()
    return np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by a number in the first column, dealt anew so that no group is parted; groups of one row are left out."""

    def several(b: pa.RecordBatch) -> pa.RecordBatch:
        starts = group_starts(b.column(0))
        sizes = np.diff(np.r_[starts, b.num_rows])
        return b.filter(pa.array(np.repeat(sizes > 1, sizes)))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        starts = group_starts(b.column(0))
        if held and held[-1].column(0)[-1].as_py() != b.column(0)[0].as_py():
            yield several(pa.concat_batches(held))
            held = []
        if len(starts) > 1:
            yield several(pa.concat_batches([*held, b.slice(0, starts[-1])]))
            held = []
        held.append(b.slice(starts[-1]))
    if held:
        yield several(pa.concat_batches(held))


def fingerprint_edges(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Distinct fingerprints (fp long) -> edges (a, b) that span all links of at most `radius` differing bits.

    Fingerprints within the radius agree on all but `radius` of radius + 2 blocks, so each fingerprint goes to a shard for each choice of the other blocks; a shard has a BK-tree. Shards beyond `shard` rows are dealt again by blocks of all 64 bits, twice as fine; what then still is together agrees on so many bits that few distinct fingerprints remain. A shard gives a spanning forest of its links, not its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            starts, fp = group_starts(b.column(0)), b.column(1).to_numpy()
            a, to = links(fp.view(np.uint64)[:, None], starts, radius)
            yield pa.record_batch([pa.array(fp[a]), pa.array(fp[to])], names=["a", "b"])

    blocks = radius + 2
    parts = 64 // (64 // blocks)
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), 64, parts, radius, F.lit(0))).alias("g"))
    large = keyed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    again = keyed.join(large, "g", "left").select("fp", F.explode(F.when(F.col("n").isNull(), F.array("g")).otherwise(_keys(F.col("fp"), 64, 2 * parts, radius, F.col("g")))).alias("g"))
    return again.select("g", "fp").repartition("g").sortWithinPartitions("g", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint string, component_id long), a row for each row.

    Empty, null and wordless texts have fingerprint zero and link like any other; repeated rows are kept; a null doc_id is never a representative unless its whole component has none (component_id is then null). An empty table gives no rows; other columns aren't read.
    """
    own = cut(fingerprints(docs, shingle))
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = cut(components(fingerprint_edges(own.select("fp").distinct(), radius)))
    linked = first.join(member, first.fp == member.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    linked = cut(linked)
    least = linked.groupBy("c").agg(F.min("first").alias("component_id"))
    of = cut(linked.join(least, "c").select("fp", "component_id"))
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For near_copies: min-hashes of a band and bands; the SimHash radius that pairs of similarity 0.8 keep within but for one in a thousand; hashes kept of a set; rows of a block of a large shard; bytes of whole sets in a block of a shard that needs them.
BAND, BANDS, WIDE_RADIUS, SKETCH, BLOCK, BYTES = 4, 12, 20, 192, 2048, 1 << 25
#: Sketches decide a pair only where they are this many deviations off the threshold, or, where they hold whole sets (of 32 bits a hash), this much.
DEVIATIONS, WHOLE_MARGIN = 6, 0.02
_MULTIPLIERS = np.random.default_rng(29).integers(0, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(distinct: np.ndarray) -> list[int]:
    """A key of each band: equal for two sets with the chance of their similarity to the power of BAND."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 4096):
        mixed = distinct[at : at + 4096, None] * _MULTIPLIERS
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    return [xxhash.xxh3_64_intdigest(k.tobytes(), i) - (1 << 63) for i, k in enumerate(least.reshape(BANDS, BAND))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets from their SKETCH smallest hashes: exact for sets no larger."""
    both = np.union1d(a, b)[:SKETCH]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def whole_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def verdict(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """What two sketches say of a pair: 1 a link, -1 none, 0 too near the threshold to tell."""
    margin = WHOLE_MARGIN if max(len(a), len(b)) < SKETCH else DEVIATIONS * (least * (1 - least) / SKETCH) ** 0.5
    off = similarity(a, b) - least
    return 0 if abs(off) <= margin else 1 if off > 0 else -1


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, component_id), a row for each distinct doc_id that isn't null: documents whose sets of `shingle`-word shingles have a Jaccard similarity of `least` or more are linked; component_id is the smallest doc_id reachable.

    Equal sets (so all wordless texts, too) are one group at once. For the others, min-hash bands deal documents into shards, where all with a band in common meet (a pair of similarity 0.8 does with probability 0.998, one of 0.9 always but for 3 in 10^6); in a shard, a BK-tree over SimHash fingerprints of the sets finds those within WIDE_RADIUS bits, and sketches decide pairs well off the threshold. Documents of other pairs that are then still apart meet again in the shard with their whole sets, which decide. A shard of more than BLOCK rows is dealt into pairs of blocks, so it loses no pair. Of rows that share a doc_id the one with the smallest set digest counts.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                distinct = np.unique(shingle_hashes(t or b"", shingle))
                out.append((i, xxhash.xxh3_128_hexdigest(distinct.tobytes()), fingerprint(distinct) - (1 << 63), np.unique((distinct >> np.uint64(32)).astype(np.uint32))[:SKETCH].tobytes(), _bands(distinct)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "same", "fp", "sketch", "bands"])

    own = spread(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, same string, fp long, sketch binary, bands array<long>")
    own = cut(own)
    single = own.select("doc_id", "same").groupBy("doc_id").agg(F.min("same").alias("same"))
    firsts = cut(single.groupBy("same").agg(F.min("doc_id").alias("first")))
    reps = firsts.withColumnRenamed("first", "doc_id")
    chosen = own.join(reps, ["doc_id", "same"], "left_semi")
    banded = chosen.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("doc_id"), parts)
    keys = F.when(parts == 1, F.array("band")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.xxhash64("band", F.least(block, j), F.greatest(block, j))))
    met = banded.join(shared, "band").select(F.explode(keys).alias("g"), "doc_id")
    dealt = met.join(own.join(reps, ["doc_id", "same"], "left_semi").select("doc_id", "fp", "sketch"), "doc_id")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            g, ids, fp, sketches = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            sketch = lambda i: np.frombuffer(sketches[int(i)].as_py(), np.uint32)
            open_a, open_b = [], []

            def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                said = np.fromiter((verdict(sketch(i), sketch(j), least) for i, j in zip(x, y, strict=True)), np.int8, len(x))
                open_a.append(x[said == 0])
                open_b.append(y[said == 0])
                return said > 0

            a, to = links(fp.view(np.uint64)[:, None], group_starts(b.column(0)), WIDE_RADIUS, accept)
            top = np.arange(len(ids))
            top[a] = to
            x, y = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (open_a, open_b))
            apart = top[x] != top[y]
            unsure = np.unique(np.r_[x[apart], y[apart]])
            n = len(unsure)
            yield pa.record_batch([pa.array(np.r_[ids[a], ids[unsure]]), pa.array([*ids[to].tolist(), *[None] * n], pa.int64()), pa.array([*[None] * len(a), *g[unsure].tolist()], pa.int64())], names=["a", "b", "g"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t or b"", shingle)).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            own_set = [xxhash.xxh3_128_hexdigest(w) == same for w, same in zip(found, b.column(2).to_pylist(), strict=True)]
            out = pa.record_batch([b.column(0), b.column(3), pa.array(found, pa.binary())], names=["doc_id", "fp", "whole"])
            yield out.filter(pa.array(own_set, pa.bool_()))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            ids, fp, of, wholes = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4)
            whole = lambda i: np.frombuffer(wholes[int(i)].as_py(), np.uint64)

            def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.fromiter((of[i] == of[j] or whole_similarity(whole(i), whole(j)) >= least for i, j in zip(x, y, strict=True)), bool, len(x))

            a, to = links(fp.view(np.uint64)[:, None], group_starts(b.column(0)), WIDE_RADIUS, accept)
            yield pa.record_batch([pa.array(ids[a]), pa.array(ids[to])], names=["a", "b"])

    def decided(edges: DataFrame, unsure: DataFrame) -> DataFrame | None:
        """Links among documents of unsure (g, doc_id) that edges leave apart, told by whole sets; None if there are no such documents."""
        member = components(edges)
        rows = unsure.join(member, unsure["doc_id"] == member["node"], "left").select("g", "doc_id", F.coalesce("component", "doc_id").alias("of"))
        several = rows.groupBy("g").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x != y").select("g")
        rows = cut(rows.join(several, "g", "left_semi"))
        if rows.isEmpty():
            return None
        known = own.select("doc_id", "same", "fp").join(reps, ["doc_id", "same"], "left_semi").join(rows, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        wholes = spread(docs, "doc_id", "text").join(known, "doc_id").select("doc_id", "text", "same", "fp").mapInArrow(sets, "doc_id long, fp long, whole binary")
        if own.groupBy("doc_id", "same").count().where("count > 1").limit(1).count():
            wholes = wholes.dropDuplicates(["doc_id"])
        wholes = cut(wholes)
        parts = rows.join(wholes.select("doc_id", F.octet_length("whole").alias("size")), "doc_id").groupBy("g").agg(F.ceil(F.sum("size") / BYTES).alias("n"))
        block = F.pmod(F.xxhash64("doc_id"), F.col("n"))
        keys = F.when(F.col("n") <= 1, F.array("g")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.xxhash64("g", F.least(block, j), F.greatest(block, j))))
        again = rows.join(parts, "g").select(F.explode(keys).alias("g"), "doc_id", "of").join(wholes, "doc_id")
        return cut(again.select("g", "doc_id", "fp", "of", "whole").repartition("g").sortWithinPartitions("g", "doc_id").mapInArrow(exactly, "a long, b long"))

    told = cut(dealt.select("g", "doc_id", "fp", "sketch").repartition("g").sortWithinPartitions("g", "doc_id").mapInArrow(within, "a long, b long, g long"))
    edges = told.where("b is not null").select("a", "b")
    unsure = told.where("b is null").select("g", F.col("a").alias("doc_id"))
    more = decided(edges, unsure)
    if more is not None:
        edges = edges.unionByName(more)
    linked = components(edges)
    of = cut(firsts.join(linked, firsts["first"] == linked["node"], "left").select("same", F.coalesce("component", "first").alias("component_id")))
    return single.join(of, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near_copies() group, one for each doc_id; rows without a doc_id stay."""
    kept = cut(near_copies(docs, shingle, least).where("doc_id = component_id").select("doc_id"))
    rows = docs.join(kept, "doc_id", "left_semi")
    if docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id"])
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

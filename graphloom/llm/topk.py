"""Exact top-k inner products by Fagin's threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import ready, table

K, EVERY = 5, 50
#: Rows of a block of candidates or queries, and its bytes; candidate blocks that one task goes through; bands of norms.
BLOCK, BLOCK_BYTES, STRIPE, BANDS = 8192, 1 << 25, 16, 64


class Lists:
    """A block of vectors with its rows sorted along every dimension; `scored` counts the rows that were scored in full."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.m = ids[by_id], m[by_id]
        self.order = np.argsort(self.m, axis=0, kind="stable").T.copy()
        self.least, self.most = self.m.min(axis=0, initial=0), self.m.max(axis=0, initial=0)
        self.norm = float(np.sqrt((self.m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        self.scored = 0

    def top(self, q: np.ndarray, own: int, k: int, ids: np.ndarray | None = None, score: np.ndarray | None = None, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than `own` and of those that earlier blocks gave, best first, ties to the smaller id.

        Sorted access goes down all lists of non-zero weight together, from the large end where the weight is positive; each row met is scored in full. No row that is yet unmet can beat the bound, the query's product with the values that the lists have come to, nor the product of the norms; so it stops once the kth score is above either. With a kth score from earlier blocks that may be at once.
        """
        n, dims = len(self.ids), np.flatnonzero(q)
        ids = np.zeros(0, np.int64) if ids is None else ids
        score = np.zeros(0, self.m.dtype) if score is None else score
        weight, up = q[dims], q[dims] > 0
        reach = np.sqrt((q.astype(np.float64) ** 2).sum()) * self.norm * (1 + 1e-9) + 1
        bound = min(reach, weight @ np.where(up, self.most[dims], self.least[dims]))
        met, at, left = np.zeros(n, bool), 0, n
        while left and not (len(ids) == k and score[-1] > bound):
            to = min(n, at + depth) if len(dims) else n
            new = ~met
            if len(dims):
                rows = np.where(up[:, None], self.order[dims, n - to : n - at][:, ::-1], self.order[dims, at:to])
                seen = np.zeros(n, bool)
                seen[rows.ravel()] = True
                new &= seen
                bound = min(reach, weight @ self.m[rows[:, -1], dims])
            met |= new
            new = np.flatnonzero(new)
            left -= len(new)
            self.scored += len(new)
            new = new[self.ids[new] != own]
            ids, score = np.r_[ids, self.ids[new]], np.r_[score, self.m[new] @ q]
            keep = np.lexsort((ids, -score))[:k]
            ids, score = ids[keep], score[keep]
            at, depth = to, depth * 2
        return ids, score


def quantised(column: str) -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * 256))


def _packed(df: DataFrame, by: str) -> DataFrame:
    """One row (by, rows) for each group; groups are of bounded size."""
    return df.groupBy(by).agg(F.collect_list(F.struct("id", "v")).alias("rows"))


def _matrix(rows: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, v = rows.field("id").to_numpy(), rows.field("v")
    lens, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
    out = np.zeros((len(ids), width), np.int64)
    out[np.arange(width) < lens[:, None]] = flat
    return ids, out


def _answers(k: int, width: int, exact: bool):
    """Rows (stripe, c, rows), by stripe and c, a stripe's queries (c: -1) before its candidate blocks -> (query_id, vec_id, score). exact: sums of products are exact in doubles."""
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[list] = []  # [id, vector, the best rows' ids, their scores]

        def found() -> pa.RecordBatch:
            out = [(np.full(len(ids), own), ids, score.astype(np.int64)) for own, _, ids, score in asked if ids is not None]
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
            return pa.record_batch([pa.array(x) for x in columns], names=names)

        for b in batches:
            for i in range(b.num_rows):
                ids, m = _matrix(b.column(2)[i].values, width)
                m = m.astype(np.float64) if exact else m
                if b.column(1)[i].as_py() < 0:
                    yield found()
                    asked = [[own, v, None, None] for own, v in zip(ids.tolist(), m, strict=True)]
                    continue
                lists = Lists(ids, m)
                for x in asked:
                    x[2], x[3] = lists.top(x[1], x[0], k, x[2], x[3])
        yield found()

    return run


def top_k(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = K) -> DataFrame:
    """vectors -> (query_id, rank from 1, vec_id, score): for each row that `is_query` picks, its k highest integer inner products with every other row.

    Components count as floor(256 x). Rows whose vector is null or holds a null or non-finite component, or whose id is null, take no part; vectors of unequal length are filled up with zeros, and an empty vector scores 0 with all. Rows with the query's own id are no candidates; repeated rows are candidates each, and of queries with one id the least vector asks. Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty table none. Components so large that products could leave 64 bits raise.

    Candidates are dealt into blocks of like norms and bounded size, blocks into stripes, great norms first. A stripe meets one block of queries, which take their kth scores from each of its blocks to the next; each runs the threshold algorithm over the block's sorted lists. A row is sent once for each block of queries, not for each query.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), quantised(vector_column).alias("v"), is_query.alias("q"), F.col(vector_column).alias("raw"))
    fine = F.coalesce(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.where(F.col("id").isNotNull() & fine).drop("raw").withColumn("norm", norm)
    cuts = F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 1000)
    widest = F.coalesce(F.max(F.size("v")), F.lit(0))
    n, nq, width, most, at = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), widest, F.coalesce(F.max("norm"), F.lit(0.0)), cuts).first()
    if most >= 2.0**62:
        raise ValueError("components are too large: products would leave 64 bits")
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, width))) * 2 // 3)
    band = F.lit(0)
    for x in sorted(set(at or [])):
        band = band + F.when(F.col("norm") <= x, 1).otherwise(0)
    banded = rows.withColumn("band", band)
    first, blocks = {}, 0
    for r in sorted(banded.groupBy("band").count().collect()):
        first[r["band"]] = (blocks, -(-r["count"] // block))
        blocks += first[r["band"]][1]
    qblocks = max(1, -(-nq // block))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, -(-blocks // max(1, min(STRIPE, blocks * qblocks // wanted))))
    c = F.lit(0).cast("long")
    for i, (at_, many) in first.items():
        c = F.when(F.col("band") == i, at_ + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(many))).otherwise(c)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    cand = _packed(banded.select("id", "v", c.alias("c")), "c").select("c", F.pmod("c", F.lit(stripes)).alias("s"), every(qblocks).alias("qb"), "rows")
    asked = _packed(rows.where("q").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(qblocks)).alias("qb")), "qb")
    asked = asked.select(F.lit(-1).cast("long").alias("c"), every(stripes).alias("s"), "qb", "rows")
    dealt = asked.unionByName(cand).select((F.col("qb") * stripes + F.col("s")).alias("stripe"), "c", "rows")
    parts = min(stripes * qblocks, 100_000)
    dealt = dealt.repartitionById(parts, F.pmod("stripe", F.lit(parts)).cast("int")).sortWithinPartitions("stripe", "c")
    hits = dealt.mapInArrow(_answers(k, width, most < 2.0**52), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % EVERY == 0)


SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= {K}
"""

"""Mixing sources by temperature, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, table

#: The exponent is found on a grid of 1/GRID; each pass over the sources' totals halves its interval so many times.
GRID, HALVINGS = 1 << 16, 4
SEED = "mix"
#: A plan of so many sources at most is broadcast (some MB); a longer one is joined by a shuffle.
FEW_SOURCES = 50_000


#: What mix() adds.
ADDED = ("__tokens", "__weight", "__epoch", "__block", "__start")


def tokens(column: str = "text") -> Column:
    """Runs without white space; none where the text is null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def unit(*parts: str | Column) -> Column:
    """A number in [0, 2^32) from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def exponent(totals: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> float:
    """totals (t: tokens of each source, over 0) -> the largest exponent up to 1 that meets the target entropy (nats), or the smallest that keeps to the repetition limit; where both are given, the limit goes first.

    Entropy falls and evenness of repetition rises with the exponent. budget None: the tokens that give each source one whole pass at least. Each pass evaluates the inner points of the interval in one aggregation.
    """
    total, n = totals.agg(F.sum("t").cast("double"), F.count("*")).first()
    if not total:
        return 1.0
    p = F.col("t") / F.lit(total)

    def holds(points: list[int]) -> list[tuple[bool, bool]]:
        sums = []
        for k, g in enumerate(points):
            w = F.pow(p, F.lit(g / GRID))
            sums += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log(p)).alias(f"s{k}"), F.max(w / F.col("t")).alias(f"a{k}"), F.min(w / F.col("t")).alias(f"b{k}")]
        r = totals.agg(*sums).first()
        out = []
        for k, g in enumerate(points):
            z, s, a, b = (r[f"{x}{k}"] for x in "zsab")
            entropy, repeated = math.log(z) - g / GRID * s / z, a / b if budget is None else a / z * budget
            out.append((target_entropy is None or entropy >= target_entropy, max_repetition is None or repeated <= max_repetition))
        return out

    def bisect(which: int, rising: bool) -> int:
        """The smallest grid point where a test that rises holds, or the largest where one that falls does; the far end if none."""
        first, last = (x[which] for x in holds([0, GRID]))
        if rising and first or not rising and not first:
            return 0
        if last != rising:  # it never holds, or holds to the end
            return GRID
        lo, hi = 0, GRID
        while hi - lo > 1:
            step = max(1, (hi - lo) >> HALVINGS)
            points = list(range(lo + step, hi, step))
            good = [x[which] for x in holds(points)]
            edge = next((i for i, g in enumerate(good) if g == rising), len(points))
            lo, hi = [lo, *points][edge], [*points, hi][edge]
        return hi if rising else lo

    if max_repetition is not None:
        least = bisect(1, True)
        most = bisect(0, False) if target_entropy is not None else 0
        return max(least, most) / GRID
    return bisect(0, False) / GRID if target_entropy is not None else 1.0


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """docs -> their rows as often as the mixture takes them, with __tokens, __weight, __epoch, __block, __start beside the columns.

    A source's weight is its share of tokens to the power of an exponent, normalised; see exponent(). Its quota is weight x budget: whole passes over the source, then the start of another. Each pass is a permutation of its own: rows are dealt by hash to about sqrt(rows) blocks, blocks and rows within a block are ordered by hash, and __start is the tokens before a row in the pass; the last pass takes rows that start within what is left. So no source is one group, however large.

    budget None: as many tokens as give every source one whole pass at least, so no row is lost. A null source is a source. Rows without tokens take no budget: they come in every pass of their source, or once where the source has no tokens (weight 0). Rows without a doc_id are told apart by their text's md5. Ties of the order go by doc_id and tokens; repeated rows are rows. Columns of docs with the names that are added are replaced; others may have any name but ones that begin with __mix_. An empty table gives no rows.
    """
    rows = docs.drop(*ADDED).withColumn("__tokens", tokens(text)).withColumn("__mix_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")))
    totals = cut(rows.groupBy("__mix_source").agg(F.sum("__tokens").alias("t"), F.count("*").alias("n")))
    some = totals.where("t > 0")
    alpha = exponent(some, target_entropy, max_repetition, budget)
    total = float(some.agg(F.sum("t")).first()[0] or 1)
    power = F.pow(F.col("t") / F.lit(total), F.lit(alpha))
    z, low = some.agg(F.sum(power), F.min(power / F.col("t"))).first()
    spend = float(budget) if budget is not None else (z or 1.0) / (low or 1.0)
    weight = F.when(F.col("t") > 0, power / F.lit(z or 1.0)).otherwise(0.0)
    plan = totals.withColumn("__weight", weight)
    plan = cut(
        plan.select(
            "__mix_source",
            "__weight",
            F.col("t").alias("__mix_total"),
            F.round(F.col("__weight") * F.lit(spend)).cast("long").alias("__mix_quota"),
            F.ceil(F.sqrt("n")).cast("long").alias("__mix_blocks"),
        )
    )
    if plan.count() <= FEW_SOURCES:
        plan = F.broadcast(plan)
    t, quota, epoch = F.col("__mix_total"), F.col("__mix_quota"), F.col("__epoch")
    passes = F.when(t > 0, F.ceil(quota / t)).otherwise(1).cast("long")
    rows = rows.join(plan, "__mix_source").withColumn("__epoch", F.explode(F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1))))
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    ident = [F.lit(seed), name, epoch.cast("string")]
    rows = rows.withColumn("__block", unit(F.lit("block"), *ident) % F.col("__mix_blocks")).withColumn("__mix_h", unit(F.lit("row"), *ident))
    key = ["__mix_source", "__epoch", "__block"]
    inner = W.partitionBy(*key).orderBy("__mix_h", F.col(doc_id), "__tokens")
    placed = rows.withColumn("__mix_within", F.sum("__tokens").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("__tokens"))
    blocks = rows.groupBy(*key).agg(F.sum("__tokens").alias("__mix_size"))
    drawn = unit(F.lit("order"), F.lit(seed), "__mix_source", epoch.cast("string"), F.col("__block").cast("string"))
    order = W.partitionBy("__mix_source", "__epoch").orderBy(drawn, "__block")
    before = F.sum("__mix_size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("__mix_size")
    placed = placed.join(blocks.withColumn("__mix_before", before).drop("__mix_size"), key).withColumn("__start", F.col("__mix_within") + F.col("__mix_before"))
    left = quota - epoch * t
    taken = placed.where((F.col("__start") < left) | (F.col("__tokens") == 0) & (left > 0) | (t == 0))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


#: The query's limit: no source is taken more often than so many times; each is taken once at least.
REPETITION = 4.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as often as the flattest mixture under the repetition limit takes it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, max_repetition=REPETITION)
    return mixed.select("doc_id", "source", F.col("__tokens").alias("tokens"), F.round("__weight", 9).alias("weight"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__start").alias("start"))


_UNIT = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::ubigint::bigint"
SQL = f"""
with d as materialized (select doc_id, coalesce(doc_id::varchar, '~' || md5(coalesce(text, ''))) as name, source, coalesce('=' || source, '-') as src, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as tokens from documents),
s as materialized (select src, sum(tokens)::bigint as t, count(*) as n from d group by src),
total as (select sum(t)::double as total from s where t > 0),
alpha as (select min(g) / {GRID}.0::double as alpha from (select g, max(pow(t / total, g / {GRID}.0::double) / t) / min(pow(t / total, g / {GRID}.0::double) / t) as repeated from s, total, (select unnest(range({GRID} + 1)) as g) where t > 0 group by g) where repeated <= {REPETITION} or g = {GRID}),
w as materialized (select src, t, n, case when t > 0 then pow(t / total, alpha) / (select sum(pow(t / total, alpha)) from s, total, alpha where t > 0) else 0 end as weight, (select sum(pow(t / total, alpha)) / min(pow(t / total, alpha) / t) from s, total, alpha where t > 0) as spend from s, total, alpha),
plan as materialized (select src, t, weight, round(weight * spend)::bigint as quota, ceil(sqrt(n))::bigint as blocks, case when t > 0 then ceil(round(weight * spend)::bigint / t)::bigint else 1 end as passes from w),
e as (select d.*, p.t, p.weight, p.quota, p.blocks, unnest(range(p.passes)) as epoch from d join plan p using (src)),
b as materialized (select *, {_UNIT.format(f"'block', '{SEED}', name, epoch")} % blocks as block, {_UNIT.format(f"'row', '{SEED}', name, epoch")} as h from e),
inside as (select *, sum(tokens) over (partition by src, epoch, block order by h, doc_id, tokens rows unbounded preceding) - tokens as within from b),
sizes as (select src, epoch, block, sum(tokens) as size, {_UNIT.format(f"'order', '{SEED}', src, epoch, block")} as o from b group by src, epoch, block),
starts as (select src, epoch, block, sum(size) over (partition by src, epoch order by o, block rows unbounded preceding) - size as before from sizes)
select doc_id, source, tokens, round(weight, 9) as weight, epoch, block, (within + before)::bigint as start
from inside join starts using (src, epoch, block) where within + before < quota - epoch * t or (tokens = 0 and quota - epoch * t > 0) or t = 0
"""

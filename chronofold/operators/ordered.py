"""Neighbours and running sums in one global order, without passing all rows through one task.

Rows are dealt into at most ``BUCKETS`` spans of an integer key, cut at its approximate quantiles so that a skewed key fills them alike; a table of that many rows carries what one
bucket needs of the others, and a window runs inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.cuts import cut

BUCKETS, STEP = 512, 23


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    df = cut(df, "ordered")  # the quantiles, the sums of buckets and the rows themselves each read it
    cuts = df.agg(F.percentile_approx(F.col(key).cast("bigint"), F.lit([k / BUCKETS for k in range(1, BUCKETS)]), F.lit(20 * BUCKETS)).alias("q")).first()["q"]
    return df.withColumn("_bucket", _place(F.col(key), sorted(set(cuts or []))))


def _place(key: Column, cuts: list[int]) -> Column:
    """How many cuts are below the key: first by every ``STEP``-th of them, then within that step."""
    if not cuts:
        return F.lit(0)
    steps = [cuts[k : k + STEP] for k in range(0, len(cuts), STEP)]
    below = lambda numbers: F.size(F.filter(numbers, lambda c: c < key))
    whole = below(F.lit([s[-1] for s in steps]).cast("array<bigint>"))
    rest = F.get(F.lit([*steps, []]).cast("array<array<bigint>>"), whole)
    return F.when(whole == len(steps), len(cuts)).otherwise(whole * STEP + below(rest))


def with_next(df: DataFrame, key: str, out: str = "next") -> DataFrame:
    """Adds the next larger value of ``key``, which must be distinct; null for the last."""
    at = _bucketed(df, key)
    first = at.groupBy("_bucket").agg(F.min(key).alias("_first"))
    after = first.select("_bucket", F.lead("_first").over(Window.orderBy("_bucket")).alias("_after"))  # at most BUCKETS rows
    inside = F.lead(key).over(Window.partitionBy("_bucket").orderBy(key))
    return at.join(F.broadcast(after), "_bucket").withColumn(out, F.coalesce(inside, "_after")).drop("_bucket", "_after")


def with_following(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds ``value`` of the row after in the order of ``key`` (distinct); null for the last."""
    at = _bucketed(df, key)
    first = at.groupBy("_bucket").agg(F.min(F.struct(key, value)).alias("_first"))
    after = first.select("_bucket", F.lead(F.col("_first")[value]).over(Window.orderBy("_bucket")).alias("_after"))  # at most BUCKETS rows
    inside = F.lead(F.struct(value)).over(Window.partitionBy("_bucket").orderBy(key))
    return at.join(F.broadcast(after), "_bucket").withColumn(out, F.when(inside.isNotNull(), inside[value]).otherwise(F.col("_after"))).drop("_bucket", "_after")


def with_previous(df: DataFrame, key: str, tie: str, value: str, out: str) -> DataFrame:
    """Adds ``value`` of the row before in the order of ``key`` and ``tie`` (distinct together); null for the first."""
    at = _bucketed(df, key)
    last = at.groupBy("_bucket").agg(F.max(F.struct(key, tie, value)).alias("_last"))
    before = last.select("_bucket", F.lag(F.col("_last")[value]).over(Window.orderBy("_bucket")).alias("_before"))  # at most BUCKETS rows
    run = Window.partitionBy("_bucket").orderBy(key, tie)
    return at.join(F.broadcast(before), "_bucket").withColumn(out, F.when(F.row_number().over(run) == 1, F.col("_before")).otherwise(F.lag(value).over(run))).drop("_bucket", "_before")


def with_running(df: DataFrame, key: str, values: dict[str, str], tie: str | None = None) -> DataFrame:
    """Adds, for each column and output name, the sum of the column over rows up to and including ``key`` (distinct, or with ``tie``)."""
    at = _bucketed(df, key)
    sums = at.groupBy("_bucket").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(values)])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    offsets = sums.select("_bucket", *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in range(len(values))])
    run = Window.partitionBy("_bucket").orderBy(key, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    joined = at.join(F.broadcast(offsets), "_bucket")
    for k, (c, out) in enumerate(values.items()):
        joined = joined.withColumn(out, F.col(f"_o{k}") + F.sum(c).over(run))
    return joined.drop("_bucket", *[f"_o{k}" for k in range(len(values))])


def numbered(df: DataFrame, out: str) -> DataFrame:
    """Adds numbers from 1 without gaps, in no stated order: rows are counted by partition, and each partition numbers its own from there."""
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_o") + inside + 1).drop("_place", "_part", "_o")

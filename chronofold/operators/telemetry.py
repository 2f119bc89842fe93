"""Operational telemetry: sliding distinct counts, histograms, metering, eviction and placement ranking, tree sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGISTERS = 1024


def sliding_state(events: DataFrame, item: str, ts: str) -> DataFrame:
    """The mergeable state of a sliding distinct counter: last time seen for each (register, rank).

    States of parts merge by taking the maximum again; the table has at most REGISTERS x 55 rows.
    """
    h = F.xxhash64(F.col(item))
    register = F.pmod(h, F.lit(REGISTERS)).cast("int")
    rest = F.shiftrightunsigned(h, 10)
    rank = F.when(rest == 0, 55).otherwise(55 - F.length(F.bin(rest))).cast("int")
    return events.where(F.col(item).isNotNull()).groupBy(register.alias("register"), rank.alias("rank")).agg(F.max(ts).alias("seen"))


def sliding_estimate(state: DataFrame, since: Column) -> DataFrame:
    """Approximate number of distinct items seen at or after ``since``, from the state."""
    m = float(REGISTERS)
    top = state.where(F.col("seen") >= since).groupBy("register").agg(F.max("rank").alias("r"))
    s = top.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("r"))), F.lit(0.0)).alias("z"), F.count("*").alias("used"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("z") + (F.lit(m) - F.col("used")))
    empty = F.lit(m) - F.col("used")
    return s.select(F.when((raw <= 2.5 * m) & (empty > 0), F.lit(m) * F.log(F.lit(m) / F.greatest(empty, F.lit(1.0)))).otherwise(raw).alias("estimate"))


def exact_windows(events: DataFrame, item: str, ts: str, minutes: list[int], now: Column) -> DataFrame:
    """``minutes, n``: distinct items over the last so many minutes, for each length: each item counts by its newest time once."""
    newest = events.groupBy(item).agg(F.max(ts).alias("seen"))
    lengths = F.array(*[F.lit(m) for m in sorted(minutes)])
    aged = newest.select(F.explode(F.filter(lengths, lambda m: F.col("seen") >= now - F.make_dt_interval(mins=m))).alias("minutes"))
    return aged.groupBy("minutes").agg(F.count("*").alias("n"))


def cumulative_histogram(values: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """``bucket_le, value``: how many values are at most each bound, the last for all (null bound)."""
    bucket = F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value)))
    counts = values.where(F.col(value).isNotNull()).groupBy(bucket.alias("b")).agg(F.count("*").alias("c"))
    all_ = values.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("b"))
    le = F.element_at(F.array(*map(F.lit, bounds), F.lit(None)), F.col("b") + 1)
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    return all_.join(F.broadcast(counts), "b", "left").select(le.alias("bucket_le"), F.sum(F.coalesce("c", F.lit(0))).over(w).alias("value"))


def metered_deltas(samples: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Absolute samples to incremental events: ``by, start, stop, delta``; a value below the highest before adds nothing."""
    w = Window.partitionBy(by).orderBy(at)
    high = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return samples.select(by, F.lag(at).over(w).alias("start"), F.col(at).alias("stop"), F.greatest(F.col(value) - high, F.lit(0)).alias("delta")).where("start is not null")


def request_chunks(events: DataFrame, order: list[str], size: int, groups: str) -> DataFrame:
    """Adds ``chunk``: events of each group in order, ``size`` to a request."""
    w = Window.partitionBy(groups).orderBy(*order)
    return events.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def eviction_plan(layers: DataFrame, reservation: int) -> DataFrame:
    """Layers (tenant, id, size, last_activity, covered) with ``partition`` and ``relative``.

    In order of most recent use, layers within the tenant's reservation are ``below`` and go last; the rest are ``above``. Covered layers are ``now`` and take none of it.
    relative: the share of the tenant's layers that are at least as old, from 1 (newest) on down.
    """
    recent = Window.partitionBy("tenant").orderBy(F.desc("last_activity"), "id")
    used = F.sum(F.when(F.col("covered"), 0).otherwise(F.col("size"))).over(recent.rowsBetween(Window.unboundedPreceding, 0))
    n = F.count("*").over(Window.partitionBy("tenant"))
    part = F.when(F.col("covered"), "now").when(used <= reservation, "below").otherwise("above")
    return layers.select("tenant", "id", "size", part.alias("partition"), ((n - (F.row_number().over(recent) - 1)) / n).alias("relative"))


def victims(plan: DataFrame, needed: int) -> DataFrame:
    """The prefix of the eviction order that frees at least ``needed``.

    The order is (partition, relative, tenant, id). Sums of 3 x 1001 spans of it say which spans go whole; only the
    rows of the span where the need is met are sorted.
    """
    rank = F.when(F.col("partition") == "now", 0).when(F.col("partition") == "above", 1).otherwise(2)
    spanned = plan.withColumn("_span", rank * 1001 + F.floor(F.col("relative") * 1000))
    sums = spanned.groupBy("_span").agg(F.sum("size").alias("s"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # at most 3003 rows
    offsets = sums.select("_span", "s", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < needed)
    chosen = spanned.join(F.broadcast(offsets), "_span")
    whole = chosen.where(F.col("_before") + F.col("s") < needed).select("tenant", "id", "size")
    ordered = Window.partitionBy("_span").orderBy("relative", "tenant", "id")
    edge = chosen.where(F.col("_before") + F.col("s") >= needed)
    freed = F.col("_before") + F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return whole.unionByName(edge.withColumn("_freed", freed).where(F.col("_freed") < needed).select("tenant", "id", "size"))


def place(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """For shards (shard, az): the node of the least (other zone, affinity, utilisation, count, node), by one aggregation a zone."""
    score = lambda other: F.struct(F.lit(other).alias("other"), "affinity", "utilisation", "n_attached", "node")
    anywhere = nodes.agg(F.min(score(1)).alias("any"))
    in_zone = nodes.groupBy("az").agg(F.min(score(0)).alias("own"))
    return shards.join(in_zone, "az", "left").join(F.broadcast(anywhere)).select("shard", F.coalesce("own.node", "any.node").alias("node"))


def size_inputs(timelines: DataFrame, branch_points: DataFrame, leases: DataFrame) -> DataFrame:
    """``timeline, id, lsn, kind, needed, parent``: the segments that :func:`tree_size` weighs, numbered from 1 in each timeline.

    Timelines are (timeline, start, cutoff, last); branch points and leases (timeline, lsn) count above the start. A point above the cutoff
    is needed, and so are the end and what is leased. A lease is a branch of its own that writes nothing: its start hangs on its point and its end on
    its start, while the timeline goes on from the point. Where the cutoff is not above the start, the start itself is needed.
    """
    kinds = {"branch_start": 0, "branch_point": 1, "gc_cutoff": 2, "lease_point": 3, "branch_end": 9}
    t = timelines.select("timeline", "start", "cutoff", "last")

    def rows(df: DataFrame, lsn: str, kind: str, needed: Column) -> DataFrame:
        return df.select("timeline", F.col(lsn).cast("bigint").alias("lsn"), F.lit(kinds[kind]).alias("_k"), F.lit(kind).alias("kind"), needed.alias("needed"))

    above = lambda points: points.select("timeline", "lsn").distinct().join(t, "timeline").where("lsn > start")
    new = F.col("lsn") > F.col("cutoff")
    leased = rows(above(leases), "lsn", "lease_point", new)
    every = rows(t, "start", "branch_start", F.col("cutoff") <= F.col("start")).unionByName(rows(above(branch_points), "lsn", "branch_point", new))
    every = every.unionByName(rows(t.where("cutoff > start"), "cutoff", "gc_cutoff", F.lit(False))).unionByName(leased).unionByName(rows(t, "last", "branch_end", F.lit(True)))
    mine = F.when(F.col("kind") == "lease_point", F.array(F.struct(F.lit(0).alias("j"), "kind", "needed"), F.struct(F.lit(1).alias("j"), F.lit("lease_start").alias("kind"), "needed"), F.struct(F.lit(2).alias("j"), F.lit("lease_end").alias("kind"), F.lit(True).alias("needed"))))
    laid = every.withColumn("x", F.explode(F.coalesce(mine, F.array(F.struct(F.lit(0).alias("j"), "kind", "needed"))))).select("timeline", "lsn", "_k", "x.*")
    place = F.when(F.col("_k") == 0, 0).when(F.col("_k") == 9, 2).otherwise(1)
    w = Window.partitionBy("timeline").orderBy(place, "lsn", "_k", "j")
    numbered = laid.withColumn("id", F.row_number().over(w).cast("bigint"))
    trunk = F.last(F.when(F.col("j") == 0, F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parent = F.when(F.col("j") > 0, F.col("id") - 1).otherwise(trunk)
    return numbered.select("timeline", "id", "lsn", "kind", "needed", parent.cast("bigint").alias("parent"))


def tree_size(segments: DataFrame) -> DataFrame:
    """``tenant, size``: the least cost of keeping each needed point of a branch tree readable.

    Segments are (tenant, id, parent, lsn, size, needed). Each node either stores a snapshot of its size or the log since its
    parent, if that is kept; a subtree without needed points costs nothing. Tenants are dealt to tasks and sorted there, and a task
    goes through its rows in bounded batches: it holds one tenant's tree, which is small, beside a batch.
    """
    inf = float("inf")

    def cheapest(rows: list) -> int:
        nodes = {r[1]: r for r in rows}
        kids: dict = {}
        for r in nodes.values():
            if r[2] is not None:
                kids.setdefault(r[2], []).append(r[1])
        roots = [i for i, r in nodes.items() if r[2] is None]
        order, todo = [], list(roots)
        while todo:
            i = todo.pop()
            order.append(i)
            todo += kids.get(i, ())
        cost: dict = {}  # of the subtree if the node is readable by what is stored above it, and if nothing above is stored
        for i in reversed(order):
            _, _, parent, lsn, size, needed = nodes[i]
            below = [cost[k] for k in kids.get(i, ())]
            kept = sum(k for k, _ in below)
            snapshot = (inf if size is None else float(size)) + kept
            log = inf if parent is None else float(lsn - nodes[parent][3]) + kept
            skip = inf if needed else sum(b for _, b in below)
            cost[i] = min(snapshot, log, skip), min(snapshot, skip)
        return int(sum(cost[i][1] for i in roots))

    def trees(batches):
        import pyarrow as pa

        tenant, rows = None, []
        out: dict = {"tenant": [], "size": []}

        def close():
            if rows:
                out["tenant"].append(tenant)
                out["size"].append(cheapest(rows))
                rows.clear()

        def made():
            batch = pa.RecordBatch.from_pydict(out, pa.schema([("tenant", pa.int64()), ("size", pa.int64())]))
            out["tenant"], out["size"] = [], []
            return batch

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != tenant:
                    close()
                    tenant = r[0]
                rows.append(r)
            yield made()
        close()
        yield made()

    from chronofold.session import ship

    ship(segments.sparkSession)
    dealt = segments.select("tenant", "id", "parent", "lsn", "size", "needed").repartition("tenant").sortWithinPartitions("tenant")
    return dealt.mapInArrow(trees, "tenant bigint, size bigint")

"""Log streams: fan-out, ordered ingest, watermarks and rolling, for batches and for Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.scalar import shard_of
from chronofold.operators.ordered import with_following


def fan_out(records: DataFrame, shards: int, positions: DataFrame | None = None) -> DataFrame:
    """Records (rel, block, next_lsn) with their ``shard``; records a subscriber (shard, position) already has are left out. Works on streams too."""
    routed = records.withColumn("shard", shard_of(F.col("rel"), F.col("block"), shards))
    if positions is None:
        return routed
    return routed.join(F.broadcast(positions), "shard").where("next_lsn > position").drop("position")


def quorum_commit(acks: DataFrame, quorum: int, by: str = "stream") -> DataFrame:
    """``by, commit_lsn``: the quorum-th highest acknowledged position; acknowledgements before the term's start count as 0."""
    counted = F.when(F.col("flush_lsn") >= F.col("term_start"), F.col("flush_lsn")).otherwise(0)
    newest = acks.groupBy(by, "member").agg(F.max(counted).alias("l"))
    ranked = newest.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("l"), "member")))
    return ranked.where(F.col("r") == quorum).select(by, F.col("l").cast("bigint").alias("commit_lsn"))


def truncate_watermark(acks: DataFrame, commits: DataFrame, by: str = "stream") -> DataFrame:
    """The position below which no member needs the log: the least flush position, but not above the commit."""
    least = acks.groupBy(by, "member").agg(F.max("flush_lsn").alias("l")).groupBy(by).agg(F.min("l").alias("m"))
    return least.join(commits, by).select(by, F.least("m", "commit_lsn").alias("truncate_lsn"))


def retention_horizon(*positions: Column) -> Column:
    return F.least(*positions)


def feedback(replies: DataFrame) -> DataFrame:
    """The least valid xmin and the newest time of standby replies."""
    return replies.agg(F.min(F.when(F.col("xmin") > 0, F.col("xmin"))).alias("xmin"), F.max("ts").alias("ts"))


def common_point(a: DataFrame, b: DataFrame) -> DataFrame:
    """For term histories (term, start): ``lsn``, where two logs still agree: the least end of the last shared term."""
    side = lambda d, p: with_following(d.select("term", "start"), "term", "start", "_end").select("term", F.col("start").alias(f"{p}_start"), F.col("_end").alias(f"{p}_end"))
    both = side(a, "a").join(side(b, "b"), "term").where("a_start = b_start")
    last = both.agg(F.max_by(F.struct("a_end", "b_end"), "term").alias("e"))
    return last.select(F.least("e.a_end", "e.b_end").alias("lsn"))


def effective_lsn(requests: DataFrame, last: int, cutoff: int, grace: bool = False) -> DataFrame:
    """Requests (id, lsn, not_modified_since, leased): ``id, lsn, status``, the position to read at (null for a refused one).

    Checked in this order: ``bad_request`` for a position below not_modified_since, or of 0; ``too_old`` below the cutoff without a lease, unless
    leases are still in their grace period; ``wait`` (until not_modified_since) where that is above the last position; else ``ok``.
    """
    since, asked = F.col("not_modified_since"), F.col("lsn")
    old = (asked < cutoff) & ~F.col("leased") & F.lit(not grace)
    status = F.when((asked < since) | (asked == 0), "bad_request").when(old, "too_old").when(since > last, "wait").otherwise("ok")
    at = F.when(status == "wait", since).when(status == "ok", F.least(asked, F.lit(last)))
    return requests.select("id", at.cast("bigint").alias("lsn"), status.alias("status"))


def batches(requests: DataFrame, by: list[str], most: int) -> DataFrame:
    """Adds ``batch``: neighbouring requests of a session that agree in ``by``, at most ``most`` in one."""
    w = Window.partitionBy("session").orderBy("seq")
    new = reduce_or([F.col(c) != F.lag(c).over(w) for c in by]) | F.lag("seq").over(w).isNull()
    runs = requests.withColumn("_n", F.when(new, 1).otherwise(0)).withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("session", "_run").orderBy("seq")) - 1
    return runs.withColumn("_part", F.floor(place / most)).withColumn("batch", F.dense_rank().over(Window.partitionBy("session").orderBy("_run", "_part"))).drop("_n", "_run", "_part")


def reduce_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def out_of_order(log: DataFrame, by: str = "stream") -> DataFrame:
    """Records whose position goes back behind what was ingested before them; an ordered log refuses them."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_high", F.max("lsn").over(w)).where("lsn < _high").drop("_high")


def roll_memtable(log: DataFrame, max_bytes: int, by: str = "stream") -> DataFrame:
    """A stream of rolls ``stream, first_lsn, last_lsn, bytes``: a part closes when its bytes reach ``max_bytes``, never within a position.

    ``log`` is a streaming DataFrame of (stream, lsn, bytes); state is the open part of each stream.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from chronofold.session import ship

    ship(log.sparkSession)

    def roll(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, size = state.get if state.exists else (-1, -1, 0)
        closed = []
        rows = pd.concat(list(pdfs)).sort_values("lsn")
        for lsn, n in zip(rows.lsn, rows.bytes):
            if size >= max_bytes and lsn != last:
                closed.append((key[0], first, last, size))
                first, size = -1, 0
            first, last, size = (lsn if first < 0 else first), lsn, size + n
        state.update((int(first), int(last), int(size)))
        yield pd.DataFrame(closed, columns=["stream", "first_lsn", "last_lsn", "bytes"])

    return log.groupBy(by).applyInPandasWithState(roll, f"{by} bigint, first_lsn bigint, last_lsn bigint, bytes bigint", "first bigint, last bigint, size bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Tumbling counts by event type; on a stream with a watermark of ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def subscribe(messages: DataFrame, stream: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Messages (stream, kind, ...) of one stream or all, of the wanted kinds; works on streams too."""
    out = messages if stream is None else messages.where(F.col("stream") == stream)
    return out if kinds is None else out.where(F.col("kind").isin(kinds))


def ingest(path: str, by: str = "stream") -> object:
    """For ``foreachBatch``: append a micro-batch of (stream, lsn, ...) to Parquet, one folder a batch, so that a replay replaces itself.

    A batch that goes back behind what earlier batches stored is refused: the log is ordered.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        low = batch.groupBy(by).agg(F.min("lsn").alias("low"))
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            stored = spark.read.parquet(path).where(F.col("batch") < batch_id).groupBy(by).agg(F.max("lsn").alias("high"))
            if not low.join(stored, by).where("low < high").isEmpty():
                raise ValueError(f"batch {batch_id} goes back in the log")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def request_log(requests: DataFrame, path: str, checkpoint: str, every: str = "1 minute", rows_per_file: int = 100_000) -> object:
    """Start writing a stream of request rows as Parquet files, closed by size or age."""
    return requests.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file).trigger(processingTime=every).start()


def reached(path_rows: DataFrame, lsn: int) -> bool:
    """Whether stored rows have reached a position: the test of a read-your-writes barrier."""
    top = path_rows.agg(F.max("lsn")).first()[0]
    return top is not None and top >= lsn


def wait_until(progress: Callable[[], DataFrame], lsn: int, timeout: float = 300.0, every: float = 0.2) -> bool:
    """Wait until the rows that ``progress`` gives have reached a position: true, or false after ``timeout`` seconds. It is read once at least."""
    end = time.monotonic() + timeout
    while not reached(progress(), lsn):
        if time.monotonic() >= end:
            return False
        time.sleep(min(every, max(0.0, end - time.monotonic())))
    return True


def metered(samples: DataFrame, tick: str, late: str) -> DataFrame:
    """Incremental metering on a stream of absolute samples (tenant, ts, value): ``tenant, start, low, high`` of each tick.

    A tick's use is its high less the high of the ticks before; :func:`chronofold.operators.telemetry.metered_deltas` over the closed ticks gives it, and
    a value that falls back adds nothing. A tick closes when the watermark, ``late`` behind the newest sample, has passed it.
    """
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("tenant", F.window("ts", tick)).agg(F.min("value").alias("low"), F.max("value").alias("high")).select("tenant", F.col("window.start").alias("start"), "low", "high")


def sliding_counts(events: DataFrame, item: str, length: str, slide: str, late: str | None = None) -> DataFrame:
    """``start, n``: approximate distinct items of each sliding window; on a stream with a watermark of ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, slide)).agg(F.approx_count_distinct(item, 0.02).alias("n")).select(F.col("window.start").alias("start"), "n")

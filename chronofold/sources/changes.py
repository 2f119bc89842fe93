"""Sources and sinks: layer files, change feeds, and micro-batch sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_layers(rows: DataFrame, path: str, partitions: int, key: str = "key", lsn: str = "lsn", rows_per_file: int | None = None) -> None:
    """Delta or image files: ranges of whole keys, sorted by key and position, so that reads skip by the files' statistics.

    With ``rows_per_file`` larger ranges are several files, which may part a key by position.
    """
    rows.repartitionByRange(partitions, key).sortWithinPartitions(key, lsn).write.option("maxRecordsPerFile", rows_per_file or 0).parquet(path)


def read_layers(spark: SparkSession, path: str, start: int, end: int, upto: int) -> DataFrame:
    """Versions of keys in [start, end) up to a position; the bounds reach the Parquet scan."""
    return spark.read.parquet(path).where((F.col("key") >= start) & (F.col("key") < end) & (F.col("lsn") <= upto))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a path with size and time, listed by Spark's file source."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def change_feed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, op, before, after`` of what differs: c(reated), u(pdated) or d(eleted)."""
    a = old.select(key, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = new.select(key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    op = F.when(F.col("_a").isNull(), "c").when(F.col("_b").isNull(), "d").when(~F.col("before").eqNullSafe(F.col("after")), "u")
    return a.join(b, key, "full").select(key, op.alias("op"), "before", "after").where("op is not null")


def metering_sink(path: str, per_request: int = 1000) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a micro-batch as gzip JSON, at most ``per_request`` events a file; a batch replayed replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", per_request).json(f"{path}/batch={batch_id}")

    return write


def copy_out(rows: DataFrame, path: str, files: int) -> None:
    """Bulk export as CSV in ``files`` parts written side by side; nulls are bare, empty strings quoted."""
    rows.repartition(files).write.option("quoteAll", True).option("nullValue", "\\N").option("escape", '"').option("emptyValue", "").option("compression", "gzip").csv(path)


def copy_in(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`copy_out` wrote, one task a part; values may hold line ends."""
    return spark.read.schema(schema).option("nullValue", "\\N").option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)


def import_plan(relations: DataFrame, most: int, shards: int) -> DataFrame:
    """``rel, first, blocks, shard``: jobs of at most ``most`` blocks for an import of relations (rel, blocks), dealt to shards; a relation without blocks is one job.

    The jobs are rows, so Spark reads and writes them side by side.
    """
    firsts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("blocks") - 1, F.lit(0)), F.lit(most).cast("bigint"))
    jobs = relations.select("rel", "blocks", F.explode(firsts).alias("first"))
    return jobs.select("rel", "first", F.least(F.lit(most), F.col("blocks") - F.col("first")).alias("blocks"), F.pmod(F.xxhash64("rel", "first"), F.lit(shards)).alias("shard"))

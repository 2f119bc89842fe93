"""Tables written once and read back: lineage is cut, and what is read several times is made once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Spark's setting to delete a statement's shuffle files when it ends, rather than at some later collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or one of our own in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cuts"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage so that a lost executor costs a reread, not a recomputation. The
    tables are deleted when the driver's Python ends, or earlier by :func:`drop_cuts`. Spark
    drops the write's shuffle files at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the cut tables that ``frames`` read."""
    for df in frames:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(spark, name)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return

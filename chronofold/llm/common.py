"""Shared helpers of the training-data operators: table access, materialised cuts and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.cuts import cut, drop_cuts, shared_dir  # noqa: F401
from chronofold.session import ship, table  # noqa: F401

#: Bytes of strings and binaries that a mapped function is given at once; a longer row comes alone.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES, so that what a function makes of one stays small."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def arrow_map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Map Arrow batches, each given as a dict of Arrow columns, to a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                got = fn({n: b.column(i) for i, n in enumerate(b.schema.names)})
                arrays = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in out]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) over an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def like_documents(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``df`` with the columns and order of the documents table."""
    return df.select(*table(spark, sf_dir, "documents").columns)


def hash_fraction(col: str, seed: int = 0):
    """A column in [0, 1) that depends only on the value of ``col``."""
    return (F.shiftrightunsigned(F.xxhash64(F.col(col), F.lit(seed)), 11)) / F.lit(float(1 << 53))

"""Every query of the library's own operators, by name, with SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.plans import catalog, relational

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = {k: relational.spark_query(v) for k, v in (relational.TPCH | relational.CLICKS | relational.SHAPES).items()}
    found |= {k: relational.spark_query(a) for k, (a, _) in relational.TWO_TEXTS.items()}
    return found | catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    found = {k: relational.oracle(v) for k, v in (relational.TPCH | relational.CLICKS | relational.SHAPES).items()}
    found |= {k: b for k, (_, b) in relational.TWO_TEXTS.items()}
    return found | catalog.SQL

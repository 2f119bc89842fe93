"""Every registered query of the library runs, and equals its SQL where it has some."""

import duckdb
import pytest

from chronofold import registry
from tests.compare import same
from tests.test_operators import brute_retained

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) == {"F03_test_record_fold", "F11_key_retention", "W09_greedy_packing", "A14_sliding_hll", "A15_hll_union", "S21_table_sample"}


def test_retention_query(spark, sf_dir):
    rows = [(r.user_id, r.event_id, r.event_type == "signup") for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    assert sorted(map(tuple, QUERIES["F11_key_retention"](spark, sf_dir).collect())) == brute_retained(rows, [2000, 4000, 5000, 6000], 3)


def test_packing_query(spark, sf_dir):
    groups: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").collect():
        groups.setdefault(r.o_custkey % 20, []).append((r.o_orderkey * 10, r.o_orderkey * 10 + 1 + r.o_orderkey % 9))
    want = set()
    for g, ranges in groups.items():
        part = size = 0
        for s, e in ranges:
            if size and size + e - s > 100:
                part, size = part + 1, 0
            size += e - s
            want.add((g, s, e, part))
    assert {tuple(r) for r in QUERIES["W09_greedy_packing"](spark, sf_dir).collect()} == want


def test_estimates_are_close(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = e.agg({"event_id": "max"}).first()[0] // 2
    exact = e.where(f"event_id >= {half}").select("user_id").distinct().count(), e.select("user_id").distinct().count()
    got = QUERIES["A14_sliding_hll"](spark, sf_dir).first()["estimate"], QUERIES["A15_hll_union"](spark, sf_dir).first()["estimate"]
    assert all(abs(g - x) <= 0.1 * x + 1 for g, x in zip(got, exact))


def test_sample_query(spark, sf_dir):
    all_ = {r.o_orderkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    got = [r.o_orderkey for r in QUERIES["S21_table_sample"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) <= all_ and 0.05 * len(all_) < len(got) < 0.2 * len(all_)


def with_tables(duck, folder, **tables):
    """A folder of the named tables, from SQL, and a DuckDB of its own that has them as views."""
    own = duckdb.connect()
    for name, sql in tables.items():
        duck.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), own


def test_ulids_of_times_over_48_bits(spark, duck, tmp_path):
    days = "(VALUES (0), (1), (3257812), (3257813), (5999999), (52125001)) t(event_id)"
    folder, own = with_tables(duck, tmp_path, events=f"SELECT CAST(event_id AS BIGINT) AS event_id FROM {days}")
    same(QUERIES["FN_ulid_uuid"](spark, folder), own.sql(SQL["FN_ulid_uuid"]))


def test_word_counts_move_texts_once(spark, duck, tmp_path):
    docs = "(VALUES (1, 'a b a'), (1, 'a  c '), (2, ''), (3, NULL), (4, 'b b')) t(doc_id, text)"
    folder, own = with_tables(duck, tmp_path, documents=f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {docs}")
    made = QUERIES["S24_unnest_lateral"](spark, folder)
    same(made, own.sql(SQL["S24_unnest_lateral"]))
    text = QUERIES["S24_unnest_lateral"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in text.split("\n") if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "REPARTITION_BY_COL" in shuffles[0], shuffles  # texts, not their words

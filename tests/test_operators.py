"""Operators that SQL doesn't express, edge cases, sources and streams."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions import scalar as fn
from chronofold.operators import keyspace, layers, telemetry, versioned
from chronofold.sources import changes
from chronofold.streaming import log


def test_fold_test_records(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["append", "append", "clear", "only_if"]), rng.choice("abc") * rng.randint(1, 3)) for k in range(5) for i in range(20)]
    got = {r.key: r.value for r in versioned.fold_test_records(spark.createDataFrame(rows, "key long, lsn long, op string, text string")).collect()}
    for k in range(5):
        value = ""
        for _, _, op, text in sorted(r for r in rows if r[0] == k):
            value = "" if op == "clear" else value if op == "only_if" and len(value) % 2 else value + text
        assert got[k] == value


def test_reads_without_a_base_or_a_version(spark):
    h = spark.createDataFrame([(1, 5, False, "d5"), (1, 9, True, "I9"), (1, 12, False, "d12")], "key long, lsn long, will_init boolean, payload string")
    asked = spark.createDataFrame([(1, 4), (1, 7), (1, 9), (1, 20), (2, 20)], "key long, at long")
    got = {(r.key, r.at): (r.value, r.n_records, r.status) for r in versioned.reconstruct(asked, h).collect()}
    assert got == {(1, 4): (None, 0, "missing"), (1, 7): (None, 1, "no_base"), (1, 9): ("I9", 1, "ok"), (1, 20): ("I9,d12", 2, "ok"), (2, 20): (None, 0, "missing")}


def test_retention_example(spark):
    # An image at 0x10 and appends at 0x20 ... 0x70, an image at 0x80, an append at 0x90; horizon 0x60; retained 0x20, 0x40, 0x50.
    lsns = [0x10, 0x20, 0x30, 0x40, 0x50, 0x60, 0x70, 0x80, 0x90]
    h = spark.createDataFrame([(1, x, x in (0x10, 0x80)) for x in lsns], "key long, lsn long, will_init boolean")
    got = [(r.lsn, r.form) for r in versioned.retained(h, [0x20, 0x40, 0x50], 0x60, 3).orderBy("lsn").collect()]
    assert got == [(0x20, "image"), (0x30, "delta"), (0x40, "delta"), (0x50, "image"), (0x60, "delta"), (0x70, "delta"), (0x80, "image"), (0x90, "delta")]


def test_lsn_for_timestamp_verdicts(spark):
    c = spark.createDataFrame([(16, 10), (40, 20), (80, 30)], "lsn long, ts long")
    ask = lambda t: tuple(versioned.lsn_for_timestamp(c, F.lit(t)).first())
    assert ask(20) == (32, "present") and ask(21) == (72, "present") and ask(5) == (0, "past") and ask(99) == (80, "future")
    low = lambda t, least: tuple(versioned.lsn_for_timestamp(c, F.lit(t), least).first())
    assert low(20, 40) == (40, "past") and low(21, 40) == (72, "present") and low(5, 24) == (24, "past") and low(99, 96) == (96, "past")
    assert tuple(versioned.lsn_for_timestamp(c.limit(0), F.lit(1), 24).first()) == (24, "nodata")


def test_range_sets_against_keys(spark):
    rng = random.Random(8)
    for _ in range(3):
        a, b = ([(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 80) for _ in range(12))] for _ in range(2))
        da, db = (spark.createDataFrame(x, "start long, end long") for x in (a, b))
        ka, kb = (({k for s, e in x for k in range(s, e)}) for x in (a, b))
        keys = lambda d: {k for r in d.collect() for k in range(r.start, r.end)}
        assert keys(keyspace.union(da, db)) == ka | kb
        assert keys(keyspace.intersect(da, db)) == ka & kb
        assert keys(keyspace.difference(da, db)) == ka - kb
        pairs = {(r.a_start, r.a_end, r.b_start, r.b_end) for r in keyspace.overlap_join(da, db).collect()}
        assert pairs == {(*x, *y) for x in a for y in b if max(x[0], y[0]) < min(x[1], y[1])}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "start long, end long")
    assert keyspace.union(none, none).count() == keyspace.intersect(none, none).count() == keyspace.overlap_join(none, none).count() == 0


def test_tree_size_examples(spark):
    # Insert 5000, then five updates of 1000 each; all points within retention 1000 are needed.
    s = "tenant long, id long, parent long, lsn long, size long, needed boolean"
    chain = [(1, 0, None, 5000, 5000, False), (1, 1, 0, 9000, 5000, True), (1, 2, 1, 10000, 5000, True)]
    assert telemetry.tree_size(spark.createDataFrame(chain, s)).first()["size"] == 6000
    unneeded = [(2, 0, None, 5000, 5000, False), (2, 1, 0, 6000, 5000, False)]
    assert telemetry.tree_size(spark.createDataFrame(unneeded, s)).first()["size"] == 0


def test_trees_over_several_batches(spark):
    # A chain of 10 needed segments a tenant: the root's snapshot and nine logs of 1; batches of 7 rows end inside tenants.
    s = spark.range(3000).selectExpr("id div 10 as tenant", "id % 10 as id", "if(id % 10 = 0, null, id % 10 - 1) as parent", "id % 10 as lsn", "if(id % 10 = 0, 100 + id div 10, null) as size", "true as needed")
    s = s.unionByName(spark.range(3).selectExpr("cast(null as bigint) as tenant", "id", "cast(null as bigint) as parent", "id as lsn", "cast(4 as bigint) as size", "true as needed"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = telemetry.tree_size(s)
        assert sorted((r.tenant is None, r.tenant, r.size) for r in made.where("tenant is not null").collect()) == [(False, t, 109 + t) for t in range(300)]
        assert [r.size for r in made.where("tenant is null").collect()] == [12]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "FlatMapGroupsInPandas" not in plan(made)  # no call and no frame a tenant


def test_sliding_distinct_is_close(spark):
    e = spark.range(20000).select((F.col("id") % 5000).alias("u"), F.col("id").alias("t"))
    state = telemetry.sliding_state(e, "u", "t")
    for since, exact in ((0, 5000), (19000, 1000), (19950, 50)):
        got = telemetry.sliding_estimate(state, F.lit(since)).first()["estimate"]
        assert abs(got - exact) < 0.1 * exact
    assert telemetry.sliding_estimate(state.limit(0), F.lit(0)).first()["estimate"] == pytest.approx(0)


def test_layer_files_prune(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 3).alias("lsn"), F.lit("x").alias("payload"))
    changes.write_layers(rows, str(tmp_path / "l"), 4)
    got = changes.read_layers(spark, str(tmp_path / "l"), 100, 200, 450)
    assert got.count() == 51
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,100)" in plan and "LessThan(key,200)" in plan
    assert changes.listing(spark, str(tmp_path / "l")).count() >= 4


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(fn.lsn_text(F.lit(0x1_0000_00FF))) == "1/FF" and get(fn.lsn_parse(F.lit("1/FF"))) == 0x1_0000_00FF
    assert get(fn.text_chunks(F.lit("abcdefgh"), 4, 1)) == ["abcd", "defg", "gh"]
    assert get(fn.text_chunks(F.lit(""), 4, 1)) == [] and get(fn.text_chunks(F.lit(None).cast("string"), 4, 1)) is None
    assert get(fn.ulid_millis(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == 1469922850259
    assert get(fn.hamming(F.lit("1010"), F.lit("1001"))) == 2
    assert get(fn.ulid_uuid(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == "01563e3a-b5d3-d676-4c61-efb99302bd5b" and get(fn.ulid_uuid(F.lit("x"))) is None
    assert get(fn.uuid_ulid(F.lit("01563e3a-b5d3-d676-4c61-efb99302bd5b"))) == "01ARZ3NDEKTSV4RRFFQ69G5FAV"
    assert get(fn.json_set(F.lit('{"a":1,"b":[1,{"c":null}],"d":"x"}'), "b", F.lit('{"z":2.5}'))) == '{"a":1,"d":"x","b":{"z":2.5}}'
    html = '<head><title>t</title></head><h1>Hi <b>you</b></h1><p>A <a href="u">link</a> &amp; <em>more</em>.</p><ul><li>one</li><li>two</li></ul>'
    assert get(fn.markdown_from_html(F.lit(html))) == "# Hi **you**\n\nA [link](u) & _more_.\n\n* one\n* two"


def test_memtable_rolls_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(1, 10 * k + i, 40) for i in range(5)], "stream long, lsn long, bytes long").coalesce(1).write.parquet(str(source / f"b{k}"))
    stream = spark.readStream.schema("stream long, lsn long, bytes long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = log.roll_memtable(stream, 100).writeStream.format("memory").queryName("rolls").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("rolls").orderBy("first_lsn").collect()
    assert sum(r.bytes for r in got) in range(480, 601) and all(r.bytes >= 100 for r in got)


def test_windows_on_a_stream(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path / "e")
    e.write.parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    q = log.windowed_counts(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == e.count()


def test_metering_sink_replays(spark, tmp_path):
    write = changes.metering_sink(str(tmp_path / "m"), 10)
    batch = spark.range(25).repartition(1)
    write(batch, 1)
    write(batch, 1)
    assert spark.read.json(str(tmp_path / "m")).count() == 25


def test_ingest_refuses_to_go_back(spark, tmp_path):
    write = log.ingest(str(tmp_path / "log"))
    rows = lambda *v: spark.createDataFrame([(1, x) for x in v], "stream long, lsn long")
    write(rows(1, 2, 3), 0)
    write(rows(3, 4), 1)
    write(rows(3, 4), 1)
    with pytest.raises(ValueError):
        write(rows(2), 2)
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.count() == 5 and log.reached(stored, 4) and not log.reached(stored, 5)
    assert log.subscribe(stored.withColumn("kind", F.lit("a")), 1, ["a"]).count() == 5


def test_json_schema():
    from chronofold.functions.json_schema import errors

    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}, "maxItems": 2}}, "additionalProperties": False}
    assert errors(schema, {"a": 2, "b": ["x"]}) == []
    assert errors(schema, {"a": 0}) == ["$.a: range"] and errors(schema, []) == ["$: type"]
    assert errors(schema, {"a": 1, "b": ["x", "y", "x"], "c": 1}) == ["$.b: items", "$.b[1]: enum", "$: additionalProperties c"]
    assert errors({"not": {"type": "null"}, "anyOf": [{"type": "string"}, {"const": 3}]}, 3) == []


def test_l0_run_stops_at_a_hole(spark):
    d = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 25, 30), (4, 30, 40)], "id long, lsn_start long, lsn_end long")
    assert [r.id for r in layers.contiguous_l0(d).orderBy("id").collect()] == [1, 2]


def brute_retained(rows, points, threshold):
    out = []
    for key in sorted({k for k, _, _ in rows}):
        at: dict = {}
        for k, x, i in rows:
            if k == key:
                at[x] = at.get(x, False) or i
        since, first, low = 0, True, -1
        for p in points:
            part, low = [x for x in sorted(at) if low < x <= p], p
            if not part:
                continue
            images = [x for x in part if at[x]]
            if images:
                part, since = [x for x in part if x >= images[-1]], 0
            deltas = sum(not at[x] for x in part)
            if first or images and not deltas or since + deltas >= threshold:
                out.append((key, part[-1], "image"))
                since = 0
            else:
                out += [(key, x, "image" if at[x] else "delta") for x in part]
                since += deltas
            first = False
        out += [(key, x, "image" if at[x] else "delta") for x in sorted(at) if x > points[-1]]
    return sorted(out)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_retention_needs_no_whole_history(spark):
    rng = random.Random(9)
    rows = [(k, rng.randint(0, 130), rng.random() < 0.12) for k in range(30) for _ in range(rng.randint(1, 60))]
    got = versioned.retained(spark.createDataFrame(rows, "key long, lsn long, will_init boolean"), [20, 40, 41, 70, 90], 100, 6)
    assert sorted(map(tuple, got.collect())) == brute_retained(rows, [20, 40, 41, 70, 90, 100], 6)
    assert "Pandas" not in plan(got)


def test_layer_orders_need_no_single_task(spark):
    rng = random.Random(10)
    rows = [(i, 10 * (i // 2), 10 * (i // 2) + 50, rng.randint(1, 900)) for i in range(400)]
    got = layers.gc_jobs(spark.createDataFrame(rows, "id long, start long, end long, size long"), 5000)
    want, before = {}, 0
    for _, s, e, z in rows:
        a = want.setdefault(before // 5000, [s, e, 0])
        a[0], a[1], a[2] = min(a[0], s), max(a[1], e), a[2] + z
        before += z
    assert {r.job: [r.start, r.end, r.bytes] for r in got.collect()} == want
    for hole in (0, 1, 150, 299, 300):  # the layer of this number starts late
        d = [(300 - i, 10 * i + (3 if i >= hole else 0), 10 * i + 10 + (3 if i >= hole else 0)) for i in range(300)]
        run = layers.contiguous_l0(spark.createDataFrame(d, "id long, lsn_start long, lsn_end long"))
        assert run.count() == (hole or 300)
    # No window over rows: those without a partition read one row a bucket.
    for df in (got, run):
        assert "windowspecdefinition(start" not in plan(df) and "windowspecdefinition(lsn_start" not in plan(df)


def test_record_fold_query_reads_all_events(spark, sf_dir):
    from chronofold import registry

    values: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        value = values.get(r.user_id, "")
        values[r.user_id] = "" if r.event_type == "signup" else value if r.event_type == "error" and len(value) % 2 else value + str(r.event_id % 100)
    assert {r.key: r.value for r in registry.queries()["F03_test_record_fold"](spark, sf_dir).collect()} == values


def test_gc_cutoffs_case_by_case(spark):
    rows = [
        (1, 70, 50, True, 900, 20, (70, 70, 70)),  # a known time rules alone
        (2, 30, 50, True, 900, 20, (30, 30, 30)),
        (3, None, 50, True, 900, 20, (20, 50, 20)),  # an unknown one is no further than what was applied
        (4, 70, 50, False, 900, 20, (900, 70, 70)),  # no time-based retention: whichever keeps less
        (5, 30, 50, False, 900, 20, (900, 50, 50)),
        (6, None, 50, False, 900, 20, (900, 50, 50)),
    ]
    d = spark.createDataFrame([r[:6] for r in rows], "id long, time_cutoff long, space_cutoff long, pitr_on boolean, last_lsn long, applied_cutoff long")
    assert {r.id: (r.time, r.space, r.cutoff) for r in layers.gc_cutoffs(d).collect()} == {r[0]: r[6] for r in rows}


def test_effective_lsn_case_by_case(spark):
    rows = [
        (1, 90, 95, True, (None, "bad_request")),  # asked below not_modified_since
        (2, 0, 0, True, (None, "bad_request")),
        (3, 40, 30, False, (None, "too_old")),
        (4, 40, 30, True, (40, "ok")),  # a lease holds it
        (5, 300, 200, False, (200, "wait")),
        (6, 300, 80, False, (100, "ok")),  # nothing newer changed it: the last position will do
        (7, 70, 60, False, (70, "ok")),
        (8, 40, 200, False, (None, "bad_request")),
        (9, 100, 100, False, (100, "ok")),
    ]
    d = spark.createDataFrame([r[:4] for r in rows], "id long, lsn long, not_modified_since long, leased boolean")
    assert {r.id: (r.lsn, r.status) for r in log.effective_lsn(d, 100, 50).collect()} == {r[0]: r[4] for r in rows}
    assert log.effective_lsn(d, 100, 50, grace=True).where("id = 3").first()["status"] == "ok"


LAYER = "id long, kind string, start long, end long, lsn_start long, lsn_end long, size long, l0 boolean"


@pytest.mark.parametrize(
    "rows, disk, want",
    [
        ([], 500, 499),  # nothing: all up to the disk's position
        ([("image", 0, 100, 200, 201, False)], 500, 499),
        ([("image", 0, 100, 200, 201, False), ("delta", 10, 20, 300, 310, False)], 500, 299),  # one delta after the image
        ([("image", 0, 100, 200, 201, False), ("delta", 10, 20, 150, 310, False)], 500, 201),  # a delta straddles the image: the image's own end
        ([("image", 0, 100, 200, 201, False), ("image", 0, 100, 280, 281, False), ("delta", 10, 20, 210, 270, False)], 500, 499),  # superseded by the newer image
        ([("image", 0, 100, 200, 201, False), ("delta", 0, 1000, 320, 330, True)], 500, 319),  # level 0 bounds all
        ([("delta", 10, 20, 150, 160, False)], 500, 149),  # no image at all
        ([("image", 0, 50, 200, 201, False), ("delta", 50, 60, 150, 160, False)], 500, 149),  # a delta beside the image, where there is none
        ([("image", 0, 50, 100, 101, False), ("image", 50, 90, 400, 401, False), ("delta", 50, 60, 150, 160, False)], 500, 149),  # it counts where it begins, too
        ([("image", 0, 100, 600, 601, False), ("delta", 0, 100, 550, 560, False)], 500, 499),  # above the disk's position
    ],
)
def test_consistent_lsn_case_by_case(spark, rows, disk, want):
    d = spark.createDataFrame([(i, *r[:5], 1, r[5]) for i, r in enumerate(rows)], LAYER)
    assert [r.lsn for r in layers.consistent_lsn(d, disk).collect()] == [want]


def test_leases_case_by_case(spark):
    asked = spark.createDataFrame([(1, 50, 10, True), (2, 150, 10, True), (3, 150, 10, False), (4, 300, 10, True), (5, 80, 99, False), (6, 80, 5, True), (7, 300, 20, False)], "id long, lsn long, valid_until long, initial boolean")
    held = spark.createDataFrame([(80, 40)], "lsn long, valid_until long")
    got = lambda grace: {r.id: (r.valid_until, r.status) for r in layers.grant_leases(asked, held, 100, 200, grace).collect()}
    want = {1: (None, "refused"), 2: (None, "refused"), 3: (None, "refused"), 4: (20, "granted"), 5: (99, "renewed"), 6: (99, "renewed"), 7: (20, "granted")}
    assert got(False) == want
    assert got(True) == want | {3: (10, "granted")}


def test_wide_and_narrow_ranges_meet(spark):
    rng = random.Random(5)
    draw = lambda: (s := rng.randint(-(10**12), 10**12), s + rng.choice([1, 2, 1000, 10**9, 10**12]))
    a, b = [draw() for _ in range(60)], [draw() for _ in range(60)]
    da, db = (spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "id long, start long, end long") for x in (a, b))
    got = [(r.a_id, r.b_id) for r in keyspace.overlap_join(da, db).collect()]
    assert sorted(got) == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1])


def test_copies_of_a_range_make_no_pairs(spark):
    rng = random.Random(6)
    draw = [(s := rng.randint(0, 60), s + rng.randint(0, 20)) for _ in range(80)]
    rows = [(i, *draw[rng.randint(0, 79)]) for i in range(300)]
    got = {r.id: r.n for r in keyspace.contained_counts(spark.createDataFrame(rows, "id long, start long, end long")).collect()}
    full = [r for r in rows if r[1] < r[2]]
    want = {a[0]: sum(a[1] <= b[1] and b[2] <= a[2] and a[0] != b[0] for b in full) for a in full}
    assert got == {k: n for k, n in want.items() if n}
    many = spark.range(20000).selectExpr("id", "id % 3 as start", "id % 3 + 5 as end")
    counts = keyspace.contained_counts(many)
    assert joined_rows(counts) < 10**6
    assert {r.n for r in counts.select("n").distinct().collect()} == {6666, 6665}


def test_pairs_of_shared_ranges(spark):
    rng = random.Random(8)
    draw = [(s := rng.randint(0, 90), s + rng.randint(0, 20)) for _ in range(30)]
    a, b = ([(i, *draw[rng.randint(0, 29)]) for i in range(n)] for n in (200, 150))
    got = keyspace.overlap_ids(spark.createDataFrame(a, "q long, start long, end long"), spark.createDataFrame(b, "id long, start long, end long"), "q", "id")
    full = lambda rows: [r for r in rows if r[1] < r[2]]
    assert sorted((r.a_q, r.b_id) for r in got.collect()) == sorted((x[0], y[0]) for x in full(a) for y in full(b) if x[1] < y[2] and y[1] < x[2])
    many = spark.range(2500).selectExpr("id", "id % 2 as start", "id % 2 + 5 as end")
    pairs = keyspace.overlap_ids(many.withColumnRenamed("id", "q"), many, "q", "id").agg(F.count("*"), F.sum("a_q"), F.sum("b_id"), F.sum(F.col("a_q") * F.col("b_id")))
    assert tuple(pairs.first()) == (2500**2, *[2500 * sum(range(2500))] * 2, sum(range(2500)) ** 2)
    assert joined_rows(pairs) < 10**5  # arrays, not pairs


def test_pairs_are_handed_on_in_parts(spark):
    many = spark.range(2000).selectExpr("id", "0 as start", "5 as end")
    one = keyspace.overlap_ids(many.withColumnRenamed("id", "q"), many, "q", "id").limit(1)
    assert one.count() == 1 and len(one.collect()) == 1
    node = one._jdf.queryExecution().executedPlan().executedPlan()
    while node.nodeName() != "Generate":
        node = node.plan() if node.getClass().getSimpleName().endswith("QueryStageExec") else node.children().apply(0)
    assert 0 < node.metrics().apply("numOutputRows").value() < 10**5  # not all pairs of two arrays, which are a million
    few = many.where("id < 23")
    for held in (1, 7, 100, 10**12):
        pairs = keyspace.overlap_ids(few.withColumnRenamed("id", "q"), few, "q", "id", held)
        assert sorted(map(tuple, pairs.collect())) == [(q, i) for q in range(23) for i in range(23)]


def test_covered_layers_against_keys(spark):
    rng = random.Random(9)
    rows = []
    for i in range(250):
        s, low, kind = rng.randint(0, 40), rng.randint(0, 30), rng.choice(["image", "delta"])
        rows.append((i, kind, s, s + rng.randint(1, 8), low, low + (rng.choice([0, 1, 1, 1]) if kind == "image" else rng.randint(1, 9))))
    m = spark.createDataFrame(rows, "id long, kind string, start long, end long, lsn_start long, lsn_end long")

    def covered(a, point):
        newer = [b for b in rows if b[1] == "image" and b[0] != a[0] and a[5] <= b[4] <= point]
        return all(any(b[2] <= k < b[3] for b in newer) for k in range(a[2], a[3]))

    points = [12, 20, 35]
    got = {r.id for r in layers.visible(m, spark.createDataFrame([(p,) for p in points], "lsn long")).collect()}
    assert got == {a[0] for a in rows if any(a[4] <= p and not covered(a, p) for p in points)}
    none = spark.createDataFrame([], "lsn long")
    verdicts = {r.id: r.verdict for r in layers.collectable(m, 25, 20, none, none).collect()}
    assert verdicts == {a[0]: "space_cutoff" if a[5] > 25 else "time_cutoff" if a[5] > 20 else "remove" if covered(a, 20) else "not_covered" for a in rows}


def test_layers_of_equal_ranges_do_not_meet_each_image(spark):
    # 20000 deltas under 20000 images of the same three key ranges: pair by pair these are over 10**8 rows.
    m = spark.range(40000).selectExpr("id", "if(id % 2 = 0, 'image', 'delta') as kind", "id % 3 as start", "id % 3 + 5 as end", "if(id % 2 = 0, 500 + id % 100, id % 100) as lsn_start", "if(id % 2 = 0, 501 + id % 100, 1 + id % 100) as lsn_end")
    made = layers.collectable(m, 700, 700, *[spark.createDataFrame([], "lsn long")] * 2)
    assert made.where("id % 2 = 1 and verdict <> 'remove'").isEmpty()
    assert joined_rows(made) < 10**6


def joined_rows(df):
    """The most rows that a join of the executed plan made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "InputAdapter"):
            todo.append(node.executedPlan() if "Adaptive" in node.getClass().getSimpleName() else node.child())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def test_reads_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.9 else rng.randint(2, 5), x, rng.random() < 0.1, f"p{x}") for x in range(3000)]
    asked = [(rng.randint(0, 6), rng.randint(-5, 3100)) for _ in range(300)]
    h, r = spark.createDataFrame(rows, "key long, lsn long, will_init boolean, payload string"), spark.createDataFrame(asked, "key long, at long").distinct()
    want = set()
    for k, t in set(asked):
        mine = [x for x in rows if x[0] == k and x[1] <= t]
        base = max((x[1] for x in mine if x[2]), default=-1)
        want |= {(k, t, x[1]) for x in mine if x[1] >= base}
    assert {(x.key, x.at, x.lsn) for x in versioned.visited(r, h).collect()} == want
    newest = {(k, t): max((x[1] for x in rows if x[0] == k and x[1] <= t), default=None) for k, t in set(asked)}
    assert {(x.key, x.at): x.found_lsn for x in versioned.as_of_join(r, h, "key", "at", "lsn", ["lsn"]).collect()} == newest


def test_order_helpers_on_skewed_keys(spark):
    from chronofold.operators import ordered

    rng = random.Random(7)
    keys = sorted({rng.randint(0, 50) if rng.random() < 0.9 else rng.randint(0, 10**12) for _ in range(3000)})
    d = spark.createDataFrame([(k, k % 7) for k in keys], "key long, v long").repartition(5)
    assert {r.key: r.next for r in ordered.with_next(d, "key").collect()} == dict(zip(keys, keys[1:] + [None]))
    sums, total = {}, 0
    for k in keys:
        total += k % 7
        sums[k] = total
    assert {r.key: r.upto for r in ordered.with_running(d, "key", {"v": "upto"}).collect()} == sums
    assert sorted(r.n for r in ordered.numbered(d, "n").collect()) == list(range(1, len(keys) + 1))


def test_wait_ends_by_progress_or_time(spark):
    rows = spark.range(5).select(F.col("id").alias("lsn"))
    assert log.wait_until(lambda: rows, 4, timeout=0) and not log.wait_until(lambda: rows, 5, timeout=0.3, every=0.1)
    calls = []

    def growing():
        calls.append(1)
        return spark.range(len(calls)).select(F.col("id").alias("lsn"))

    assert log.wait_until(growing, 2, timeout=30, every=0.01) and len(calls) == 3


def test_metering_between_ticks_on_a_stream(spark, tmp_path):
    rows = [(t, f"2024-01-01 00:{m:02d}:00", 10 * m + t) for t in (1, 2) for m in range(0, 50, 2)]
    path = str(tmp_path / "m")
    spark.createDataFrame(rows, "tenant long, ts string, value long").write.parquet(path)
    stream = spark.readStream.schema("tenant long, ts string, value long").parquet(path)
    q = log.metered(stream, "10 minutes", "1 minute").writeStream.format("memory").queryName("metered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    ticks = spark.table("metered").withColumn("at", F.unix_timestamp("start"))
    assert ticks.groupBy("tenant").count().collect() and ticks.count() == 8  # the last tick is still open
    deltas = telemetry.metered_deltas(ticks, "tenant", "at", "high")
    assert {r.delta for r in deltas.collect()} == {100} and deltas.count() == 6


def test_sliding_counts(spark):
    e = spark.createDataFrame([(u, f"2024-01-01 00:{m:02d}:30") for u, m in ((1, 1), (2, 3), (2, 9), (3, 14))], "u long, ts string")
    got = {str(r.start)[11:16]: r.n for r in log.sliding_counts(e, "u", "10 minutes", "5 minutes").collect()}
    assert got == {"23:55": 2, "00:00": 2, "00:05": 2, "00:10": 1}


def test_request_log_is_written(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(250).select("id", F.lit("GET").alias("method")).repartition(1).write.parquet(source)
    stream = spark.readStream.schema("id long, method string").parquet(source)
    q = log.request_log(stream, str(tmp_path / "out"), str(tmp_path / "c"), "1 second", 100)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 250 and len(set(out.inputFiles())) == 3


def test_bulk_copies_in_parallel(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('a "b",\n'), F.col("id").cast("string"))).alias("text"), (F.col("id") / 4).alias("x"))
    changes.copy_out(rows, str(tmp_path / "out"), 8)
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]) == 8
    back = changes.copy_in(spark, str(tmp_path / "out"), "id long, text string, x double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_import_plan(spark):
    rels = spark.createDataFrame([(1, 10), (2, 250), (3, 0), (4, 95)], "rel long, blocks long")
    jobs = changes.import_plan(rels, 100, 4).collect()
    assert all(r.blocks <= 100 for r in jobs)
    for rel, blocks in ((1, 10), (2, 250), (3, 0), (4, 95)):
        mine = sorted((r.first, r.blocks) for r in jobs if r.rel == rel)
        assert sum(n for _, n in mine) == blocks and [f for f, _ in mine] == [100 * k for k in range(len(mine))]
    assert {r.shard for r in jobs} <= set(range(4))


def test_entry_and_registry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

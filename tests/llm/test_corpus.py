"""Operators over the whole corpus, against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import ann, graph, imatch, line_dedup, mixing, near_dup, substring_dedup


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_rows():
    """Copies, chains, and a large group whose members are alike to different degrees."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, n = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "one two"), (-5, "ONE two"), (-6, "one  two three")], 0
    for edits in (1, 2, 4, 7, 12):
        base = [word() for _ in range(160)]
        for _ in range(14):
            w = list(base)
            for k in rng.sample(range(len(w)), edits):
                w[k] = word()
            rows.append((n, " ".join(w)))
            n += 1
    chain = [word() for _ in range(120)]
    for _ in range(12):  # each is near the one before only
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append((n, " ".join(chain)))
        n += 1
    for k in range(20):
        rows.append((n, " ".join(word() for _ in range(rng.randint(1, 40)))))
        n += 1
    return rows + [rows[10], (n, rows[10][1].upper())]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    want = brute_components(dict(rows).items(), 85)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("regs", F.lit("clash")).withColumn("n", F.lit(1))
    got = near_dup.near_duplicates(frame, 85).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_near_duplicates_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rows = near_rows()[:60]
    want = brute_components(dict(rows).items(), 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_duplicates_hold_bounded_blocks(spark, monkeypatch):
    """A template at a similarity of about 0.6 joins all rows by bands but links few of them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(160)]
    rows = []
    for k in range(90):
        w = list(base)
        for at in rng.sample(range(160), rng.randint(2, 5)):
            w[at] = word()
        rows.append((k, " ".join(w)))

    def guarded(percent, real=near_dup._across):
        compare = real(percent)

        def held(table):
            assert table.num_rows <= 60, table.num_rows
            return compare(table)

        return held

    monkeypatch.setattr(near_dup, "BLOCK", 10)
    monkeypatch.setattr(near_dup, "_across", guarded)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    want = brute_components(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len({c for _, c, _ in want.values()}) > 60


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).collect()] == [(None, 2, None, True)]


def test_sketch_estimates_are_close():
    rng = np.random.default_rng(5)
    for size in (3, 20, 200, 3000):
        errors = []
        for _ in range(20):
            shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (size, size // 4, size // 4))
            x, y = np.unique(np.concatenate((shared, a))), np.unique(np.concatenate((shared, b)))
            regs = near_dup.sketch(np.concatenate((x, y)), np.array([len(x), len(y)]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(near_dup.estimate(regs[0], regs[1], np.float64(len(x)), np.float64(len(y))) - true)
        assert abs(np.mean(errors)) < 0.04 and np.abs(errors).max() < 0.2


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (205, 200), (203, 205)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substrings(rows):
    first, out = {}, []
    for i, b in sorted(rows, key=lambda r: r[0]):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_substrings_equal_brute_force(spark, sf_dir, monkeypatch, hot):
    if hot:  # every gram of two documents is dealt by document too
        for name, value in (("HOT_SAMPLE", 1), ("HOT_LEAST", 2), ("HOT_SHARE", 10**9)):
            monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(100):
        x = rng.choice(["", "=" * rng.randint(0, 200), "ab" * rng.randint(0, 100), "".join(rng.choice("abc") for _ in range(rng.randint(0, 300)))])
        b, k = rng.choice(base), rng.randint(0, 250)
        rows.append((i * 3 - 50, None if rng.random() < 0.05 else x + b[k : k + rng.randint(0, 120)] + rng.choice(["", "é" * rng.randint(0, 60), "=-" * rng.randint(0, 90)])))
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").limit(60).collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lo", F.lit("clash"))
    got = substring_dedup.digest(substring_dedup.remove_repeats(frame)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_substrings([(i, (t or "").encode()) for i, t in rows])


def test_doubling_over_every_suffix(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("ab") for _ in range(200))
    rows = [(i, None if i % 9 == 0 else base[rng.randint(0, 150) :][: rng.randint(0, 90)] + "=" * rng.choice([0, 70])) for i in range(30)]
    got = {tuple(r) for r in substring_dedup.starts_by_doubling(spark.createDataFrame(rows + [rows[5]], "doc_id long, text string")).collect()}
    seen = lambda i, x: any(j < i and x in (t or "") for j, t in rows)
    assert got == {(i, k) for i, t in rows for k in range(len(t or "") - 49) if seen(i, t[k : k + 50])}


def test_substrings_without_rows_or_ids(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "x" * 80), (1, "x" * 80), (2, "x" * 80)]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 0), ("2", 80), ("None", 0)]


LINES = [(1, "a\nb\nc\nd\ne\nf\ng"), (2, "x\na\nb\nc\nd\ne\nf\ng\ny"), (2, "x\na\nb\nc\nd\ne\nf\ng\ny"), (3, None), (4, ""), (5, "\n\n\n"), (6, "\n\n\n"), (None, "a\nb\nc\nd\ne\nf\ng"), (7, "a\nb\nc\nd\ne\nf\ng"), (8, "\n".join(str(k) for k in range(3000)))]


def test_lines_equal_sql(spark):
    frame = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.drop_repeated_chunks(frame)
    assert "gone" in got.columns
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LINES)
    key = lambda r: tuple(map(str, r))
    names = ["doc_id", "text", "n_lines", "n_removed_chunks", "n_removed_lines"]
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted(con.sql(line_dedup.oracle()).select(*names).fetchall(), key=key)


def test_line_chunks_survive_shifts(spark):
    rng = random.Random(3)
    lines = [f"line {rng.random()}" for _ in range(200)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines[:100] + ["inserted"] + lines[100:]))]
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 0 and got[2] > 140


def test_mix_columns_that_clash(spark):
    frame = spark.createDataFrame([(k, "en", "src1", 5, "old") for k in range(20)], "doc_id long, lang string, source string, n_tokens long, epoch string").withColumn("domain", F.lit("d1"))
    got = mixing.choose(frame, mixing.Mix(epochs=1), F.col("n_tokens"))
    assert sorted(got.columns) == sorted(frame.columns) and {(r.n_tokens, r.epoch) for r in got.collect()} <= {(5, 0)}


def test_short_repeated_runs_go(spark):
    rng = random.Random(4)
    line = lambda: f"line {rng.random()}"
    shared = [[line() for _ in range(rng.randint(2, 9))] for _ in range(40)]
    rows, inside = [], 0
    for i in range(400):
        run = rng.choice(shared)
        inside += len(run)
        rows.append((i, "\n".join([line() for _ in range(rng.randint(1, 5))] + run + [line() for _ in range(rng.randint(0, 5))])))
    got = line_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_removed_lines")).first()[0]
    assert got >= 0.4 * inside  # what stands before and after a run hides its first or last lines
    one = line_dedup.drop_repeated_chunks(spark.createDataFrame([(1, "only"), (2, "only"), (3, "a\nb"), (4, "a\nb"), (5, "a\nb\nc"), (6, "a\nb\nc")], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed_lines for r in one.collect()} == {1: 0, 2: 0, 3: 0, 4: 2, 5: 0, 6: 3}


def test_mix_equals_sql_and_meets_weights(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)) if k % 11 else None, rng.choice(["en", "de", "fr", None]), rng.choice(["src1", "src2", "src3", "src10", "other", None])) for k in range(900)]
    rows += [(5, "w w w", "en", "src1")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    key = lambda r: tuple(map(str, r))
    for mix in (mixing.Mix(), mixing.Mix(share=0.2, epochs=1), mixing.Mix(share=5.0, epochs=3)):
        tagged = frame.withColumn("domain", mixing.domain_of(F.col("source"))).withColumn("key", F.lit("clash"))
        names = ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]
        got = sorted((tuple(r) for r in mixing.choose(tagged, mix, mixing.words_in(F.col("text"))).select(names).collect()), key=key)
        assert got == sorted(con.sql(mixing.oracle(mix)).select(*names).fetchall(), key=key)
    assert mixing.choose(tagged.limit(0), mixing.Mix(), mixing.words_in(F.col("text"))).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "y", "1", 1000), ("b", "x", "1", 1000)], "domain string, lang string, source string, tokens long")
    mix = mixing.Mix(weights=({"a": 0.5, "b": 0.5}, {}, {}), other=(0.0, 1.0, 1.0), share=0.5, epochs=1)
    got = {(r.domain, r.lang): r.budget for r in mixing.allocate(leaves, mix).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 492, ("b", "x"): 502}


def test_imatch(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "zz"), (10_002, "zz")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    words = imatch.lexicon(docs)
    rows = sorted(docs.collect(), key=lambda r: (-r.doc_id, r.text is not None, r.text or ""))
    got = sorted(imatch.compare_with_next(docs, words).collect(), key=lambda r: (-r.doc_id, r.n_chars))
    prints = {}
    assert len(got) == len(rows)
    for k, (r, g) in enumerate(zip(rows, got)):
        text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (g.doc_id, g.n_chars, g.edited_sha256) == (r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, g.fingerprint) == g.fingerprint and 0 <= g.near_next <= 1
        if edited == text:
            assert g.near_edited == 1 and g.edited_fingerprint == g.fingerprint
    long = [g for g in got if g.n_chars > 200]
    assert np.mean([g.near_edited for g in long]) > np.mean([g.near_next for g in long]) + 0.05
    assert imatch.compare_with_next(docs.limit(0), words).count() == 0


def test_imatch_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 7)
    rows = [(k * 3, f"text {k} " * (k % 9 + 1)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.edited_sha256 for r in imatch.compare_with_next(docs, imatch.lexicon(docs)).collect()}
    for k, (i, text) in enumerate(rows):
        after, half = rows[k - 1][1], len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_neighbours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    v0 = rows.where("vec_id = 0").first().embedding
    odd = spark.createDataFrame([(90_000, None), (90_020, [0.0] * 64), (90_040, [float("nan")] * 64), (90_060, [None] + v0[1:]), (None, v0), (90_080, v0), (90_100, v0), (90_101, [1.0, 2.0])], rows.schema)
    rows = rows.unionByName(odd)
    got = ann.nearest(rows, rows.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    good = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        assert all(r.score == pytest.approx(score[ids == r.vec_id][0], abs=1e-12) for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(ids[order].tolist())), total + 20
    assert hits >= 0.9 * total and {r.query_id for r in got} == {int(q) for q in ids[ids % 20 == 0]}
    assert ann.nearest(rows.limit(0), rows, 20).count() == 0
    assert ann.nearest(rows.where("vec_id < 5"), rows.where("vec_id = 0"), 20).count() == 4


def test_pruned_graph_in_one_shard():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    graph_, entry = ann.build_graph(x)
    assert (graph_ >= 0).sum(axis=1).max() <= ann.DEGREE
    found, _ = ann.beam_search(x, graph_, entry, x[:100], 50)
    true = np.argsort(((x[:100, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(true, found)]) > 0.95

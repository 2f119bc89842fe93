"""Near-duplicate documents by HyperMinHash, confirmed on whole shingle sets.

1. *Sketch*: each document's distinct five-word shingles fill ``BUCKETS`` buckets with the smallest hash
   that falls into each (rounds of fresh hashes fill buckets that stay empty in short texts). A
   register keeps the minimum's leading-zero count and ``MANTISSA`` bits after it: 16 bits.
2. *Classes*: documents of equal shingle sets are one class from here on, so groups of copies
   never meet as pairs.
3. *Banding*: classes that agree in all registers of a band are candidates. In each band's group every class is
   compared with the group's smallest only; compressed registers give a Jaccard estimate,
   corrected for registers that collide by chance, and what is clearly below the threshold goes.
4. *Verification* compares the whole sets of what remains: 100 * shared >= percent * union.
5. *The rest, exactly*: classes connected by shared bands form clusters. Where verification left several
   components in a cluster, every class outside its largest component is compared with the classes of the
   others, first by registers and then by whole sets. Both sides are dealt into blocks of bounded size, and a task
   holds one block against one other; only links that join components leave it. So every candidate pair has been
   compared or is connected already, without listing all pairs of a group.

With 25 bands of 5 registers a pair at similarity 0.85 is missed with probability 5e-7.

Defined results: null, empty and blank texts have no shingles and link with nothing; equal sets
always link; rows that repeat a doc_id get the same answer if their texts are equal; a null
doc_id never becomes a component's id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import arrow_map, cut, mix64
from chronofold.llm.graph import components
from chronofold.llm.shingles import shingle_sets

BANDS, ROWS = 25, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
VALUE_BITS = 40
ROUNDS = 12
#: An estimate below the threshold by this (over five standard errors) rules a candidate out.
SLACK = 0.22
#: Rows, and shingles of all of them, on each side of what one task compares at once.
BLOCK = 2000
BLOCK_SHINGLES = 2_000_000
#: Parts that a cluster's rows are dealt into where they meet the cluster's figures.
PARTS = 64


def sketch(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers, a row a document, from the documents' distinct hashes one after another."""
    n = len(sizes)
    empty = np.uint64(2**64 - 1)
    regs = np.full(n * BUCKETS, empty)
    row = np.repeat(np.arange(n), sizes)
    h = hashes
    mask = np.uint64((1 << VALUE_BITS) - 1)
    for r in range(ROUNDS):
        if not len(h):
            break
        x = mix64(h, 100 + r)
        bucket = ((x >> np.uint64(VALUE_BITS)) * np.uint64(BUCKETS)) >> np.uint64(64 - VALUE_BITS)
        np.minimum.at(regs, row * BUCKETS + bucket.astype(np.int64), (x & mask) | np.uint64(r << VALUE_BITS))
        unfilled = (regs.reshape(n, BUCKETS) == empty).any(axis=1)
        stay = unfilled[row]
        if not stay.any():
            h = h[:0]
            break
        h, row = h[stay], row[stay]
    if len(h):  # what is still empty gets the smallest of all hashes made for that bucket
        grid = regs.reshape(n, BUCKETS)
        docs, starts = np.unique(row, return_index=True)
        for k in range(BUCKETS):
            need = grid[docs, k] == empty
            if need.any():
                low = np.minimum.reduceat(mix64(h, 1000 + k) & mask, starts) | np.uint64(ROUNDS << VALUE_BITS)
                grid[docs[need], k] = low[need]
    value = regs & mask
    rounds = (regs >> np.uint64(VALUE_BITS)).astype(np.uint64)
    exponent = np.where(value > 0, np.frexp(value.astype(np.float64))[1], 0)  # bits in use; exact below 2**53
    zeros = VALUE_BITS - exponent
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (value >> shift) & np.uint64((1 << MANTISSA) - 1)
    packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    packed ^= mix64(rounds, 5) * (rounds > 0)
    return (packed & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, BUCKETS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, which holds the band's number."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix64(out ^ (parts[:, :, k] << np.uint64(8)), k)
    return out.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the collisions expected of different minima."""
    share = (a == b).mean(axis=-1)
    ratio = 4.0 * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2
    chance = 0.1699 * ratio * 2.0**-MANTISSA
    return (share - chance) / (1 - chance)


def _signatures(batch: dict) -> dict:
    n, key, regs, bands = [], [], [], []
    for _, hashes, sizes in shingle_sets(batch["text"]):
        got = sketch(hashes, sizes)
        ends = np.cumsum(sizes)
        n.append(sizes)
        key += [hashlib.blake2b(hashes[e - s : e].tobytes(), digest_size=16).digest() if s else None for e, s in zip(ends.tolist(), sizes.tolist())]
        regs += [g.tobytes() for g in got]
        bands.append(band_keys(got))
    flat = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.int64)
    return {"doc_id": batch["doc_id"], "n": pa.array(np.concatenate(n)), "set_key": key, "regs": regs, "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * BANDS, pa.int32()), pa.array(flat.ravel()))}


def _packed_sets(batch: dict) -> dict:
    out = []
    for _, hashes, sizes in shingle_sets(batch["text"]):
        ends = np.cumsum(sizes)
        out += [hashes[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist())]
    return {"rep": batch["rep"], "words": out}


def near(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` of their union."""
    if len(p) > len(q):
        p, q = q, p
    if 100 * len(p) < percent * len(q):
        return False
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    shared = int((q[at] == p).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _verifier(percent: int):
    def verify(batch: dict) -> dict:
        good = [near(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch["wa"], batch["wb"])]
        return {"a": batch["a"], "b": batch["b"], "good": good}

    return verify


def _passing(percent: int):
    def keep(batch: dict) -> dict:
        a = np.frombuffer(b"".join(batch["ra"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        b = np.frombuffer(b"".join(batch["rb"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        e = estimate(a, b, batch["na"].to_numpy().astype(float), batch["nb"].to_numpy().astype(float))
        return {"a": batch["a"], "b": batch["b"], "good": e >= percent / 100 - SLACK}

    return keep


def _across(percent: int):
    """Links that join different components, from one block of a cluster against one other: no more than connect them.

    A row of the left block, all outside the cluster's main component, is compared with the rows of the right one
    by registers, and by whole sets where the estimate passes and nothing found here links them yet.
    """

    def compare(table):
        comps, n, block = (table.column(c).to_numpy() for c in ("comp", "n", "block"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        words = [np.frombuffer(w.as_buffer(), np.uint64) for w in table.column("words")]
        outside = table.column("outside").to_numpy(zero_copy_only=False)
        here = np.flatnonzero(block == table.column("right")[0].as_py())
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                up[c] = c = up.get(up[c], up[c])
            return c

        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(outside & (block == table.column("left")[0].as_py())):
            e = estimate(regs[i][None, :], regs[here], n[i].astype(float), n[here].astype(float))
            for j in here[(e >= percent / 100 - SLACK) & (comps[here] != comps[i])].tolist():
                x, y = root(int(comps[i])), root(int(comps[j]))
                if x != y and near(words[i], words[j], percent):
                    up[max(x, y)] = min(x, y)
                    out.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return compare


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of mixed clusters, each once for every (left, right) pair of blocks that compares it.

    Blocks 0 to o - 1 hold the classes outside the main component, blocks o to o + m - 1 those of it; a small
    cluster is block 0. Left is a block of the first kind, right the same or a later block.
    """
    blocks = lambda size, weight: F.ceil(F.greatest(size / BLOCK, weight / BLOCK_SHINGLES)).cast("int")
    at = rows.withColumn("outside", F.col("comp") != F.col("main.comp"))
    small = blocks(F.col("size"), F.col("weight")) == 1
    at = at.withColumn("o", F.when(small, 1).otherwise(blocks(F.col("size") - F.col("main.c"), F.col("weight") - F.col("main.w"))))
    at = at.withColumn("m", F.when(small, 0).otherwise(blocks(F.col("main.c"), F.col("main.w"))))
    home = F.when(F.col("m") == 0, 0).when(F.col("outside"), F.pmod(F.xxhash64("rep"), F.col("o"))).otherwise(F.col("o") + F.pmod(F.xxhash64("rep"), F.col("m")))
    at = at.withColumn("block", home.cast("int"))
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
    as_left = F.transform(F.sequence(F.col("block"), F.col("o") + F.col("m") - 1), lambda j: pair(F.col("block"), j))
    as_right = lambda last: F.transform(F.filter(F.sequence(F.lit(0), F.col("o") - 1), lambda i: i < last), lambda i: pair(i, F.col("block")))
    pairs = F.when(F.col("m") == 0, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("outside"), F.concat(as_left, as_right(F.col("block")))).otherwise(as_right(F.col("o")))
    return at.withColumn("p", F.explode(pairs)).select("cluster", "p.left", "p.right", "block", "comp", "n", "regs", "words", "outside")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; see the module's text."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(arrow_map(docs, _signatures, "doc_id bigint, n bigint, set_key binary, regs binary, bands array<bigint>"), "sketches")
    classes = cut(signed.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("size")).where("size > 1").select("band", "a")
    first = cut(banded.join(heads, "band").where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "candidates")
    clusters = components(first).toDF("rep", "cluster")
    # Texts move once, by a join that shuffles at every size, so that cost grows in proportion.
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(clusters.select("rep").hint("merge"), "rep")
    sets = cut(arrow_map(texts, _packed_sets, "rep bigint, words binary").dropDuplicates(["rep"]), "sets")

    facts = classes.select("rep", "n", "regs")
    rated = first.join(facts.toDF("a", "na", "ra"), "a").join(facts.toDF("b", "nb", "rb"), "b")
    passed = cut(arrow_map(rated.select("a", "b", "na", "nb", "ra", "rb"), _passing(percent), "a bigint, b bigint, good boolean").where("good").select("a", "b"), "passed")
    both = passed.join(sets.toDF("b", "wb"), "b").join(sets.toDF("a", "wa"), "a").select("a", "b", "wa", "wb")
    labels = components(arrow_map(both, _verifier(percent), "a bigint, b bigint, good boolean").where("good").select("a", "b"))

    # Clusters of candidates that still hold several components.
    placed = cut(clusters.join(labels.toDF("rep", "root"), "rep", "left").join(classes.select("rep", "n"), "rep").select("cluster", "rep", "n", F.coalesce("root", "rep").alias("comp")), "placed")
    per_comp = placed.groupBy("cluster", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    mixed = per_comp.groupBy("cluster").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("c", "comp", "w")).alias("main")).where("comps > 1")
    # Dealt by part of a cluster too: one cluster may hold a good share of all classes.
    parts = mixed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parted = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS)).cast("int"))
    rows = parted.join(parts, ["cluster", "part"]).drop("part").join(facts.select("rep", "regs"), "rep").join(sets, "rep")
    late = _dealt(rows).groupBy("cluster", "left", "right").applyInArrow(_across(percent), "a bigint, b bigint")
    roots = components(late)
    up = roots.toDF("root", "up")
    final = placed.withColumnRenamed("comp", "root").join(up, "root", "left").select("rep", F.coalesce("up", "root").alias("root"))
    of_class = classes.select("set_key", "rep").join(final, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n", "set_key").join(of_class, "set_key", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))

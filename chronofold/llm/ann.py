"""Nearest neighbours by largest inner product, over robust-pruned directed graphs in shards.

*Index.* Equal vectors are one node (with its smallest ids, enough for any answer). Nodes are dealt by hash into
shards of about ``SHARD`` nodes; each shard builds its own graph: points are inserted in batches, a
greedy search from the medoid proposes neighbours, and pruning keeps a neighbour only if no kept
one is closer to it by the factor 1 / ``ALPHA``, so that edges stay diverse; reverse edges are
pruned alike. Inner products become distances by one more coordinate that makes all norms equal.

Each shard is built in a task of its own: the number of tasks is given, so Spark does not merge them.

*Search.* Query blocks meet every shard; a beam search walks each graph, its candidates are scored again in double precision on
the original vectors, and a ranked window over the query merges the shards' best.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part; vectors of different lengths never meet; ties go to the smaller id;
of rows that repeat an id and a vector one is a candidate; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import cut
from chronofold.session import ship

SHARD = 4000
QUERY_BLOCK = 1024
DEGREE = 32
LIST = 72
SEARCH_LIST = 96
ALPHA = 1.2
WIDTH = 4  # nodes expanded at once in a search
BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` nearest found for each query, nearest first: their numbers (-1: none) and squared distances less |q|^2."""
    n_q, rows = len(queries), np.arange(len(queries))[:, None]
    sq = np.einsum("ij,ij->i", x, x)
    ids = np.full((n_q, size), -1, np.int64)
    dist = np.full((n_q, size), np.inf, np.float32)
    done = np.ones((n_q, size), bool)
    seen = np.zeros((n_q, len(x)), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = sq[entry] - 2 * queries @ x[entry]
    while True:
        open_ = np.where(done, np.inf, dist)
        pick = np.argpartition(open_, WIDTH, axis=1)[:, :WIDTH]
        fresh = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not fresh.any():
            return ids, dist
        live = np.flatnonzero(fresh.any(axis=1))
        pick, fresh, at = pick[live], fresh[live], live[:, None]
        done[at, pick] = True
        near = graph[np.where(fresh, ids[at, pick], 0)]
        near[~fresh] = -1
        near = near.reshape(len(live), -1)
        near.sort(axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[at, np.maximum(near, 0)]
        seen[np.broadcast_to(at, near.shape)[new], near[new]] = True
        d = np.full(near.shape, np.inf, np.float32)
        q_of = np.broadcast_to(at, near.shape)[new]
        d[new] = sq[near[new]] - 2 * np.einsum("ij,ij->i", queries[q_of], x[near[new]])
        all_d = np.concatenate((dist[live], d), axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :size]
        ids[live] = np.take_along_axis(np.concatenate((ids[live], np.where(new, near, -1)), axis=1), order, 1)
        done[live] = np.take_along_axis(np.concatenate((done[live], ~new), axis=1), order, 1)
        dist[live] = np.take_along_axis(all_d, order, 1)
    return ids, dist


def robust_prune(x: np.ndarray, point: int, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE of the candidates, diverse, nearest first."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != point)])
    if not len(candidates):
        return candidates
    c = x[candidates]
    d_point = ((c - x[point]) ** 2).sum(axis=1)
    order = np.argsort(d_point, kind="stable")
    candidates, c, d_point = candidates[order], c[order], d_point[order]
    sq = np.einsum("ij,ij->i", c, c)
    between = ALPHA * ALPHA * (sq[:, None] + sq[None, :] - 2 * c @ c.T)
    alive, kept = np.ones(len(candidates), bool), []
    while len(kept) < DEGREE and alive.any():
        k = int(alive.argmax())
        kept.append(k)
        alive &= between[k] > d_point
        alive[k] = False
    return candidates[kept]


def build_graph(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, int]:
    """The neighbours of each vector (-1 fills) and the entry, the vector nearest to the mean."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, DEGREE), -1, np.int64)
    if n <= DEGREE + 1:
        for k in range(n):
            graph[k, : n - 1] = np.delete(np.arange(n), k)
        return graph, entry
    order = rng.permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    at, step = 1, 8
    while at < n:
        points = order[at : at + step]
        found, _ = beam_search(x, graph, entry, x[points], LIST)
        back: dict[int, list[int]] = {}
        for row, p in enumerate(points):
            kept = robust_prune(x, p, np.concatenate((found[row], points) if at < 512 else (found[row],)))
            graph[p] = -1
            graph[p, : len(kept)] = kept
            for k in kept.tolist():
                back.setdefault(k, []).append(int(p))
        for node, more in back.items():
            have = graph[node]
            free = np.flatnonzero(have < 0)
            more = [m for m in more if m not in have]
            if len(more) <= len(free):
                graph[node, free[: len(more)]] = more
            else:
                kept = robust_prune(x, node, np.concatenate((have, more)))
                graph[node] = -1
                graph[node, : len(kept)] = kept
        at += step
        step = min(BATCH, step * 2, max(8, at // 2))
    return graph, entry


def _lifted(v: np.ndarray) -> np.ndarray:
    """One more coordinate, so that nearest by distance is largest by inner product."""
    norms = np.einsum("ij,ij->i", v, v)
    lifted = np.sqrt(np.maximum(norms.max() - norms, 0))
    return np.concatenate((v, lifted[:, None]), axis=1).astype(np.float32)


def _build(table):
    raw = table.column("v").combine_chunks()
    dim = len(raw[0])
    v = raw.flatten().to_numpy().reshape(-1, dim)
    graph, entry = build_graph(_lifted(v))
    ids = table.column("ids").to_pylist()
    counts = np.array([len(i) for i in ids], np.int32)
    out = {"dim": [dim], "shard": [table.column("shard")[0].as_py()], "vectors": [v.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entry": [entry], "counts": [counts.tobytes()], "ids": [np.array([j for i in ids for j in i], np.int64).tobytes()]}
    return pa.table(out, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("graph", pa.binary()), ("entry", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())]))


def _searcher(k: int, kind: type):
    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(c)[i].as_py() for c, n in enumerate(b.schema.names)}
                dim = row["dim"]
                v = np.frombuffer(row["vectors"], kind).reshape(-1, dim)
                x = _lifted(v)
                graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE).astype(np.int64)
                counts, ids = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int64)
                first = np.concatenate(([0], np.cumsum(counts)))
                q = np.array(row["qv"], kind).reshape(-1, dim)
                lifted = np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(np.float32)
                found, _ = beam_search(x, graph, row["entry"], lifted, max(SEARCH_LIST, k + 1))
                out_q, out_v, out_s = [], [], []
                for r, qid in enumerate(row["qids"]):
                    nodes = found[r][found[r] >= 0]
                    score = (v[nodes].astype(np.float64) * q[r].astype(np.float64)).sum(axis=1)
                    many = counts[nodes]
                    cand = ids[np.repeat(first[nodes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    score = np.repeat(score, many)
                    keep = cand != qid
                    cand, score = cand[keep], score[keep]
                    top = np.lexsort((cand, -score))[:k]
                    out_q += [qid] * len(top)
                    out_v.append(cand[top])
                    out_s.append(score[top])
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], names=["query_id", "vec_id", "score"])

    return search


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)  # floats as they are, anything else as doubles: scores are of the original numbers
    if rows.schema[vec_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    return rows.where(fine).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))


def build_index(rows: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """One row a shard: its vectors, ids and graph; a cut table."""
    usable = _usable(rows, id_col, vec_col)
    # The k + 1 smallest ids of a vector answer any query; the ranked filter keeps no more of a group on either side of the shuffle.
    few = usable.dropDuplicates(["v", "vec_id"]).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "nodes")
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    n_shards = sizes.agg(F.sum("shards")).first()[0] or 1
    # A few tasks a shard where there are few, so that hardly two shards meet in one; a shard a task in the mean where there are many.
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), "shards").cast("int")).repartition(max(n_shards, min(8 * n_shards, 2000)), "dim", "shard")
    ship(rows.sparkSession)
    return cut(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, vectors binary, graph binary, entry int, counts binary, ids binary"), "index")


def search(index: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest found."""
    q = _usable(queries, id_col, vec_col).dropDuplicates().withColumn("dim", F.size("v"))
    n_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    blocks = q.groupBy("dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).alias("block")).agg(F.collect_list("vec_id").alias("qids"), F.flatten(F.collect_list("v")).alias("qv"))
    shards = index.select("dim", "shard")
    tasks = blocks.join(shards, "dim")  # the stated queries, in blocks, against every shard
    work = tasks.join(index, ["dim", "shard"]).repartition(F.col("dim"), F.col("shard"), F.col("block"))
    ship(index.sparkSession)
    kind = np.float32 if q.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    found = work.mapInArrow(_searcher(k, kind), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Index all of ``rows`` and search it for ``queries``."""
    return search(build_index(rows, id_col, vec_col, k), queries, id_col, vec_col, k)

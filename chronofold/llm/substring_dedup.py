"""Removal of repeated substrings by distributed prefix doubling over sampled suffixes.

A 50-byte string that already starts in a document with a smaller doc_id is removed, byte by byte. Doubling
over every suffix is :func:`starts_by_doubling`; it moves every position several times, which the README gives figures
for, so :func:`remove_repeats` doubles over fewer:

* the first rank is that of the first ``GRAM`` bytes (a 64-bit name made where the text is), and
* only *sampled* suffixes are sorted: of the ``WINDOW`` grams inside each 50-byte string, the one with
  the least name (the leftmost on ties). The choice depends on the string alone, so equal strings sample
  the same offset, and comparing sampled suffixes compares all strings.

Each sampled suffix stands for the run of 50-byte strings that chose it. Spark sorts rows
(rank of the gram, rank of the whole run's bytes, doc_id, position):

1. *Offset 0*: a gram that is unique to a document is done: nothing of its run repeats.
2. *Past the threshold*: where the bytes of the whole run (50 to ``50 + WINDOW - 1``) are equal, all its strings
   repeat in every document but the first.
3. *Doubling*: runs that share the gram but not all bytes - where a repeat begins or ends - are reranked string
   by string: the pair (rank of the first 25 bytes, rank of the 25 at offset +25) of each of their
   strings, for the first document of each run only, as the others are settled.

What 2 and 3 find is merged into byte runs for each document. A gram that a share of all documents holds would fill one
task: such *hot* grams are found in a sample of documents and their rows are dealt by document too, into
``SALTS`` parts. A part settles all but its first document of each run; those go on to a join that
Spark can split. The sample decides only how rows are dealt, never what is found. Runs of equal bytes ("=====") are
folded into one row. Names are 104 bits wide when equality decides: 64 of the gram and 40 of the run, or 64 and 40 of
the two ranks of a string; the other 24 bits of that word hold a run's length or a position's low bits.

Defined results: null texts are empty; rows that repeat a doc_id are one document's texts: they
never repeat each other; rows without a doc_id are compared with nothing and stay whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import arrow_map, cut, drop_cuts, mix64
from chronofold.llm.shingles import _powers, text_bytes

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
MORE_BITS = 24  # of a run's length, beside the 40 bits of its name
AT_BITS = 24  # of a string's position, beside the 40 bits of its second rank; the higher ones have a column
CHUNK_BYTES = 4 << 20
#: One document in so many is looked at for hot grams: those of over 1 / HOT_SHARE of a partition's rows.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST = 64, 20, 32
SALTS = 256
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix64(np.arange(256, dtype=np.uint64), 321)


class Named:
    """Names of the substrings of some bytes, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTES):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * _powers(n, _BASE), out=self.sums[1:])
        self.inverse = _powers(n + 1, _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return mix64((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + np.uint64(size))


def sampled(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one after another (``ends``: where each ends): gram names, run names, text numbers, first and last string start of each run."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    named = Named(data)
    grams = named.all(GRAM)
    # The least of each WINDOW grams, leftmost on ties: keys are unique by position in their low bits.
    m = n - LENGTH + 1
    least, at = grams.copy(), np.arange(len(grams), dtype=np.int32)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        right = least[step:] < least[:-step]
        at[:-step] = np.where(right, at[step:], at[:-step])
        least[:-step] = np.where(right, least[step:], least[:-step])
        span += step
    chosen = at[:m].astype(np.int64)
    text = np.searchsorted(ends, np.arange(0, m), "right")
    fits = np.arange(m) + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
    starts = np.flatnonzero(fits)
    if not len(starts):
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    c, t = chosen[starts], text[starts]
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1]))))
    last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
    lo, hi, anchor, t = starts[first], starts[last], c[first], t[first]
    run = mix64(named.of(lo, hi + LENGTH) + (anchor - lo).astype(np.uint64), 3) >> np.uint64(24)
    gram = grams[anchor]
    # Fold a run that follows an equal one of the same text.
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (run[1:] != run[:-1]) | (t[1:] != t[:-1]) | (lo[1:] != hi[:-1] + 1)))
    at_new = np.flatnonzero(new)
    at_last = np.concatenate((at_new[1:] - 1, [len(lo) - 1]))
    return gram[at_new], run[at_new].astype(np.int64), t[at_new], lo[at_new], hi[at_last]


def _pieces(offsets: np.ndarray):
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1))
        yield lo, hi
        lo = hi


def _salts(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64), 11) % np.uint64(SALTS)).astype(np.int16) + np.int16(1)


def _sampler(hot: np.ndarray):
    """Rows of sampled suffixes; ``salt`` is 0, or the document's part where the gram is one of ``hot``."""

    def sample(batch: dict) -> dict:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch["text"])
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b in _pieces(offsets):
            base = offsets[a]
            gram, run, t, lo, hi = sampled(data[base : offsets[b]], offsets[a + 1 : b + 1] - base)
            text_start = offsets[a:b][t] - base
            for c, v in zip(cols, (gram.view(np.int64), run, ids[a:b][t], lo - text_start, hi - lo)):
                c.append(v)
        g, r, d, lo, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        parts = (n >> MORE_BITS) + 1  # a folded run too long for its bits is several
        if (parts > 1).any():
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            g, r, d, lo, n = (np.repeat(c, parts) for c in (g, r, d, lo, n))
            lo, n = lo + (k << MORE_BITS), np.minimum(n - (k << MORE_BITS), (1 << MORE_BITS) - 1)
        g, d = g.astype(np.int64), d.astype(np.int64)
        salt = np.zeros(len(g), np.int16)
        if len(hot):
            at = np.searchsorted(hot, g)
            at[at == len(hot)] = 0
            k = np.flatnonzero(hot[at] == g)
            salt[k] = _salts(d[k])
        return {"gram": pa.array(g), "run_more": pa.array(r.astype(np.int64) << MORE_BITS | n), "doc_id": pa.array(d), "lo": pa.array(lo.astype(np.int32)), "salt": pa.array(salt)}

    return sample


def _lists(column: pa.Array, fields: tuple[str, ...] = ("lo", "more")) -> tuple[np.ndarray, np.ndarray]:
    """The (lo, more) pairs of a list column, and each row's offset among them."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten()
    first = offsets[0]
    return np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in fields], axis=1), offsets - first


def _strings(batch: dict) -> dict:
    """The 50-byte strings of runs, as pairs of ranks of 25 bytes at offsets 0 and +25; the latter shares its word with the position."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    half = LENGTH // 2
    data, offsets = text_bytes(batch["text"])
    pairs, at = _lists(batch["runs"], ("lo", "more", "hot"))
    for i, doc_id in enumerate(batch["doc_id"].to_pylist()):
        runs = pairs[at[i] : at[i + 1]]
        text = data[offsets[i] : offsets[i + 1]]
        lo, n = runs[:, 0], runs[:, 1] + 1
        fine = lo + n - 1 + LENGTH <= len(text)  # a repeated doc_id's other text may be shorter
        lo, n, hot = lo[fine], n[fine], runs[fine, 2]
        if not len(lo):
            continue
        s, k = np.unique(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), return_index=True)
        named = Named(text)
        out[0].append(named.of(s, s + half))
        out[1].append(named.of(s + half, s + LENGTH))
        out[2].append(np.full(len(s), doc_id, np.int64))
        out[3].append(s)
        out[4].append(np.repeat(hot, n)[k])
    a, b, d, s, hot = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    low = (1 << AT_BITS) - 1
    return {"salt": pa.array(np.where(hot > 0, _salts(d), np.int16(0))), "r0": pa.array(a.view(np.int64)), "r25_at": pa.array((b.view(np.int64) & ~low) | (s & low)), "doc_id": pa.array(d), "far": pa.array((s >> AT_BITS).astype(np.int32))}


def _cover(batch: dict) -> dict:
    """Remove the byte runs; ``gone`` lists (first string, how many more strings)."""
    out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
    data, offsets = text_bytes(batch["text"])
    pairs, at = _lists(batch["gone"])
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]]
        n_removed = n_spans = 0
        kept = text
        runs = pairs[at[i] : at[i + 1]]
        if len(runs) and len(text):
            runs = runs[runs.sum(axis=1) + LENGTH <= len(text)]
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, runs[:, 0], 1)
            np.add.at(edge, runs.sum(axis=1) + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_removed = int(gone.sum())
            n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = text[~gone]
        out["kept"].append(kept.tobytes())
        out["n_bytes"].append(len(text))
        out["n_removed"].append(n_removed)
        out["n_spans"].append(n_spans)
    return {"doc_id": batch["doc_id"]} | out


def _as_runs() -> Column:
    return F.sort_array(F.collect_list(F.struct("lo", "more")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept`` (the remaining bytes), ``n_bytes, n_removed, n_spans`` for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _shared_runs(docs)
    doubled = _repeated_strings(docs, found)
    gone = found.where("settled").select("doc_id", "lo", "more").unionByName(doubled)
    runs = cut(gone.groupBy("doc_id").agg(_as_runs().alias("gone")), "runs")
    drop_cuts(spark, found, doubled)
    return arrow_map(docs.join(runs.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone"), _cover, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


_ROWS = "gram bigint, run_more bigint, doc_id bigint, lo int, salt smallint"


def _hot_grams(docs: DataFrame) -> np.ndarray:
    """Sorted names of grams that hold a good part of a partition's rows; at most HOT_SHARE a partition."""
    few = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HOT_SAMPLE)) == 0)
    counts = cut(arrow_map(few, _sampler(np.zeros(0, np.int64)), _ROWS).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = counts.where(F.col("n") >= max(HOT_LEAST, total / (HOT_SHARE * parts))).select("gram").toArrow().column("gram").to_numpy()
    drop_cuts(docs.sparkSession, counts)
    return np.sort(names)


def _shared_runs(docs: DataFrame) -> DataFrame:
    """Runs whose gram several documents share: settled by equality of the whole run, or open; ``hot`` is 1 for those of hot grams."""
    docs = docs.where("doc_id is not null")
    rows = arrow_map(docs, _sampler(_hot_grams(docs)), _ROWS)
    by_gram, by_run = Window.partitionBy("gram", "salt"), Window.partitionBy("gram", "salt", "run")
    hot = F.col("salt") > 0
    ranked = rows.withColumn("first_of_gram", F.min("doc_id").over(by_gram)).withColumn("last_of_gram", F.max("doc_id").over(by_gram))
    ranked = ranked.where(hot | (F.col("first_of_gram") < F.col("last_of_gram")))  # the others are unique to a document
    ranked = ranked.withColumn("run", F.shiftrightunsigned("run_more", MORE_BITS)).withColumn("more", F.col("run_more").bitwiseAND(F.lit((1 << MORE_BITS) - 1)).cast("int"))
    ranked = ranked.withColumn("mixed", F.min("run").over(by_gram) != F.max("run").over(by_gram)).withColumn("first_of_run", F.min("doc_id").over(by_run))
    settled = F.col("doc_id") > F.col("first_of_run")
    pending = hot & ~settled  # the first document of a run in its part: what the other parts hold decides
    found = cut(ranked.where(settled | F.col("mixed") | pending).select("doc_id", "lo", "more", settled.alias("settled"), F.when(pending, F.col("gram")).alias("gram"), F.when(pending, F.col("run")).alias("run")), "suffixes")
    asked = found.where("gram is not null")
    of_run = asked.groupBy("gram", "run").agg(F.min("doc_id").alias("first_of_run"), F.max("doc_id").alias("last"))
    of_gram = of_run.groupBy("gram").agg(F.min("first_of_run").alias("first_of_gram"), F.max("last").alias("last_of_gram"), (F.min("run") != F.max("run")).alias("mixed")).where("first_of_gram < last_of_gram")
    facts = cut(of_run.drop("last").join(of_gram.select("gram", "mixed"), "gram"), "hot")
    late = asked.join(facts.hint("merge"), ["gram", "run"]).where(settled | F.col("mixed"))
    late = cut(late.select("doc_id", "lo", "more", settled.alias("settled"), F.lit(1).alias("hot")), "suffixes")
    drop_cuts(docs.sparkSession, facts)
    return found.where("gram is null").select("doc_id", "lo", "more", "settled", F.lit(0).alias("hot")).unionByName(late)


def _repeated_strings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The doubling step over open runs: starts of strings that an earlier document holds; a cut table."""
    open_ = found.where("not settled").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "more", "hot"))).alias("runs"))
    pairs = arrow_map(docs.join(open_.hint("merge"), "doc_id").select("doc_id", "text", "runs"), _strings, "r0 bigint, r25_at bigint, doc_id bigint, far int, salt smallint")
    r25 = F.shiftrightunsigned("r25_at", AT_BITS)
    # Dealt by the pair of ranks before the second is unpacked, so that rows stay narrow.
    pairs = pairs.repartition("r0", r25, "salt").withColumn("r25", r25)
    at = F.shiftleft("far", AT_BITS) + F.col("r25_at").bitwiseAND(F.lit((1 << AT_BITS) - 1)).cast("int")
    first = F.min("doc_id").over(Window.partitionBy("r0", "r25", "salt"))
    repeats = F.col("doc_id") > F.col("first")
    seen = pairs.withColumn("first", first).where(repeats | (F.col("salt") > 0)).select("doc_id", at.alias("lo"), F.when(~repeats, F.col("r0")).alias("r0"), F.when(~repeats, F.col("r25")).alias("r25"))
    kept = cut(seen, "doubled")
    # Of a string of hot grams, each part's first document: SALTS at most, and one of them has no earlier one.
    last = kept.where("r0 is not null").withColumn("first", F.min("doc_id").over(Window.partitionBy("r0", "r25"))).where("doc_id > first")
    return kept.where("r0 is null").unionByName(cut(last.drop("first"), "doubled")).select("doc_id", "lo", F.lit(0).alias("more"))


def starts_by_doubling(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, lo``: where strings of ``length`` bytes start that an earlier document holds, by doubling over every suffix.

    Ranks of one byte become ranks of 2, 4, ... bytes and at last of ``length``: Spark joins each position's rank with that of the
    position at the offset, sorts the pairs, and gives equal pairs one rank, the first place that has it. Positions whose
    rank no other document has are unique and leave. Exact, without names; every position moves twice a round. Of rows that repeat a doc_id one counts.
    """

    def places(batch: dict) -> dict:
        data, offsets = text_bytes(batch["text"])
        n = np.diff(offsets)
        ids = np.repeat(batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return {"doc_id": pa.array(ids), "lo": pa.array(at), "rank": pa.array(data[offsets[0] : offsets[-1]].astype(np.int64))}

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"])
    ranks = arrow_map(texts, places, "doc_id bigint, lo bigint, rank bigint").select("doc_id", "lo", F.struct(F.lit(-1).cast("bigint").alias("doc_id"), F.col("rank").alias("lo")).alias("rank"))
    size = 1
    while size < length:
        step = min(size, length - size)
        there = ranks.select("doc_id", (F.col("lo") - step).alias("lo"), F.col("rank").alias("next"))
        same = Window.partitionBy("rank", "next")
        paired = ranks.join(there.hint("merge"), ["doc_id", "lo"]).withColumn("first", F.min(F.struct("doc_id", "lo")).over(same)).withColumn("last", F.max("doc_id").over(same))
        ranks = cut(paired.where("first.doc_id < last").select("doc_id", "lo", F.col("first").alias("rank")), f"ranks{size + step}")
        size += step
    return ranks.where("doc_id > rank.doc_id").select("doc_id", "lo")


def digest(kept: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

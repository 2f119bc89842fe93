"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band, as a share of all documents:
``LOW`` to ``HIGH``. As the shares sum to the mean number of distinct terms of a document, there
are at most mean / LOW such terms, however large the corpus; that bound is checked before the
lexicon is broadcast. A text keeps its distinct lexicon terms, sorted; each of ``LEVELS`` x
``SUBSETS`` randomised sub-lexicons, of shrinking density, hashes those it contains into 16 bits.
The fingerprint is the hexadecimal list of these hashes.

The likeness of two fingerprints is the share of equal hashes among the sub-lexicons that hold a
term of either text, at the sparsest level where at least half of them do: long texts are
compared by sparse sub-lexicons and short ones by dense, so that partial edits show as shares.

Defined results: equal texts have equal fingerprints and likeness 1; a text with no lexicon
term gets a hash of the whole text instead, which is only like itself; null texts count as
empty. Terms are runs of bytes other than ASCII white space, A-Z as a-z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import arrow_map, mix64
from chronofold.llm.shingles import chunks, text_bytes, word_hashes
from chronofold.session import ship

LOW, HIGH = 0.001, 0.1
LEVELS, SUBSETS = 4, 16
#: Log2 of how few terms a sub-lexicon of each level takes: 1 in 4, 16, 64, 256.
SPARSITY = (2, 4, 6, 8)
ENOUGH = SUBSETS // 2
#: Documents in one range of ids, for pairing each with the next.
RANGE = 1000
MAX_RANGES = 10_000


def _distinct_terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ranges of rows: their distinct term hashes, sorted within a row, and each row's count."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        words, counts = word_hashes(data, offsets[lo : hi + 1])
        ends = np.cumsum(counts)
        sets = [np.unique(words[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
        yield (np.concatenate(sets) if sets else words), np.array([len(s) for s in sets], np.int64)


def _count_terms(batch: dict) -> dict:
    terms = [t for t, _ in _distinct_terms(batch["text"])]
    keys, df = np.unique(np.concatenate(terms), return_counts=True) if terms else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return {"term": pa.array(keys.view(np.int64)), "df": pa.array(df.astype(np.int64))}


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band; every document counts.

    A term of the band is in ``low`` of all documents at least, so there are no more than the mean number of distinct terms of a
    document over ``low``, however many documents there are: 8 bytes each, 8 MB for a mean of 1000.
    """
    n = docs.count()
    texts = docs.select(F.col(text_col).alias("text"))
    counts = arrow_map(texts, _count_terms, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    band = counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n) & (F.col("df") > 1)).select("term")
    return np.sort(band.toArrow().column("term").to_numpy().view(np.uint64))


def fingerprints(column: pa.Array, words: np.ndarray) -> list[bytes]:
    """A fingerprint of LEVELS * SUBSETS 16-bit hashes for each text; all zeros never occurs."""
    out: list[bytes] = []
    row = 0
    for terms, counts in _distinct_terms(column):
        at = np.searchsorted(words, terms)
        at[at == len(words)] = 0
        kept = words[at] == terms if len(words) else np.zeros(len(terms), bool)
        of_row = np.repeat(np.arange(len(counts)), counts)[kept]
        terms = terms[kept]
        grid = np.zeros((len(counts), LEVELS * SUBSETS), np.uint16)
        for level, bits in enumerate(SPARSITY):
            for k in range(SUBSETS):
                per_word = 64 // bits
                if k % per_word == 0:
                    draw = mix64(terms, 10 + 16 * level + k // per_word)
                inside = np.flatnonzero((draw >> np.uint64(bits * (k % per_word))) & np.uint64((1 << bits) - 1) == 0)
                if len(inside):
                    r = of_row[inside]
                    cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    total = np.add.reduceat(mix64(terms[inside], 1000 + level * SUBSETS + k), cut)
                    grid[r[cut], level * SUBSETS + k] = (mix64(total) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        for line, some in zip(grid, grid.any(axis=1)):
            if some:
                out.append(line.tobytes())
            else:
                text = (column[row].as_py() or "").encode("utf-8")
                out.append(b"\0" * 2 * (LEVELS * SUBSETS - 8) + hashlib.sha256(text).digest()[:16])
            row += 1
    return out


_PLAIN = b"\0" * 2 * (LEVELS * SUBSETS - 8)


def likeness(a: bytes, b: bytes) -> float:
    """Between 0 and 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if a.startswith(_PLAIN) or b.startswith(_PLAIN):
        return 0.0
    x, y = np.frombuffer(a, np.uint16).reshape(LEVELS, SUBSETS), np.frombuffer(b, np.uint16).reshape(LEVELS, SUBSETS)
    held = (x > 0) | (y > 0)
    same = ((x == y) & held).sum(axis=1).tolist()
    held = held.sum(axis=1).tolist()
    level = next((k for k in range(LEVELS - 1, 0, -1) if held[k] >= ENOUGH), 0)
    return same[level] / held[level] if held[level] else 0.0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by ranges of ids: ``range, head, doc_id, text``, sorted as :func:`compare_with_next` reads them.

    Ranges end at ids that occur, taken from an approximate quantile sketch of the id column. The last id of each range (a head)
    is sent to the range above too, as what follows there, so no window or sort runs over the whole table. The largest id
    follows the smallest.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"))
    facts = ids.agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("top")).first()
    n_ranges = min(MAX_RANGES, max(1, -(-facts["n"] // RANGE)))
    shares = [k / n_ranges for k in range(1, n_ranges)]
    ends = sorted(set(ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10 * n_ranges).alias("q")).first()["q"] or [])) if shares else []
    ends = [e for e in ends if e < (facts["top"] if facts["top"] is not None else 0)] + ([facts["top"]] if facts["top"] is not None else [])
    ends_arr = np.array(ends, np.int64)
    n = max(1, len(ends))

    def deal(batch: dict) -> dict:
        id_ = batch["doc_id"]
        null = np.array(id_.is_null())
        value = id_.fill_null(0).to_numpy()
        at = np.where(null, 0, np.minimum(np.searchsorted(ends_arr, value), n - 1)) if len(ends_arr) else np.zeros(len(value), np.int64)
        head = ~null & (ends_arr[at] == value) if len(ends_arr) else np.zeros(len(value), bool)
        take = np.concatenate((np.arange(len(value)), np.flatnonzero(head)))
        to = np.concatenate((at, (at[head] + 1) % n))
        is_head = np.concatenate((np.zeros(len(value), bool), np.ones(int(head.sum()), bool)))
        return {"range": pa.array(to.astype(np.int32)), "head": pa.array(is_head), "doc_id": id_.take(pa.array(take)), "text": batch["text"].take(pa.array(take))}

    rows = arrow_map(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), deal, "range int, head boolean, doc_id bigint, text string")
    return rows.repartition("range").sortWithinPartitions("range", "head", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def compare_with_next(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and both likenesses.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many of the next document's, by descending id
    (ties: by text). Rows without an id come last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ship(docs.sparkSession)

    def answer(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        """Of (doc_id, text, next text)."""
        edited = []
        for _, text, after in pairs:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        n = len(pairs)
        joined: list[str] = [p[1] for p in pairs] + edited
        chained = [k < n - 1 and pairs[k + 1][1] is pairs[k][2] for k in range(n)]
        joined += [pairs[k][2] for k in range(n) if not chained[k]]
        prints = fingerprints(pa.array(joined, pa.large_string()), shared.value)
        extra = iter(prints[2 * n :])
        after = [prints[k + 1] if chained[k] else next(extra) for k in range(n)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
                pa.array([f.hex() for f in prints[:n]]),
                pa.array([f.hex() for f in prints[n : 2 * n]]),
                pa.array([likeness(a, b) for a, b in zip(prints[:n], prints[n : 2 * n])]),
                pa.array([likeness(a, b) for a, b in zip(prints[:n], after)]),
            ],
            schema=schema,
        )

    def run(batches):
        # In a range: its rows by descending id, then the heads that follow the last of them.
        waiting: list[tuple[int | None, str, str]] = []
        held: tuple | None = None
        size = 0
        for b in batches:
            for rng, head, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                text = text or ""
                if held is not None and held[0] == rng and not held[1]:
                    waiting.append((held[2], held[3], text))
                    size += len(text)
                held = (rng, head, doc_id, text)
                if size > 1 << 20:
                    yield answer(waiting)
                    waiting, size = [], 0
        if waiting:
            yield answer(waiting)

    out = with_next(docs, id_col, text_col)
    return out.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

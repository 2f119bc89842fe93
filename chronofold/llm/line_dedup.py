"""Removal of repeated line chunks, with DataFrame functions only.

Lines are hashed; where a rolling hash over the last ``WINDOW`` lines falls on a multiple of ``TARGET`` a chunk
of two or more lines ends, so boundaries depend on content and survive inserted or deleted lines elsewhere; a last line
alone joins the chunk before it. A chunk of two or more lines that occurs at several places in the corpus stays at its first place (smallest
doc_id, then position) and is removed at the others, once its bytes equal the first one's.

Only hashes and positions are shuffled to find repeats, aggregated map-side, so a chunk of a
third of all rows is one row a task; texts move once by doc_id, and those of repeated chunks once
more for the comparison. Joins with texts shuffle at every size, so that cost grows in proportion.

Defined results: a null text stays null, a text whose chunks all go becomes empty; blank chunks
(only white space) stay; rows without a doc_id pass through unchanged and count as no place; rows that repeat a
doc_id share their places, so equal ones are all kept or all cut alike. Lines end at U+000A only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import cut

TARGET, WINDOW = 2, 2
MODULUS = 1_000_003
_MULTIPLIER = 31


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint") % MODULUS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body uses it and inside whatever loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ends(hashes: Column, target: int) -> Column:
    """The numbers (from 1) of the lines that end a chunk.

    A line may end one where its rolling hash says so, and the last line may. The marks are one string, in which a pattern finds
    chunk after chunk: any line, lines that can't end it, one that can.
    """
    n = F.size(hashes)

    def may_end(i: Column) -> Column:
        rolling = F.element_at(hashes, i)
        for back in range(1, WINDOW):
            rolling = rolling + _MULTIPLIER**back * F.when(i > back, F.element_at(hashes, F.greatest(i - back, F.lit(1)))).otherwise(0)
        return F.when((rolling % target == 0) | (i == n), "1").otherwise("0")

    lines = F.sequence(F.lit(1), n)
    marks = F.split(F.regexp_replace(F.array_join(F.transform(lines, may_end), ""), "[01](0*)1", "0$1e"), "")

    def pick(marks: Column) -> Column:
        alone = F.element_at(marks, n) != "e"  # the last line is left over: the chunk before takes it in
        return F.filter(lines, lambda i: (i == n) | (F.element_at(marks, i) == "e") & ~(alone & (i == n - 1)))

    return _let(marks, pick)


def chunks_of(text: Column, target: int = TARGET) -> Column:
    """An array of (pos, n_lines, body); null for a null text."""

    def cut_at(lines: Column, ends: Column) -> Column:
        def chunk(end: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))))
            return F.struct(i.alias("pos"), (end - start).alias("n_lines"), F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("body"))

        return F.transform(ends, chunk)

    split = F.split(text, "\n", -1)
    chunked = _let(split, lambda lines: _let(F.transform(lines, _line_hash), lambda hashes: _let(_ends(hashes, target), lambda ends: cut_at(lines, ends))))
    return F.when(text.isNotNull(), chunked)


def with_chunks(docs: DataFrame, text_col: str = "text", target: int = TARGET) -> DataFrame:
    return docs.withColumn("chunks", chunks_of(F.col(text_col), target))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET) -> DataFrame:
    """``docs`` with the text deduplicated, and ``n_lines``, ``n_removed_chunks``, ``n_removed_lines``."""
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed_chunks", "n_removed_lines")]
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    chunked = with_chunks(base.where("_id is not null and _text is not null"), "_text", target)
    places = chunked.select("_id", F.explode("chunks").alias("c")).select("_id", F.col("c.pos").alias("pos"), F.col("c.n_lines").alias("n"), F.col("c.body").alias("body"))
    able = places.where((F.col("n") > 1) & (F.trim(F.regexp_replace("body", "[\\n\\t\\r]", " ")) != ""))
    keyed = cut(able.select("_id", "pos", F.xxhash64("body").alias("h"), F.crc32(F.encode("body", "UTF-8")).alias("c32"), F.length("body").alias("len")), "places")
    key = ["h", "c32", "len"]
    # Cut, so that the join reads two plain shuffles and Spark can split a chunk that a share of all rows holds.
    firsts = cut(keyed.groupBy(*key).agg(F.min(F.struct("_id", "pos")).alias("first"), F.count("*").alias("times")).where("times > 1").select(*key, "first"), "firsts")
    repeats = keyed.join(firsts, key).select("_id", F.struct("pos", *key, (F.struct("_id", "pos") == F.col("first")).alias("is_first")).alias("r"))
    by_doc = cut(repeats.groupBy("_id").agg(F.collect_set("r").alias("repeats")), "repeats")  # no more than a document's chunks

    # Compare bytes: each later place's body with the first place's.
    found = with_chunks(base.join(by_doc.hint("merge"), "_id"), "_text", target).select("_id", "repeats", F.explode("chunks").alias("c"))
    bodies = found.select("_id", F.col("c.body").alias("body"), F.explode(F.filter("repeats", lambda r: r["pos"] == F.col("c.pos"))).alias("r"))
    bodies = bodies.where((F.xxhash64("body") == F.col("r.h")) & (F.length("body") == F.col("r.len"))).select("_id", "body", "r.*")
    first_bodies = cut(bodies.where("is_first").select(*key, F.col("body").alias("first_body")).dropDuplicates(key), "bodies")
    victims = bodies.where("not is_first").select("_id", "pos", *key, "body").join(first_bodies, key).where(F.col("body") == F.col("first_body")).select("_id", "pos", "h")
    gone = cut(victims.groupBy("_id").agg(F.collect_set(F.struct("pos", "h")).alias("gone")), "gone")

    whole = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(others)])
    chunked = with_chunks(whole.join(gone.hint("merge"), "_id", "left"), "_text", target)
    is_gone = lambda c: F.coalesce(F.exists("gone", lambda g: (g["pos"] == c["pos"]) & (g["h"] == F.xxhash64(c["body"]))), F.lit(False))
    out = chunked.withColumn("_gone", F.filter("chunks", is_gone)).withColumn("_kept", F.filter("chunks", lambda c: ~is_gone(c)))
    text = F.when(F.size("_gone") > 0, F.array_join(F.transform("_kept", lambda c: c["body"]), "\n")).otherwise(F.col("_text"))
    lines = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + x["n_lines"]), F.lit(0)).cast("bigint")
    return out.select(
        F.col("_id").alias(id_col),
        text.alias(text_col),
        *[F.col(f"_o{k}").alias(c) for k, c in enumerate(others)],
        lines(F.col("chunks")).alias("n_lines"),
        F.greatest(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed_chunks"),
        lines(F.col("_gone")).alias("n_removed_lines"),
    )


def oracle(source: str = "documents", target: int = TARGET) -> str:
    """DuckDB SQL of the same result: ``doc_id, text, n_lines, n_removed_chunks, n_removed_lines``."""
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, text FROM {source}),
lined AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM base WHERE text IS NOT NULL),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % {MODULUS} AS h, max(i) OVER (PARTITION BY rid) AS n FROM lined),
rolled AS (SELECT *, (h + {_MULTIPLIER} * coalesce(lag(h) OVER (PARTITION BY rid ORDER BY i), 0)) % {target} = 0 OR i = n AS may FROM hashed),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, may ORDER BY i) AS island FROM rolled),
placed AS (SELECT *, min(i) OVER (PARTITION BY rid, may, island) AS j FROM islands),
accepted AS (SELECT *, may AND (i - j) % 2 = CASE WHEN j = 1 THEN 1 ELSE 0 END AS ok FROM placed),
ended AS (SELECT *, i = n OR ok AND NOT (i = n - 1 AND NOT max(CASE WHEN i = n THEN ok END) OVER (PARTITION BY rid)) AS is_end FROM accepted),
numbered AS (SELECT *, coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended),
chunks AS (SELECT rid, doc_id, pos, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY rid, doc_id, pos),
able AS (SELECT * FROM chunks WHERE n_lines > 1 AND doc_id IS NOT NULL AND trim(regexp_replace(body, '[\\n\\t\\r]', ' ', 'g')) <> ''),
firsts AS (SELECT body, min(struct_pack(d := doc_id, p := pos)) AS f FROM able GROUP BY body),
gone AS (SELECT DISTINCT a.rid, a.pos FROM able a JOIN firsts f ON a.body = f.body WHERE struct_pack(d := a.doc_id, p := a.pos) <> f.f),
marked AS (SELECT c.*, g.pos IS NOT NULL AS is_gone FROM chunks c LEFT JOIN gone g ON c.rid = g.rid AND c.pos = g.pos),
summed AS (SELECT rid, sum(n_lines) AS n_lines, count(*) FILTER (WHERE is_gone) AS k, coalesce(sum(n_lines) FILTER (WHERE is_gone), 0) AS gl, string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE NOT is_gone) AS kept FROM marked GROUP BY rid)
SELECT b.doc_id, CASE WHEN b.text IS NULL THEN NULL WHEN s.k > 0 THEN coalesce(s.kept, '') ELSE b.text END AS text, CAST(coalesce(s.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.k, 0) AS BIGINT) AS n_removed_chunks, CAST(coalesce(s.gl, 0) AS BIGINT) AS n_removed_lines
FROM base b LEFT JOIN summed s ON b.rid = s.rid"""

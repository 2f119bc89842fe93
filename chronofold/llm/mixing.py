"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) shares a token budget. Each child has a weight among
its siblings and a capacity: the tokens below it times the allowed epochs. Going down from the
root, a node's budget is split in proportion to weight; what a child cannot use goes to its siblings,
and only what all siblings cannot use is left to the levels above - there the same rule has
already shared it, because capacities are those of whole subtrees. The split has a closed form:
with siblings sorted by capacity / weight, the common level is the largest of
(budget - capacities before) / (weights from here on).

Each leaf then takes full epochs, and of the last epoch the prefix, in an order seeded by epoch, that fits.
The cut is found without sorting a leaf: token sums of 4096 ranges of the order key, then a
sort of the one range that holds the cut. The final selection is a filter beside the leaf table;
texts are never shuffled.

Defined results: null level values are one value of their own; null texts have no tokens and cost
nothing; weights of 0 or less select nothing; ties in the order go to the smaller id; rows that
repeat an id are taken or left together; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import cut

NULL = "\\N"


@dataclass(frozen=True)
class Mix:
    """Weights by value for each level, from the root down; ``other`` is the weight of values not named."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: tuple[dict[str, float], ...] = field(default_factory=lambda: ({"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, {}))
    other: tuple[float, ...] = (0.05, 0.05, 1.0)
    share: float = 0.6
    epochs: int = 2
    seed: int = 11


def domain_of(source: Column) -> Column:
    """The domain of a source: here by its number; a stand-in for a catalogue of sources."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", F.lit("dx")).otherwise(F.concat(F.lit("d"), (F.substring(number, -1, 1).cast("int") % 4).cast("string")))


def words_in(text: Column) -> Column:
    """Space-separated words: a cheap stand-in for tokens."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _order_key(epoch: Column, row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), row_id.cast("string")))


def allocate(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (levels and ``tokens``) with their ``budget``; a table of the tree's size."""
    levels = list(mix.levels)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select((F.col("t") * F.lit(mix.share)).alias("budget"))
    parents, above = total, []
    for depth, level in enumerate(levels):
        names = levels[: depth + 1]
        nodes = leaves.groupBy(*names).agg((F.sum("tokens") * mix.epochs).cast("double").alias("cap"))
        known = mix.weights[depth]
        weight = F.lit(float(mix.other[depth]))
        for value in sorted(known):
            weight = F.when(F.col(level) == value, F.lit(float(known[value]))).otherwise(weight)
        nodes = nodes.withColumn("w", weight).where((F.col("w") > 0) & (F.col("cap") > 0))
        nodes = nodes.join(parents, above) if above else nodes.join(F.broadcast(parents))  # the root is one row
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        ordered = siblings.orderBy(F.col("cap") / F.col("w"), level)
        before, here_on = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("usable", F.least("budget", F.sum("cap").over(siblings)))
        nodes = nodes.withColumn("l", (F.col("usable") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(here_on))
        nodes = nodes.withColumn("budget", F.least(F.col("cap"), F.col("w") * F.max("l").over(siblings)))
        parents, above = nodes.select(*names, "budget"), names
    return leaves.join(parents, levels, "left").withColumn("budget", F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6).cast("bigint"))


def choose(docs: DataFrame, mix: Mix, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """The chosen rows of ``docs`` with ``n_tokens`` and ``epoch`` (0 first).

    ``docs`` must have the level columns; ``tokens`` is the cost of a row. Columns of ``docs`` called ``n_tokens`` or ``epoch``
    give way to those of the result, once ``tokens`` has read them.
    """
    tagged = docs.withColumn("_tokens", F.coalesce(tokens, F.lit(0)).cast("bigint")).drop("n_tokens", "epoch")
    for level in mix.levels:
        tagged = tagged.withColumn(f"_l_{level}", F.coalesce(F.col(level).cast("string"), F.lit(NULL)))
    named = [f"_l_{level}" for level in mix.levels]
    thin = cut(tagged.select(F.col(id_col).alias("_id"), *[F.col(n).alias(level) for n, level in zip(named, mix.levels)], F.col("_tokens").alias("tokens")), "costs")
    levels = list(mix.levels)
    leaves = thin.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    plan = allocate(leaves, mix).withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = cut(plan.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "leaves")
    keyed = thin.join(plan.where("rest > 0").select(*levels, "full", "rest"), levels).withColumn("key", _order_key(F.col("full"), F.col("_id"), mix.seed)).withColumn("slot", F.substring("key", 1, 3))
    slots = keyed.groupBy(*levels, "slot").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*levels).orderBy("slot")
    slots = slots.withColumn("before", F.sum("t").over(upto) - F.col("t"))
    edge = cut(slots.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).select(*levels, "slot", "before"), "slots")  # a row a leaf
    inside = keyed.join(edge, [*levels, "slot"]).groupBy(*levels, "key", "before", "rest").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*levels).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("sum", F.col("before") + F.sum("tokens").over(run)).where("sum <= rest").groupBy(*levels).agg(F.max("key").alias("upto_key"))
    edges = cut(plan.join(edge.select(*levels, "slot"), levels, "left").join(last, levels, "left"), "edges")
    # Without an edge slot everything of the last epoch fits or nothing is left to take.
    whole = F.col("slot").isNull() & (F.col("rest") > 0)
    limit = F.when(whole, F.lit("g")).when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("upto_key", "slot"))
    limits = edges.select(*[F.col(level).alias(n) for n, level in zip(named, levels)], F.col("full").alias("_full"), limit.alias("_limit"))
    epochs = F.sequence(F.lit(0), F.lit(mix.epochs - 1))
    rows = tagged.join(limits, named).withColumn("epoch", F.explode(epochs))
    rows = rows.where((F.col("epoch") < F.col("_full")) | (F.col("epoch") == F.col("_full")) & (_order_key(F.col("epoch"), F.col(id_col), mix.seed) <= F.col("_limit")))
    return rows.withColumnRenamed("_tokens", "n_tokens").drop(*named, "_full", "_limit")


def oracle(mix: Mix, source: str = "documents") -> str:
    """DuckDB SQL of the choice over documents with :func:`domain_of` and :func:`words_in`: ``doc_id, domain, lang, source, n_tokens, epoch``."""
    domain = "CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'dx' ELSE 'd' || CAST(CAST(right(regexp_extract(source, '([0-9]+)$', 1), 1) AS INT) % 4 AS VARCHAR) END"
    tokens = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END"
    sql = [f"t AS (SELECT row_number() OVER () AS rid, doc_id, {domain} AS domain, lang, source, CAST({tokens} AS BIGINT) AS tokens FROM {source})"]
    sql.append(f"k AS (SELECT *, domain AS l0, coalesce(lang, '{NULL}') AS l1, coalesce(source, '{NULL}') AS l2 FROM t)")
    sql.append("leaf AS (SELECT l0, l1, l2, CAST(sum(tokens) AS BIGINT) AS tokens FROM k GROUP BY ALL)")
    sql.append(f"p AS (SELECT coalesce(sum(tokens), 0) * CAST({mix.share!r} AS DOUBLE) AS budget FROM leaf)")
    for depth in range(3):
        names = ", ".join(f"l{i}" for i in range(depth + 1))
        up = ", ".join(f"l{i}" for i in range(depth))
        part = f"PARTITION BY {up}" if up else ""
        cases = " ".join(f"WHEN l{depth} = '{v}' THEN CAST({w!r} AS DOUBLE)" for v, w in sorted(mix.weights[depth].items()))
        weight = f"CASE {cases} ELSE CAST({mix.other[depth]!r} AS DOUBLE) END" if cases else f"CAST({mix.other[depth]!r} AS DOUBLE)"
        prev = f"p{depth - 1}" if depth else "p"
        using = f"JOIN {prev} USING ({up})" if up else f"CROSS JOIN {prev}"
        order = f"ORDER BY cap / w, l{depth}"
        sql.append(f"n{depth} AS (SELECT {names}, CAST(sum(tokens) * {mix.epochs} AS DOUBLE) AS cap, {weight} AS w FROM leaf GROUP BY {names})")
        sql.append(f"a{depth} AS (SELECT *, (least(budget, sum(cap) OVER ({part})) - coalesce(sum(cap) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM n{depth} {using} WHERE w > 0 AND cap > 0)")
        sql.append(f"p{depth} AS (SELECT {names}, least(cap, w * max(l) OVER ({part})) AS budget FROM a{depth})")
    sql.append("plan AS (SELECT leaf.*, CAST(floor(coalesce(p2.budget, 0) + 1e-6) AS BIGINT) AS budget FROM leaf LEFT JOIN p2 USING (l0, l1, l2))")
    sql.append(f"e AS (SELECT k.*, budget, plan.tokens AS lt, ep AS epoch, md5('{mix.seed}:' || ep || ':' || doc_id) AS key FROM k JOIN plan USING (l0, l1, l2) CROSS JOIN range({mix.epochs}) r(ep))")
    sql.append("c AS (SELECT *, epoch * lt + sum(tokens) OVER (PARTITION BY l0, l1, l2, epoch ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)")
    return "WITH " + ",\n".join(sql) + "\nSELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(epoch AS INT) AS epoch FROM c WHERE upto <= budget AND budget > 0 AND lt > 0"

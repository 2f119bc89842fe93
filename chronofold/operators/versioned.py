"""Reads over append-only change histories.

A history has one row a version: ``key, lsn, will_init, payload`` and optionally ``branch``. A version with
``will_init`` (an image) needs nothing before it; the others are deltas, appended to the value so far. A read
as of a position sees versions with ``lsn`` at most that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.cuts import cut


def latest(history: DataFrame, as_of: int | Column | None = None, key: str = "key", lsn: str = "lsn") -> DataFrame:
    """The newest version of each key; one aggregation, combined before the shuffle."""
    seen = history if as_of is None else history.where(F.col(lsn) <= as_of)
    others = [c for c in history.columns if c != key]
    return seen.groupBy(key).agg(F.max_by(F.struct(*others), F.col(lsn)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in others])


#: Spans of position that a key's versions are dealt into, so that one key's history is not one task.
SPANS = 512


def as_of_join(requests: DataFrame, history: DataFrame, key: str, at: str, lsn: str, take: list[str]) -> DataFrame:
    """Each request with the newest version of its key at or below ``at``.

    Requests and versions are sorted together within a key and a span of positions, and the last version is carried forward; what a
    span starts with is the newest version of the spans before it, one row a key and span. So the work is a sort, not a join of every
    request with every version, and a hot key is many tasks.
    """
    ends = history.agg(F.min(lsn).alias("lo"), F.max(lsn).alias("hi")).first()
    lo = int(ends["lo"] or 0)
    width = max(1, -(-(int(ends["hi"] or 0) - lo + 1) // SPANS))
    span = lambda t: F.least(F.greatest(F.floor((F.col(t) - lo) / width), F.lit(-1)), F.lit(SPANS)).cast("int")
    value = F.struct(lsn, *[c for c in take if c != lsn])
    kind = history.select(value.alias("v")).schema["v"].dataType
    a = requests.select(F.col(key).alias("_k"), F.col(at).alias("_t"), span(at).alias("_s"), F.lit(1).alias("_o"), F.struct(*requests.columns).alias("_r"), F.lit(None).cast(kind).alias("_v"))
    b = history.select(F.col(key).alias("_k"), F.col(lsn).alias("_t"), span(lsn).alias("_s"), F.lit(0).alias("_o"), F.lit(None).cast(a.schema["_r"].dataType).alias("_r"), value.alias("_v"))
    heads = b.groupBy("_k", "_s").agg(F.max_by("_v", "_t").alias("_v")).unionByName(a.select("_k", "_s", "_v").distinct())
    heads = heads.groupBy("_k", "_s").agg(F.first("_v", ignorenulls=True).alias("_v"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most SPANS + 2 rows
    carried = heads.select("_k", "_s", F.last("_v", ignorenulls=True).over(before).alias("_c"))
    inside = Window.partitionBy("_k", "_s").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_o = 1")
    found = found.join(carried, ["_k", "_s"], "left")
    return found.withColumn("_v", F.coalesce("_v", "_c")).select("_r.*", *[F.col(f"_v.{c}").alias(f"found_{c}") for c in dict.fromkeys([lsn, *take])])


def visited(requests: DataFrame, history: DataFrame) -> DataFrame:
    """For requests ``(key, at)``: the versions a read visits, from the newest image at or below ``at`` on, or all if there is none.

    Versions are numbered by the image they follow, and a request meets those of its image only, not the key's whole history.
    """
    images = history.where("will_init").select("key", "lsn")
    base = as_of_join(requests, images, "key", "at", "lsn", ["lsn"]).select(*[F.col(c) for c in requests.columns], F.coalesce("found_lsn", F.lit(-1)).alias("_base"))
    h = as_of_join(history.select("key", "lsn", "will_init", "payload"), images, "key", "lsn", "lsn", ["lsn"])
    h = h.select("key", "lsn", "will_init", "payload", F.coalesce("found_lsn", F.lit(-1)).alias("_base"))
    return base.join(h, ["key", "_base"]).where("lsn <= at").drop("_base")


def reconstruct(requests: DataFrame, history: DataFrame) -> DataFrame:
    """``key, at, value, n_records, status``: the folded value of each request.

    status is ``ok``, ``missing`` (no version) or ``no_base`` (deltas with no image before them; value null).
    """
    records = visited(requests, history).groupBy("key", "at").agg(F.sort_array(F.collect_list(F.struct("lsn", "will_init", "payload"))).alias("r"))
    ok = F.element_at("r", 1)["will_init"]
    value = F.when(ok, F.array_join(F.transform("r", lambda x: x["payload"]), ","))
    folded = records.select("key", "at", value.alias("value"), F.size("r").cast("bigint").alias("n_records"), F.when(ok, F.lit("ok")).otherwise(F.lit("no_base")).alias("status"))
    return requests.distinct().join(folded, ["key", "at"], "left").select("key", "at", "value", F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records"), F.coalesce("status", F.lit("missing")).alias("status"))


def fold_test_records(history: DataFrame) -> DataFrame:
    """``key, value``: the fold of ``op`` (append, clear, or append only if the value so far has an even length) in order of lsn."""
    ordered = history.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lsn", "op", "text"))).alias("r"))
    step = lambda acc, x: F.when(x["op"] == "clear", F.lit("")).when((x["op"] == "only_if") & (F.length(acc) % 2 == 1), acc).otherwise(F.concat(acc, x["text"]))
    return ordered.select("key", F.aggregate("r", F.lit(""), step).alias("value"))


def branch_caps(branches: DataFrame, max_depth: int = 64) -> DataFrame:
    """``branch, source, cap, depth``: what each branch reads from itself and its ancestors, and up to which lsn.

    ``branches`` is (branch, parent, branch_lsn). A read passes to the parent with its bound lowered to the smallest branching
    point on the way. One small join a level of the tree.
    """
    top = F.lit(9223372036854775807).cast("bigint")
    level = branches.select("branch", F.col("branch").alias("source"), top.alias("cap"), F.lit(0).alias("depth"))
    out = level
    up = branches.select(F.col("branch").alias("source"), "parent", "branch_lsn").where("parent is not null")
    for _ in range(max_depth):
        level = level.join(up, "source").select("branch", F.col("parent").alias("source"), F.least("cap", "branch_lsn").alias("cap"), (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def create_branches(asked: DataFrame, timelines: DataFrame, leases: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests (branch, parent, lsn?) for new branches: ``branch, parent, branch_lsn, status``.

    Without a position a branch starts at its parent's last one. ``timelines`` is (timeline, last, applied, planned), ``leases`` (timeline, lsn), ``existing``
    (branch, parent, branch_lsn). status: ``no_parent``; ``exists`` for a branch that is there as asked and ``conflict`` for one that is not;
    ``below_applied`` and ``below_planned`` for a position under the parent's cutoffs that no lease holds; else ``created``.
    """
    parents = timelines.select(F.col("timeline").alias("parent"), "last", "applied", "planned")
    at = asked.join(parents, "parent", "left").withColumn("branch_lsn", F.coalesce("lsn", "last")).drop("lsn")
    held = leases.select(F.col("timeline").alias("parent"), F.col("lsn").alias("branch_lsn"), F.lit(True).alias("held")).distinct()
    there = existing.select("branch", F.col("parent").alias("_p"), F.col("branch_lsn").alias("_l"), F.lit(True).alias("there"))
    at = at.join(held, ["parent", "branch_lsn"], "left").join(there, "branch", "left")
    open_ = F.col("held").isNull()
    status = (
        F.when(F.col("last").isNull(), "no_parent")
        .when(F.col("there"), F.when((F.col("_p") == F.col("parent")) & (F.col("_l") == F.col("branch_lsn")), "exists").otherwise("conflict"))
        .when(open_ & (F.col("branch_lsn") < F.col("applied")), "below_applied")
        .when(open_ & (F.col("branch_lsn") < F.col("planned")), "below_planned")
        .otherwise("created")
    )
    return at.select("branch", "parent", "branch_lsn", status.alias("status"))


def inherited_read(history: DataFrame, branches: DataFrame, not_inherited: list[tuple[int, int]], images: DataFrame | None = None) -> DataFrame:
    """``branch, key, lsn, payload``: the newest version of each key that a branch sees, with the rules of a read that descends to ancestors.

    Keys in the ranges ``not_inherited`` are looked up in the branch alone. Where an image (``branch, start, end, lsn``) of a
    branch on the way covers a key that the branch itself doesn't hold at or below the bound there, the key doesn't exist: the search stops.
    """
    level = cut(branch_caps(branches), "branches")
    seen = _view(history, level)
    inherited = F.lit(True)
    for start, end in not_inherited:
        inherited = inherited & ~((F.col("key") >= start) & (F.col("key") < end))
    seen = seen.where((F.col("branch") == F.col("source")) | inherited)
    per = seen.groupBy("branch", "source", "key").agg(F.max("lsn").alias("lsn"), F.max_by("payload", "lsn").alias("payload")).join(level.select("branch", "source", "depth"), ["branch", "source"])
    best = per.groupBy("branch", "key").agg(F.min_by(F.struct("lsn", "payload", "depth"), "depth").alias("v")).select("branch", "key", "v.*")
    if images is not None:
        from chronofold.operators.keyspace import overlap_join

        walls = images.withColumnRenamed("branch", "source").withColumnRenamed("lsn", "image_lsn").join(level, "source").where("image_lsn <= cap").select("start", "end", "branch", "depth")
        points = best.select(F.col("key").alias("start"), (F.col("key") + 1).alias("end"), "branch", "depth")
        stopped = overlap_join(points, walls).where("a_branch = b_branch and b_depth < a_depth").select(F.col("a_branch").alias("branch"), F.col("a_start").alias("key")).distinct()
        best = best.join(stopped, ["branch", "key"], "left_anti")
    return best.select("branch", "key", "lsn", "payload")


def detach(history: DataFrame, branches: DataFrame, branch: int) -> tuple[DataFrame, DataFrame]:
    """History and branches after ``branch`` left its ancestor: it holds a copy of what it inherited, and no parent.

    Branches that left the ancestor at or before the point where ``branch`` did, siblings of it, become its children: what they see is in the copy.
    """
    own = branches.where(F.col("branch") == branch).select(F.col("parent").alias("_p"), F.col("branch_lsn").alias("_l"))
    copied = branch_view(history, branches).where((F.col("branch") == branch) & (F.col("source") != branch)).drop("source")
    marked = branches.join(F.broadcast(own))
    moved = (F.col("branch") != branch) & (F.col("parent") == F.col("_p")) & (F.col("branch_lsn") <= F.col("_l"))
    parent = F.when(F.col("branch") == branch, F.lit(None)).when(moved, F.lit(branch)).otherwise(F.col("parent"))
    after = marked.select("branch", parent.cast("bigint").alias("parent"), F.when(F.col("branch") == branch, F.lit(None)).otherwise(F.col("branch_lsn")).cast("bigint").alias("branch_lsn"))
    return history.unionByName(copied.select(*history.columns)), after


def branch_view(history: DataFrame, branches: DataFrame) -> DataFrame:
    """The history each branch sees, its own and inherited; inherited versions stop at the branching point."""
    return _view(history, branch_caps(branches))


def _view(history: DataFrame, caps: DataFrame) -> DataFrame:
    return history.withColumnRenamed("branch", "source").join(caps, "source").where("lsn <= cap").drop("cap", "depth")


def relation_sizes(ops: DataFrame, as_of: int | None = None) -> DataFrame:
    """``rel, blocks``: relations that exist and their sizes after ``ops`` (rel, lsn, op, blocks) up to a position.

    ``extend`` makes a relation at least so large, ``truncate`` exactly so large, and ``drop`` ends it; an extension after that begins it anew.
    Only what follows the last truncation or drop counts, so two aggregations do, and no history is walked.
    """
    seen = ops if as_of is None else ops.where(F.col("lsn") <= as_of)
    resets = seen.where("op <> 'extend'").groupBy("rel").agg(F.max("lsn").alias("_at"), F.max_by(F.struct("op", "blocks"), "lsn").alias("_r"))
    grown = seen.where("op = 'extend'").join(resets.select("rel", "_at"), "rel", "left").where("_at is null or lsn > _at").groupBy("rel").agg(F.max("blocks").alias("_g"))
    both = grown.join(resets, "rel", "full").where("_g is not null or _r.op = 'truncate'")
    base = F.when(F.col("_r.op") == "truncate", F.col("_r.blocks"))
    return both.select("rel", F.greatest("_g", base).alias("blocks"))


def drop_tombstones(state: DataFrame, payload: str = "payload") -> DataFrame:
    """Keys whose newest version is not a deletion (an empty payload)."""
    return state.where(F.coalesce(F.col(payload), F.lit("")) != "")


def lsn_for_timestamp(commits: DataFrame, at: Column, least: int = 0) -> DataFrame:
    """One row ``lsn, verdict`` for a time: the 8-aligned position just below the first commit at or after it, or that of the last commit.

    verdict: ``present`` with commits on both sides, ``future`` with none after; ``past`` with none before, or where the position would lie below
    ``least`` (what may be read), and ``nodata`` give ``least`` itself.
    """
    return _located(commits.agg(*_sides(at)), least).select("lsn", "verdict")


def lsn_for_timestamps(commits: DataFrame, asked: DataFrame, least: int = 0) -> DataFrame:
    """``timeline, lsn, verdict``: :func:`lsn_for_timestamp` of each timeline's commits (timeline, lsn, ts) and its time (timeline, at)."""
    both = asked.join(commits, "timeline", "left")
    return _located(both.groupBy("timeline").agg(*_sides(F.col("at"))), least).select("timeline", "lsn", "verdict")


def _sides(at: Column) -> list[Column]:
    later, earlier = F.col("ts") >= at, F.col("ts") < at
    return [F.min(F.when(later, F.col("lsn"))).alias("lo"), F.max("lsn").alias("top"), F.coalesce(F.max(later), F.lit(False)).alias("larger"), F.coalesce(F.max(earlier), F.lit(False)).alias("smaller")]


def _located(sides: DataFrame, least: int) -> DataFrame:
    found = F.floor(F.when(F.col("larger"), F.col("lo") - 1).otherwise(F.col("top")) / 8).cast("bigint") * 8
    verdict = F.when(~F.col("smaller") & ~F.col("larger"), "nodata").when(~F.col("smaller") | (found < least), "past").when(F.col("larger"), "present").otherwise("future")
    return sides.withColumn("verdict", verdict).withColumn("lsn", F.when(F.col("verdict").isin("present", "future"), found).otherwise(F.lit(least)).cast("bigint"))


def timestamp_for_lsn(commits: DataFrame, lsn: int) -> DataFrame:
    return commits.where(F.col("lsn") <= lsn).agg(F.max("ts").alias("ts"))


def retained(history: DataFrame, retain: list[int], horizon: int, threshold: int) -> DataFrame:
    """What history pruning keeps: ``key, lsn, form`` with form ``image`` or ``delta``.

    Versions fall into buckets by the first retain point (or the horizon) at or above them; versions above the
    horizon all stay. In each lower bucket the newest version's position must stay readable: the lowest bucket ends in an image;
    a later bucket keeps its deltas until ``threshold`` deltas have gathered since the last image, where it ends in an image instead.
    The counter depends on what was decided before, so it runs over one row a bucket of a key, never over versions.
    """
    points = sorted({p for p in retain if p < horizon} | {horizon})
    bucket = F.array_min(F.filter(F.array(*[F.lit(p).cast("bigint") for p in points]), lambda p: p >= F.col("lsn")))
    versions = history.where("lsn is not null").groupBy(F.col("key").cast("bigint").alias("key"), F.col("lsn").cast("bigint").alias("lsn")).agg(F.max("will_init").alias("will_init")).withColumn("bucket", bucket)
    own = F.when(F.col("will_init"), "image").otherwise("delta")
    lower = versions.where("bucket is not null")
    images = lower.where("will_init").groupBy("key", "bucket").agg(F.max("lsn").alias("image"))
    live = lower.join(images, ["key", "bucket"], "left").where("image is null or lsn >= image")
    sums = live.groupBy("key", "bucket").agg(F.max("lsn").alias("last"), F.count("image").alias("images"), F.count(F.when(~F.col("will_init"), 1)).alias("deltas"))
    steps = sums.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "last", "images", "deltas"))).alias("steps"))  # a row a point at most

    def decide(state, x):
        since = F.when(x["images"] > 0, F.lit(0).cast("bigint")).otherwise(state["since"]) + x["deltas"]
        ends = (F.size(state["done"]) == 0) | ((x["images"] > 0) & (x["deltas"] == 0)) | (since >= threshold)
        done = F.concat(state["done"], F.array(F.struct(x["bucket"].alias("bucket"), x["last"].alias("last"), ends.alias("ends"))))
        return F.struct(F.when(ends, F.lit(0).cast("bigint")).otherwise(since).alias("since"), done.alias("done"))

    start = F.struct(F.lit(0).cast("bigint").alias("since"), F.array().cast("array<struct<bucket:bigint,last:bigint,ends:boolean>>").alias("done"))
    decided = steps.select("key", F.explode(F.aggregate("steps", start, decide)["done"]).alias("d")).select("key", "d.*")
    kept = live.join(decided, ["key", "bucket"]).where("not ends or lsn = last").select("key", "lsn", F.when(F.col("ends"), "image").otherwise(own).alias("form"))
    return kept.unionByName(versions.where("bucket is null").select("key", "lsn", own.alias("form")))

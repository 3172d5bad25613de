"""References to records that do not exist, per table and period.

A reference (key, time) is fulfilled if some row of its target has begun by that time and not yet
ended. References and targets are counted per key in a sample to find the heavy keys, and split:

- heavy keys with at most FEW target rows are checked against a broadcast of those and not shuffled;
- all ordinary keys take one shuffled anti-join on key and time;
- heavy keys with more target rows are cut into cells of (time, reference), in which targets and
  references are merged in order and the running maximum of the ends says whether a target is there.

The union of the three is the result. Without heavy keys only the anti-join is planned.

Defined results: null and empty keys are no references; a reference without time is reported only
if no row has its key (reason missing); targets without begin are ignored; a target without end, or
with the sentinel, never ends; repeated references count once; an empty target table makes every
reference missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import CELL, MIN_ROWS, at_points, carried, heavy, hot_keys, local_table, with_cells

OPEN = 9999999999999
#: With at most PARTS heavy keys the broadcast has at most FEW * PARTS intervals.
FEW = 16
REF = ["_gl_table", "_gl_row", "_gl_ref", "_gl_t"]


def month(ms) -> Column:
    """yyyy-MM of epoch milliseconds, UTC; null for null."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def _heavy(refs: DataFrame, targets: DataFrame, min_rows: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """The heavy keys with at most FEW target rows, and those with more; each with its rows."""
    rows: dict[str, float] = {}
    for k, n in [*heavy(refs, ["_gl_ref"], min_rows), *heavy(targets, ["_gl_ref"], min_rows)]:
        rows[k] = rows.get(k, 0) + n
    if not rows:
        return [], []
    wanted = local_table(refs.sparkSession, [(k,) for k in rows], "_gl_hk string")
    own = targets.join(F.broadcast(wanted), F.col("_gl_ref") == F.col("_gl_hk"), "left_semi").groupBy("_gl_ref").agg(F.count("*").alias("n"))
    many = {r[0] for r in own.filter(F.col("n") > FEW).select("_gl_ref").collect()}  # at most two times PARTS keys
    return [(k, n) for k, n in rows.items() if k not in many], [(k, n) for k, n in rows.items() if k in many]


def _keys(like: DataFrame, keys: list[tuple[str, float]]) -> DataFrame:
    return F.broadcast(local_table(like.sparkSession, [(k,) for k, _ in keys], "_gl_hk string"))


def _reason(none: Column, begun: Column) -> Column:
    return F.when(none, "missing").when(~begun, "late").otherwise("deleted")


def _checked(refs: DataFrame, targets: DataFrame, keys: list[tuple[str, float]]) -> DataFrame:
    """Orphans of heavy keys by a broadcast of their few targets."""
    known = _keys(refs, keys)
    here = F.col("_gl_ref") == F.col("_gl_hk")
    own = targets.join(known, here, "left_semi").groupBy(F.col("_gl_ref").alias("_gl_of")).agg(F.collect_list(F.struct(F.col("_gl_a").alias("a"), F.col("_gl_z").alias("z"))).alias("_gl_lives"))
    lives = F.broadcast(known.join(own, F.col("_gl_hk") == F.col("_gl_of"), "left").select("_gl_hk", "_gl_lives"))
    begun = F.filter("_gl_lives", lambda x: x["a"] <= F.col("_gl_t"))
    none = F.col("_gl_lives").isNull()
    orphan = none | (F.col("_gl_t").isNotNull() & ~F.exists(begun, lambda x: x["z"] > F.col("_gl_t")))
    return refs.join(lives, here).filter(orphan).select(*REF, _reason(none, F.size(begun) > 0).alias("reason"))


def _anti_joined(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Orphans of ordinary keys by an anti-join; it leaves them partitioned by key for the first begin of their key."""
    there = (F.col("_gl_ref") == F.col("_gl_id")) & (F.col("_gl_a") <= F.col("_gl_t")) & (F.col("_gl_z") > F.col("_gl_t"))
    targets = targets.withColumnRenamed("_gl_ref", "_gl_id")
    absent = refs.join(targets.hint("merge"), there, "left_anti")
    first = targets.groupBy("_gl_id").agg(F.min("_gl_a").alias("_gl_first"))
    judged = absent.join(first.hint("merge"), F.col("_gl_ref") == F.col("_gl_id"), "left")
    none = F.col("_gl_first").isNull()
    return judged.filter(none | F.col("_gl_t").isNotNull()).select(*REF, _reason(none, F.col("_gl_first") <= F.col("_gl_t")).alias("reason"))


def _swept(refs: DataFrame, targets: DataFrame, keys: list[tuple[str, float]], min_rows: int) -> DataFrame:
    """Orphans of keys with many references and many targets, by cells of time."""
    known = _keys(refs, keys)
    mine, theirs = (x.join(known, F.col("_gl_ref") == F.col("_gl_hk"), "left_semi") for x in (refs, targets))
    null = F.lit(None).cast("string")
    merged = theirs.select("_gl_ref", F.col("_gl_a").alias("_gl_t"), F.lit(0).alias("_gl_kind"), null.alias("_gl_table"), null.alias("_gl_row"), "_gl_z")
    merged = merged.unionByName(mine.select("_gl_ref", "_gl_t", F.lit(1).alias("_gl_kind"), "_gl_table", "_gl_row", F.lit(None).cast("long").alias("_gl_z")))
    place = F.struct("_gl_t", "_gl_kind", "_gl_table", "_gl_row")
    hot = hot_keys(merged, "_gl_ref", place, min_rows, keys)
    if hot.points:
        same, merged = at_points(merged, hot, "_gl_ref", place)
        merged = merged.unionByName(same.groupBy("_gl_ref", "_gl_t", "_gl_kind", "_gl_table", "_gl_row").agg(F.max("_gl_z").alias("_gl_z")))
    merged = with_cells(merged, hot, "_gl_ref", place).repartition("_gl_ref", CELL)
    order = Window.partitionBy("_gl_ref", CELL).orderBy(F.asc_nulls_first("_gl_t"), "_gl_kind")
    merged = carried(merged.withColumn("_gl_in", F.max("_gl_z").over(order)), "_gl_ref", F.col("_gl_z"), "_gl_carry")
    end = F.greatest("_gl_in", "_gl_carry")
    absent = (F.col("_gl_kind") == 1) & F.col("_gl_t").isNotNull() & (end.isNull() | (end <= F.col("_gl_t")))
    return merged.filter(absent).select(*REF, _reason(F.lit(False), end.isNotNull()).alias("reason"))  # such keys have targets


def dangling_references(refs: DataFrame, targets: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(tableName, rowId, refId, refTime, reason): each reference that nothing fulfils at its time.

    refs: tableName, rowId, refId, refTime; targets: id, begins, ends. reason is missing (no row
    has the key), late (every row begins after the time) or deleted.
    """
    refs = refs.select(F.col("tableName").alias("_gl_table"), F.col("rowId").cast("string").alias("_gl_row"), F.col("refId").cast("string").alias("_gl_ref"), F.col("refTime").cast("long").alias("_gl_t"))
    refs = refs.filter(F.col("_gl_ref").isNotNull() & (F.col("_gl_ref") != ""))
    targets = targets.select(F.col("id").cast("string").alias("_gl_ref"), F.col("begins").cast("long").alias("_gl_a"), F.coalesce(F.col("ends").cast("long"), F.lit(OPEN)).alias("_gl_z"))
    targets = targets.filter(F.col("_gl_ref").isNotNull() & F.col("_gl_a").isNotNull())
    few, many = _heavy(refs, targets, min_rows)
    rest, theirs = refs, targets
    if few or many:
        known = _keys(refs, few + many)
        rest, theirs = (x.join(known, F.col("_gl_ref") == F.col("_gl_hk"), "left_anti") for x in (refs, targets))
    orphans = _anti_joined(rest, theirs)
    if few:
        orphans = orphans.unionByName(_checked(refs, targets, few))
    if many:
        orphans = orphans.unionByName(_swept(refs, targets, many, min_rows))
    return orphans.distinct().select(F.col("_gl_table").alias("tableName"), F.col("_gl_row").alias("rowId"), F.col("_gl_ref").alias("refId"), F.col("_gl_t").alias("refTime"), "reason")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(tableName, month, reason, orphans): the result of dangling_references, counted; month null without time."""
    return orphans.groupBy("tableName", month(F.col("refTime")).alias("month"), "reason").agg(F.count("*").alias("orphans"))

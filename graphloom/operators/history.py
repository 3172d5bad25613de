"""Full history of changing attributes, one row per version, from reports or periodic snapshots.

Every report of an entity is a snapshot. For each entity and attribute hash a bitmap has one bit
per snapshot position (words of 32 bits); runs of consecutive bits are the versions, and snapshots
in which the entity is absent set no bit, so gaps need no case of their own. Words and hot entities
(cut into time cells, after the reports of one crowded instant are reduced to the one that counts)
are stitched where a run goes on at the next position.

Defined results: of reports with one time the one recorded last counts (then the greatest tie
value); nulls are attribute values; a report without any time or entity is left out; repeated rows
count once; an empty table gives an empty history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import CELL, MIN_ROWS, at_points, hot_keys, with_cells

STILL_VALID = 9999999999999
WORD = 32


def _attribute_hash(attributes: Sequence[str]) -> Column:
    """128 bits over the attribute values; null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(a).cast("string")), F.lit("n")) for a in attributes]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.md5(F.concat(*sized))


def version_history(
    reports: DataFrame,
    entity: str,
    valid_from: str,
    recorded_at: str,
    attributes: Sequence[str],
    removed: Column,
    tie: str | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(entity, attributes..., validFrom, validTo, snapshots): each version with its period."""
    names = [f"_gl_a{k}" for k in range(len(attributes))]
    rows = reports.select(
        F.col(entity).alias("_gl_id"),
        F.coalesce(F.col(valid_from), F.col(recorded_at)).cast("long").alias("_gl_t"),
        F.coalesce(F.col(recorded_at).cast("long"), F.lit(-(2**62))).alias("_gl_tx"),
        (F.col(tie).cast("string") if tie else F.lit("")).alias("_gl_tie"),
        F.when(~F.coalesce(removed, F.lit(False)), _attribute_hash(attributes)).alias("_gl_h"),
        F.struct(*[F.col(a).alias(n) for a, n in zip(attributes, names)]).alias("_gl_attr"),
    ).filter(F.col("_gl_id").isNotNull() & F.col("_gl_t").isNotNull())
    hot = hot_keys(rows, "_gl_id", F.col("_gl_t"), min_rows)
    whole = _merged_cells(_cellwise(hot.but(rows, "_gl_id").withColumn(CELL, F.lit(0))), None)
    if hot:
        theirs = rows
        if hot.points:
            crowd, theirs = at_points(theirs, hot, "_gl_id", F.col("_gl_t"))
            crowd = crowd.groupBy("_gl_id", "_gl_t").agg(F.max_by(F.struct("_gl_h", "_gl_attr"), F.struct("_gl_tx", "_gl_tie", "_gl_h")).alias("_gl_v"), F.max("_gl_tx").alias("_gl_tx"))
            theirs = theirs.unionByName(crowd.select("_gl_id", "_gl_t", "_gl_tx", F.lit("").alias("_gl_tie"), "_gl_v._gl_h", "_gl_v._gl_attr"))
        theirs = with_cells(theirs, hot, "_gl_id", F.col("_gl_t")).repartition("_gl_id", CELL)
        whole = whole.unionByName(_merged_cells(_cellwise(theirs), _cell_edges(_last_of_instant(theirs))))
    return whole.select(
        F.col("_gl_id").alias(entity),
        *[F.col(f"_gl_attr.{n}").alias(a) for a, n in zip(attributes, names)],
        F.col("_gl_from").alias("validFrom"),
        F.coalesce("_gl_to", F.lit(STILL_VALID)).alias("validTo"),
        "snapshots",
    )


def _last_of_instant(rows: DataFrame) -> DataFrame:
    """The last report of each instant, which replaces the others, with its position and the next time."""
    by_time = Window.partitionBy("_gl_id", CELL).orderBy("_gl_t", "_gl_tx", "_gl_tie", "_gl_h")
    rows = rows.withColumn("_gl_nextt", F.lead("_gl_t").over(by_time))
    rows = rows.filter(F.col("_gl_nextt").isNull() | (F.col("_gl_nextt") > F.col("_gl_t")))
    return rows.withColumn("_gl_pos", (F.row_number().over(by_time) - 1).cast("long"))


def _cellwise(rows: DataFrame) -> DataFrame:
    """The versions within each cell."""
    rows = _last_of_instant(rows)
    part = Window.partitionBy("_gl_id", CELL)
    words = (
        rows.filter(F.col("_gl_h").isNotNull())
        .groupBy("_gl_id", CELL, "_gl_h", F.expr(f"_gl_pos div {WORD}").alias("_gl_word"))
        .agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(_gl_pos % {WORD} as int))")).alias("_gl_bits"),
            F.map_from_entries(F.collect_list(F.struct((F.col("_gl_pos") % WORD).cast("int").alias("b"), F.struct("_gl_t", "_gl_nextt").alias("t")))).alias("_gl_at"),
            F.first("_gl_attr").alias("_gl_attr"),
        )
    )
    # a run starts where the bit below is unset; its length is the number of trailing ones there
    starts = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: (F.col("_gl_bits").bitwiseAND(_power(b)) != 0) & (F.col("_gl_bits").bitwiseAND(_power(b - 1)) == 0))
    runs = (
        words.withColumn("_gl_s", F.explode(starts))
        .withColumn("_gl_x", F.expr("shiftright(_gl_bits, _gl_s)"))
        .withColumn("_gl_len", F.expr("bit_count(_gl_x ^ (_gl_x + 1)) - 1"))
        .select(
            "_gl_id", CELL, "_gl_h", "_gl_attr",
            (F.col("_gl_word") * WORD + F.col("_gl_s")).alias("_gl_first"),
            (F.col("_gl_word") * WORD + F.col("_gl_s") + F.col("_gl_len") - 1).alias("_gl_lastpos"),
            F.element_at("_gl_at", F.col("_gl_s"))["_gl_t"].alias("_gl_from"),
            F.element_at("_gl_at", (F.col("_gl_s") + F.col("_gl_len") - 1).cast("int"))["_gl_nextt"].alias("_gl_to"),
        )
    )
    by_pos = part.orderBy("_gl_first")
    goes_on = (F.lag("_gl_h").over(by_pos) == F.col("_gl_h")) & (F.lag("_gl_lastpos").over(by_pos) + 1 == F.col("_gl_first"))
    runs = runs.withColumn("_gl_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("_gl_run", F.sum("_gl_new").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("_gl_id", CELL, "_gl_run").agg(
        F.min("_gl_from").alias("_gl_from"),
        F.max(F.struct("_gl_first", "_gl_to"))["_gl_to"].alias("_gl_to"),
        F.min("_gl_first").alias("_gl_first"),
        F.sum(F.col("_gl_lastpos") - F.col("_gl_first") + 1).alias("snapshots"),
        F.first("_gl_h").alias("_gl_h"),
        F.first("_gl_attr").alias("_gl_attr"),
    )


def _power(bit: Column) -> Column:
    """2^bit as BIGINT; 0 for bit -1."""
    return F.floor(F.pow(F.lit(2.0), bit)).cast("long")


def _cell_edges(rows: DataFrame) -> DataFrame:
    """Of each cell of a hot entity: the state before it, the first time and state of the next one."""
    chain = Window.partitionBy("_gl_k").orderBy("_gl_c")
    cells = (
        rows.groupBy(F.col("_gl_id").alias("_gl_k"), F.col(CELL).alias("_gl_c"))
        .agg(F.min(F.struct("_gl_t", "_gl_h")).alias("a"), F.max(F.struct("_gl_t", "_gl_h")).alias("z"))
    )
    return cells.select("_gl_k", "_gl_c", F.lag("z._gl_h").over(chain).alias("_gl_hbefore"), F.lead("a").over(chain).alias("_gl_after"))


def _merged_cells(versions: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The versions of whole entities: those of hot entities joined over the borders of their cells."""
    keep = ["_gl_id", "_gl_from", "_gl_to", "snapshots", "_gl_attr"]
    if edges is None:
        return versions.select(*keep)
    rows = versions.join(F.broadcast(edges), (F.col("_gl_id") == F.col("_gl_k")) & (F.col(CELL) == F.col("_gl_c")), "left")
    last = F.col("_gl_to").isNull()
    rows = rows.withColumn("_gl_cont", F.coalesce((F.col("_gl_first") == 0) & (F.col("_gl_hbefore") == F.col("_gl_h")), F.lit(False)))
    rows = rows.withColumn("_gl_more", F.coalesce(last & (F.col("_gl_after._gl_h") == F.col("_gl_h")), F.lit(False)))
    rows = rows.withColumn("_gl_to", F.coalesce("_gl_to", "_gl_after._gl_t"))
    chained = F.col("_gl_cont") | F.col("_gl_more")
    # at most two chained versions a cell, so this window has at most twice as many rows as its key has cells
    chain = Window.partitionBy("_gl_id").orderBy(CELL, "_gl_first").rowsBetween(Window.unboundedPreceding, 0)
    linked = rows.filter(chained).withColumn("_gl_chain", F.sum(F.when(F.col("_gl_cont"), 0).otherwise(1)).over(chain))
    linked = linked.groupBy("_gl_id", "_gl_chain").agg(
        F.min("_gl_from").alias("_gl_from"),
        F.max(F.struct("_gl_from", "_gl_to"))["_gl_to"].alias("_gl_to"),
        F.sum("snapshots").alias("snapshots"),
        F.first("_gl_attr").alias("_gl_attr"),
    )
    return rows.filter(~chained).select(*keep).unionByName(linked.select(*keep))

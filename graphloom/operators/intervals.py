"""Overlapping and gapped intervals per key: continuous periods and the gaps between them.

Rows are sorted by start within their key, each start is compared with the running maximum of the
earlier ends, and a start beyond it opens a new island. Hot keys are swept in cells cut along
(start, row id), whose running maximum is carried over by a summary with one row per cell; copies
of one row that would fill a cell are merged before they are shuffled (see skew.py). Every row is
shuffled once; the sweep of hot keys reads its shuffle twice.

Defined results: rows with a null key or start, or with an end at or before the start, are left
out; a null end is open and ends nothing; intervals that touch form one period; repeated rows and a
second, open delivery of the same row id count once; a row without id is told apart by its end; an
empty table gives an empty result; further columns are ignored whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import CELL, MIN_ROWS, HotKeys, at_points, carried, hot_keys, with_cells

OPEN = 9223372036854775807
COLUMNS = ["_gl_id", "_gl_s", "_gl_e", "_gl_row"]


def _rows(df: DataFrame, key: str, start: str, end: str, row_id: str | None) -> DataFrame:
    own = F.concat(F.lit("="), F.coalesce(F.col(end).cast("string"), F.lit("")))
    rows = df.select(
        F.col(key).alias("_gl_id"),
        F.col(start).cast("long").alias("_gl_s"),
        F.col(end).cast("long").alias("_gl_e"),
        (F.coalesce(F.col(row_id).cast("string"), own) if row_id else own).alias("_gl_row"),
    )
    return rows.filter(F.col("_gl_id").isNotNull() & F.col("_gl_s").isNotNull())


def _by_start(*cells: str):
    return Window.partitionBy("_gl_id", *cells).orderBy("_gl_s", "_gl_row", F.desc_nulls_last("_gl_e"))


def _swept(rows: DataFrame, *cells: str) -> DataFrame:
    """Valid intervals with _gl_prev, the greatest end of all earlier intervals of the key."""
    order = _by_start(*cells)
    # deliveries of one row share key, start and id, so they are neighbours; the first has the end
    rows = rows.withColumn("_gl_last", F.lag(F.struct("_gl_row", "_gl_s")).over(order))
    again = F.coalesce((F.col("_gl_last._gl_row") == F.col("_gl_row")) & (F.col("_gl_last._gl_s") == F.col("_gl_s")), F.lit(False))
    rows = rows.filter(~again & (F.col("_gl_e").isNull() | (F.col("_gl_e") > F.col("_gl_s"))))
    rows = rows.withColumn("_gl_e", F.coalesce("_gl_e", F.lit(OPEN))).drop("_gl_last")
    rows = rows.withColumn("_gl_prev", F.max("_gl_e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    if cells:
        rows = carried(rows, "_gl_id", F.col("_gl_e"), "_gl_carry")
        rows = rows.withColumn("_gl_prev", F.greatest("_gl_prev", "_gl_carry")).drop("_gl_carry")
    return rows


def _split(rows: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys, and those of hot keys with their cells, shuffled; None without any."""
    place = F.struct("_gl_s", "_gl_row")
    hot: HotKeys = hot_keys(rows, "_gl_id", place, min_rows)
    if not hot:
        return rows, None
    theirs = rows
    if hot.points:
        copies, theirs = at_points(theirs, hot, "_gl_id", place)
        theirs = theirs.unionByName(copies.groupBy("_gl_id", "_gl_s", "_gl_row").agg(F.max("_gl_e").alias("_gl_e")))
    return hot.but(rows, "_gl_id"), with_cells(theirs, hot, "_gl_id", place).select(*COLUMNS, CELL).repartition("_gl_id", CELL)


def gaps(df: DataFrame, key: str, start: str, end: str, row_id: str | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """(key, gapFrom, gapTo): each maximal stretch between two periods in which no interval lies."""
    rest, theirs = _split(_rows(df, key, start, end, row_id), min_rows)
    swept = _swept(rest)
    if theirs is not None:
        swept = swept.unionByName(_swept(theirs, CELL).drop(CELL))
    return swept.filter(F.col("_gl_s") > F.col("_gl_prev")).select(F.col("_gl_id").alias(key), F.col("_gl_prev").alias("gapFrom"), F.col("_gl_s").alias("gapTo"))


def periods(df: DataFrame, key: str, start: str, end: str, row_id: str | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """(key, periodFrom, periodTo, intervals): the continuous periods; periodTo is null if still open."""

    def islands(rows: DataFrame, *cells: str) -> DataFrame:
        rows = _swept(rows, *cells)
        rows = rows.withColumn("_gl_open", F.when(F.col("_gl_prev").isNull() | (F.col("_gl_s") > F.col("_gl_prev")), F.col("_gl_s")))
        rows = rows.withColumn("_gl_from", F.max("_gl_open").over(_by_start(*cells).rowsBetween(Window.unboundedPreceding, 0)))
        if cells:
            rows = carried(rows, "_gl_id", F.col("_gl_open"), "_gl_carry")
            rows = rows.withColumn("_gl_from", F.greatest("_gl_from", "_gl_carry"))
        island = rows.groupBy(F.col("_gl_id").alias(key), F.col("_gl_from").alias("periodFrom"))
        return island.agg(F.max("_gl_e").alias("_gl_to"), F.count("*").alias("intervals"))

    rest, theirs = _split(_rows(df, key, start, end, row_id), min_rows)
    out = islands(rest)
    if theirs is not None:
        out = out.unionByName(islands(theirs, CELL))
    return out.select(key, "periodFrom", F.when(F.col("_gl_to") < OPEN, F.col("_gl_to")).alias("periodTo"), "intervals")

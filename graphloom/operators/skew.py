"""Splitting of hot keys, so that no single task ever holds a key with a large share of all rows.

Hot keys are found in a sample of the key and order columns, read once when a plan is built; where
there are none, the plan has no part for them at all. A hot key is cut into cells along its order by
quantiles of the sample, so a burst of rows is cut as finely as it is dense. All hot keys together
have at most 2 * PARTS cells, and a key that isn't hot, or a cell, holds about 1/PARTS of all rows or
min_rows, whichever is more: both the table that is broadcast and the rows of a task are bounded.

The order may be a struct; if it tells all different rows apart, only copies of one row share a place
in it. Places that hold more than a cell's worth of rows (`points`) are to be aggregated by the caller
before they are shuffled by cell.

The sample decides where rows are processed, never what the result is.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Most hot keys, and about half the most cells; one part of so many is no hot spot at any scale.
PARTS = 65_536
#: Sampled rows a cell.
SAMPLED = 64
MIN_ROWS = 50_000
SEED = 17

CELL = "_gl_cell"


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table that the driver holds."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)
    plain = lambda v, t: {f.name: plain(x, f.type) for x, f in zip(v, t)} if pa.types.is_struct(t) and v is not None else [plain(x, t.value_type) for x in v] if pa.types.is_list(t) and v is not None else v
    return spark.createDataFrame(pa.table([pa.array([plain(r[k], f.type) for r in rows], f.type) for k, f in enumerate(kinds)], kinds), schema)


@dataclass(frozen=True)
class HotKeys:
    """At most PARTS keys, each with the lower edges of its cells but the first."""

    like: DataFrame
    key_type: T.DataType
    order_type: T.DataType
    edges: dict = field(default_factory=dict)
    points: list[tuple] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.edges)

    def table(self) -> DataFrame:
        """(_gl_key, _gl_edges), to be broadcast."""
        schema = T.StructType([T.StructField("_gl_key", self.key_type), T.StructField("_gl_edges", T.ArrayType(self.order_type))])
        return local_table(self.like.sparkSession, list(self.edges.items()), schema)

    def but(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of all other keys."""
        return df.join(F.broadcast(self.table().select("_gl_key")), F.col(key) == F.col("_gl_key"), "left_anti") if self else df


def _share(min_rows: int) -> float:
    return min(1.0, SAMPLED / min_rows)


def _sampled(df: DataFrame, share: float) -> DataFrame:
    return df if share >= 1 else df.sample(share, SEED)


def heavy(df: DataFrame, keys: list[str], min_rows: int = MIN_ROWS) -> list[tuple]:
    """(keys..., rows): at most PARTS keys with about more than min_rows rows, largest first."""
    share = _share(min_rows)
    n = F.count("*").alias("_gl_n")
    counts = _sampled(df.select(*keys).na.drop(), share).groupBy(*keys).agg(n).filter(F.col("_gl_n") > min_rows * share)
    return [(*r[:-1], r[-1] / share) for r in counts.orderBy(F.desc("_gl_n"), *keys).limit(PARTS).collect()]


def hot_keys(df: DataFrame, key: str, order: Column, min_rows: int = MIN_ROWS, keys: list[tuple] | None = None) -> HotKeys:
    """The keys above min_rows with their cells; `keys` are those of heavy(), if they are known already."""
    rows = df.select(F.col(key).alias("_gl_key"), order.alias("_gl_o"))
    kinds = [f.dataType for f in rows.schema]
    found = heavy(rows, ["_gl_key"], min_rows) if keys is None else keys
    if not found:
        return HotKeys(df, *kinds)
    cell_rows = max(min_rows, sum(n for _, n in found) / PARTS)
    share = _share(cell_rows)  # so the sample has at most about SAMPLED * PARTS rows of hot keys
    wanted = local_table(df.sparkSession, [(k,) for k, _ in found], T.StructType([T.StructField("_gl_k", kinds[0])]))
    sample = _sampled(rows, share).join(F.broadcast(wanted), F.col("_gl_key") == F.col("_gl_k"), "left_semi")
    step = cell_rows * share
    at = F.row_number().over(Window.partitionBy("_gl_key").orderBy("_gl_o")) - 1
    begins = sample.withColumn("_gl_n", at).filter(F.floor(F.col("_gl_n") / step) > F.floor((F.col("_gl_n") - 1) / step)).filter("_gl_n > 0")
    edges: dict = {k: [] for k, _ in found}
    for k, o in begins.select("_gl_key", "_gl_o").collect():  # at most 2 * PARTS rows
        edges[k].append(tuple(o) if isinstance(o, tuple) else o)
    points = [(k, o) for k, os in edges.items() for o, n in Counter(os).items() if n > 1]
    nulls_first = lambda o: tuple((x is not None, x) for x in o) if isinstance(o, tuple) else (o is not None, o)
    return HotKeys(df, *kinds, {k: sorted(set(os), key=nulls_first) for k, os in edges.items()}, points)


def with_cells(df: DataFrame, hot: HotKeys, key: str, order: Column) -> DataFrame:
    """The rows of hot keys with their cell, found by bisection of the edges."""
    rows = df.join(F.broadcast(hot.table()), F.col(key) == F.col("_gl_key")).withColumns({"_gl_o": order, CELL: F.lit(0)})
    step = 1
    while step <= max(map(len, hot.edges.values())):
        step *= 2
    while step:
        rows = rows.withColumn(CELL, F.col(CELL) + F.when(F.get("_gl_edges", F.col(CELL) + (step - 1)) <= F.col("_gl_o"), step).otherwise(0))
        step //= 2
    return rows.drop("_gl_key", "_gl_edges", "_gl_o")


def at_points(df: DataFrame, hot: HotKeys, key: str, order: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of df at points, and those elsewhere. At most PARTS points are broadcast."""
    schema = T.StructType([T.StructField("_gl_pk", hot.key_type), T.StructField("_gl_po", hot.order_type)])
    points = F.broadcast(local_table(hot.like.sparkSession, hot.points, schema))
    there = (F.col(key) == F.col("_gl_pk")) & order.eqNullSafe(F.col("_gl_po"))
    return df.join(points, there, "left_semi"), df.join(points, there, "left_anti")


def carried(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """df (with cells) with column `name`: the maximum of value (BIGINT) in all earlier cells of the key, null in the first.

    The summary has one row a cell of a hot key. It reads the same shuffle as df, if value's columns are in df.
    """
    before = Window.partitionBy("_gl_k").orderBy("_gl_c").rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(F.col(key).alias("_gl_k"), F.col(CELL).alias("_gl_c")).agg(F.max(value).alias("_gl_v")).select("_gl_k", "_gl_c", F.max("_gl_v").over(before).alias(name))
    return df.join(F.broadcast(summary), (F.col(key) == F.col("_gl_k")) & (F.col(CELL) == F.col("_gl_c")), "left").drop("_gl_k", "_gl_c")

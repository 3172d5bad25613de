"""The relational test tables as a property graph: regions and nations are folders, customers files,
suppliers test suites, orders imports and parts functions.

CALLS_TO links the parts of consecutive lines of an order. Edges are distinct. A session writes the
nodes and the edges of a folder once, when a query first reads them, into its checkpoint folder; edges
lie apart by type, so a query reads only the types it names. One type is written after the other, each
from a shuffle of its keys as numbers by source, which serves the distinct and the order of the files
and is freed before the next: at no time does the disk hold the shuffles of two types.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import PropertyGraph
from graphloom.session import shared_path, shuffles_freed, written
from graphloom.sources.tables import table

_WRITTEN: dict[tuple[str, str, str], str] = {}


COLUMNS = ["id", "type", "project_id", "name", "path", "summary", "valid_from", "valid_to"]


def _ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _node(df: DataFrame, kind: str, node_id, name, path, summary=None, valid_from=None, valid_to=None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        node_id.alias("id"), F.lit(kind).alias("type"), F.lit("demo").alias("project_id"), name.alias("name"), path.alias("path"),
        (null if summary is None else summary).cast("string").alias("summary"),
        (F.lit(0) if valid_from is None else valid_from).cast("long").alias("valid_from"),
        (null if valid_to is None else valid_to).cast("long").alias("valid_to"),
    )


class StoredGraph(PropertyGraph):
    """A graph whose two tables are written when they are first read."""

    def __init__(self, spark: SparkSession, folder: str):
        object.__setattr__(self, "_at", (spark, folder))

    def _read(self, part: str) -> DataFrame:
        spark, folder = self._at
        key = (spark.sparkContext.applicationId, folder, part)
        if key not in _WRITTEN:
            path = shared_path(spark, f"graph-{part}")
            if part == "edges":
                for kind, df in _edges(spark, folder).items():
                    written(df.drop("type"), f"{path}/type={kind}")
            else:
                with shuffles_freed(spark):
                    projected(spark, folder).nodes.write.partitionBy("type").parquet(path)
            _WRITTEN[key] = path
        columns = ["src", "dst", "type"] if part == "edges" else COLUMNS
        return spark.read.parquet(_WRITTEN[key]).select(*columns)

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._read("edges")


def graph_of(spark: SparkSession, folder: str) -> PropertyGraph:
    return StoredGraph(spark, folder)


def projected(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph as a plan over the tables."""
    t = lambda name: table(spark, folder, name)
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    null = F.lit(None).cast("string")
    orders = t("orders").withColumn("_gl_ms", _ms("o_orderdate"))
    after = F.lead("_gl_ms").over(Window.partitionBy("o_custkey").orderBy("_gl_ms", "o_orderkey"))
    nodes = _node(t("region"), "FOLDER", key("r", "r_regionkey"), F.col("r_name"), F.lower("r_name"))
    for part in (
        _node(t("nation"), "FOLDER", key("n", "n_nationkey"), F.col("n_name"), F.concat(F.lit("src/"), F.col("n_name"))),
        _node(t("customer"), "FILE", key("c", "c_custkey"), F.col("c_name"), F.concat(F.lit("src/nation"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_name", F.lit(".ts")), F.col("c_mktsegment")),
        _node(t("supplier"), "TEST_SUITE", key("s", "s_suppkey"), F.col("s_name"), F.concat(F.lit("tests/nation"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".test.ts"))),
        _node(orders, "IMPORT", key("o", "o_orderkey"), F.col("o_orderpriority"), null, None, F.col("_gl_ms"), after),
        _node(t("part"), "FUNCTION", key("p", "p_partkey"), F.col("p_name"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".ts")), F.col("p_type")),
    ):
        nodes = nodes.unionByName(part)
    return PropertyGraph(nodes, reduce(DataFrame.unionByName, _edges(spark, folder).values()))


def _edges(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The edges (src, dst, type) by type."""
    t = lambda name: table(spark, folder, name)
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    # repartitioned by source first, the distinct and the sort need no other shuffle
    pairs = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b")).repartition("a").distinct().sortWithinPartitions("a")
    contains = edge(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "CONTAINS")
    contains = contains.unionByName(edge(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "CONTAINS"))
    contains = contains.unionByName(edge(t("supplier"), key("n", "s_nationkey"), key("s", "s_suppkey"), "CONTAINS"))
    lines = t("lineitem")
    nexts = lines.select(F.col("l_orderkey"), (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee"))
    calls = lines.join(nexts, ["l_orderkey", "l_linenumber"]).filter(F.col("l_partkey") != F.col("callee"))
    return {
        "CONTAINS": contains,
        "IMPORTS": edge(t("orders"), key("c", "o_custkey"), key("o", "o_orderkey"), "IMPORTS"),
        "REFERENCES": edge(pairs(lines, "l_orderkey", "l_partkey"), key("o", "a"), key("p", "b"), "REFERENCES"),
        "TESTS": edge(pairs(lines, "l_suppkey", "l_partkey"), key("s", "a"), key("p", "b"), "TESTS"),
        "CALLS_TO": edge(pairs(calls, "l_partkey", "callee"), key("p", "a"), key("p", "b"), "CALLS_TO"),
    }


NODES_SQL = """gnodes AS (
  SELECT 'r:' || r_regionkey AS id, 'FOLDER' AS type, r_name AS name, lower(r_name) AS path, NULL AS summary, 0 AS valid_from, NULL AS valid_to FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'FOLDER', n_name, 'src/' || n_name, NULL, 0, NULL FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'FILE', c_name, 'src/nation' || c_nationkey || '/' || c_name || '.ts', c_mktsegment, 0, NULL FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'TEST_SUITE', s_name, 'tests/nation' || s_nationkey || '/' || s_name || '.test.ts', NULL, 0, NULL FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'IMPORT', o_orderpriority, NULL, NULL, epoch_ms(o_orderdate),
    lead(epoch_ms(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'FUNCTION', p_name, 'src/' || p_brand || '/' || p_partkey || '.ts', p_type, 0, NULL FROM part)"""
EDGES_SQL = """gedges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'IMPORTS' FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'REFERENCES' FROM lineitem
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'TESTS' FROM lineitem
  UNION ALL SELECT DISTINCT 'p:' || a.l_partkey, 'p:' || b.l_partkey, 'CALLS_TO' FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey)"""
GRAPH_SQL = f"WITH RECURSIVE {NODES_SQL},\n{EDGES_SQL}"

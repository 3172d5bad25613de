"""The stored graph: versioned parquet snapshots, upserts, purges, digests, exports.

A write makes a new snapshot folder and then moves a small pointer file, so readers see the old or
the new state and a failed write leaves the old one. Tables are partitioned by label or type, so
scans of a label read only its folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import PropertyGraph


class GraphStore:
    """Snapshots of named tables below a folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> dict | None:
        """Version and schema now; a pointer lost in the middle of its move leaves its next file behind."""
        for suffix in ("CURRENT", "NEXT"):
            path = f"{self.root}/{name}/{suffix}"
            fs, p = self._fs(path)
            if fs.exists(p):
                return json.loads(self.spark.read.text(path, wholetext=True).first()[0])
        return None

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        now = self._current(name)
        if now is None:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        # the schema is kept, as an empty partitioned table has no file to tell it
        return self.spark.read.schema(T.StructType.fromJson(now["schema"])).parquet(f"{self.root}/{name}/v{now['version']:08d}")

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        version = (self._current(name) or {"version": 0})["version"] + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/v{version:08d}")
        fs, target = self._fs(f"{self.root}/{name}/CURRENT")
        _, draft = self._fs(f"{self.root}/{name}/NEXT")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "schema": json.loads(df.schema.json())}), "utf-8"))
        out.close()
        fs.delete(target, False)
        fs.rename(draft, target)
        return version

    def upsert(self, name: str, df: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = ()) -> int:
        """Rows of df replace stored rows with their keys; one row per key stays."""
        new = df.dropDuplicates(list(keys))
        if self.exists(name):
            old = self.read(name)
            new = old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
        return self.write(name, new, partition_by)

    def write_graph(self, graph: PropertyGraph) -> None:
        """Nodes first, then the edges whose ends exist."""
        self.upsert("nodes", graph.nodes, ["id"], ["type"])
        ids = self.read("nodes").select("id")
        ends = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        self.upsert("edges", ends, ["src", "dst", "type"], ["type"])

    def graph(self) -> PropertyGraph:
        return PropertyGraph(self.read("nodes"), self.read("edges"))

    def purge(self, project: str) -> None:
        """All nodes of a project, in any case of its name, with their edges."""
        nodes = self.read("nodes")
        gone = nodes.filter(F.lower("project_id") == project.lower()).select("id")
        edges = self.read("edges").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        self.write("edges", edges, ["type"])
        self.write("nodes", nodes.join(gone, "id", "left_anti"), ["type"])

    def write_vectors(self, df: DataFrame, project: str) -> int:
        """Replace the vectors (id, project_id, vector, ...) of a project; at least 95 % must be stored."""
        expected = df.count()
        if self.exists("vectors"):
            df = self.read("vectors").filter(F.col("project_id") != project).unionByName(df, allowMissingColumns=True)
        self.write("vectors", df, ["project_id"])
        stored = self.read("vectors").filter(F.col("project_id") == project).count()
        if stored < 0.95 * expected:
            raise RuntimeError(f"stored {stored} of {expected} vectors")
        return stored

    def changed(self, digests: DataFrame, key: str = "relative_path") -> DataFrame:
        """(key, change) of files (key, hash) against the stored digests; all new without any."""
        from graphloom.operators.temporal import changes

        if not self.exists("digests"):
            return digests.select(key, F.lit("new").alias("change"))
        return changes(digests, self.read("digests"), key)

    def export(self, df: DataFrame, name: str) -> str:
        """JSON lines of a table; vectors are left out."""
        path = f"{self.root}/export/{name}"
        df.drop("vector").write.mode("overwrite").json(path)
        return path


def sync(base: PropertyGraph, other: PropertyGraph) -> PropertyGraph:
    """base with other's nodes laid over it (label, columns and props of other win) and its edges, once each."""
    b, o = base.nodes.alias("b"), other.nodes.alias("o")
    both = b.join(o, F.col("b.id") == F.col("o.id"), "full_outer")
    columns = []
    for c in base.nodes.columns:
        if c == "props":
            empty = F.create_map().cast("map<string,string>")
            mine, theirs = F.coalesce(F.col("b.props"), empty), F.coalesce(F.col("o.props"), empty)
            columns.append(F.map_concat(F.map_filter(mine, lambda k, _: ~F.array_contains(F.map_keys(theirs), k)), theirs).alias(c))
        else:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c))
    edges = base.edges.unionByName(other.edges, allowMissingColumns=True).dropDuplicates(["src", "dst", "type"])
    return PropertyGraph(both.select(*columns), edges)


def statistics(graph: PropertyGraph) -> dict:
    """Counts by label and by relationship type, for a JSON snapshot; a few dozen rows at most."""
    from graphloom.operators.traverse import census

    count = lambda df: {r["type"]: r["n"] for r in census(df).collect()}
    nodes, edges = count(graph.nodes), count(graph.edges)
    return json.loads(json.dumps({"totalNodes": sum(nodes.values()), "totalRelationships": sum(edges.values()), "nodesByType": nodes, "relationshipsByType": edges}))

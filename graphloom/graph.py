"""PropertyGraph: nodes and edges as DataFrames, with scans, scope, time and adjacency."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alive_at(at: int | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether the half-open interval of a row contains an instant; a null end is open."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, type and any columns; edges: src, dst, type and any columns."""

    nodes: DataFrame
    edges: DataFrame

    def label(self, *types: str) -> DataFrame:
        """Nodes with one of the labels; pushed down to the scan."""
        return self.nodes.filter(F.col("type").isin(*types))

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("type").isin(*types)) if types else self.edges

    def outgoing(self, node_id: str) -> DataFrame:
        return self.edges.filter(F.col("src") == node_id)

    def incoming(self, node_id: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == node_id)

    def scope(self, project: str) -> PropertyGraph:
        """The nodes of a project and the edges with both ends in it."""
        nodes = self.nodes.filter(F.lower("project_id") == project.lower())
        ids = nodes.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(nodes, edges.select(*self.edges.columns))

    def as_of(self, at: int) -> PropertyGraph:
        """The nodes valid at an instant and the edges between them."""
        nodes = self.nodes.filter(alive_at(at))
        ids = nodes.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(nodes, edges.select(*self.edges.columns))

    def hop(self, left: DataFrame, on: str, types: Sequence[str], to: str, reverse: bool = False) -> DataFrame:
        """left with column `to`: the other ends of edges of the types from left's column `on`."""
        here, there = ("dst", "src") if reverse else ("src", "dst")
        e = self.edges_of(*types).select(F.col(here).alias("_gl_here"), F.col(there).alias(to))
        return left.join(e, F.col(on) == F.col("_gl_here")).drop("_gl_here")

    def undirected(self) -> DataFrame:
        """(here, there, type): every edge from both of its ends."""
        both = F.explode(F.array(F.struct(F.col("src").alias("here"), F.col("dst").alias("there")), F.struct(F.col("dst").alias("here"), F.col("src").alias("there"))))
        return self.edges.select(both.alias("e"), "type").select("e.here", "e.there", "type")

"""Clusters that grow by batches: new nodes find their cluster among stored ones, and stored ones stay as they are.

In the order of (at, node), a node belongs to the cluster of the first node before it that it has an edge with, or begins
one of its own, named by itself. So the result is a matter of that order alone: batches that follow it, however they are
split, give the same. Stored clusters are merged only by merge().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Log
from ..storage import delete, written
from .graph import components


class ComponentIndex:
    """Parts (node, at, cluster) below a folder, and the names that merged clusters go by, under a log of commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder)

    def _read(self, entries: list[dict]) -> tuple[DataFrame | None, DataFrame | None]:
        """Nodes as they were put in, and the newest table of merged names (cluster, into)."""
        nodes = [f"{self.folder}/{e['nodes']}" for e in entries if "nodes" in e]
        names = [e["names"] for e in entries if "names" in e]
        return self.spark.read.parquet(*nodes) if nodes else None, self.spark.read.parquet(f"{self.folder}/{names[-1]}") if names else None

    @staticmethod
    def _named(nodes: DataFrame, names: DataFrame | None) -> DataFrame:
        if names is None:
            return nodes
        return nodes.join(names, "cluster", "left").select("node", "at", F.coalesce("into", "cluster").alias("cluster"))

    def clusters(self) -> DataFrame | None:
        """(node, at, cluster) of all nodes; None before the first batch."""
        nodes, names = self._read(self.log.entries())
        return None if nodes is None else self._named(nodes, names)

    def _write(self, rows: DataFrame, kind: str) -> str:
        path = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{path}")
        return path

    def add(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Put nodes (node, at) in, with the edges (a, b) between them and to stored ones; returns (node, at, cluster) of the
        new ones. Nodes that are stored keep their cluster, and edges between stored ones say nothing.

        Of the stored nodes those are read that an edge names. New ones that depend on new ones are resolved by halving the
        way to their first one, in a number of rounds that is the logarithm of the longest way. A batch that another writer
        overtook is done again.
        """
        fresh_in = written(nodes.groupBy("node").agg(F.min("at").alias("at")), "nodes")
        both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
        while True:
            entries = self.log.entries()
            stored, names = self._read(entries)
            fresh = fresh_in if stored is None else fresh_in.join(stored.select("node"), "node", "left_anti")
            fresh = written(fresh, "fresh")
            known = fresh.withColumn("cluster", F.lit(None).cast(fresh.schema["node"].dataType))
            if stored is not None:
                touched = stored.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
                known = known.unionByName(self._named(touched, names))
            ends = both.join(fresh.select(F.col("node").alias("b"), F.col("at").alias("b_at")), "b").join(known.withColumnsRenamed({"node": "a", "at": "a_at"}), "a")
            before = ends.filter(F.struct("a_at", "a") < F.struct("b_at", "b"))
            first = before.groupBy("b").agg(F.min_by(F.struct("a", "cluster"), F.struct("a_at", "a")).alias("f"))
            way = fresh.join(first.withColumnRenamed("b", "node"), "node", "left")
            # to: the node whose cluster it is; cluster: known at once by a stored one, or by having none before it
            own = F.when(F.col("f").isNull(), F.col("node")).otherwise(F.col("f.cluster"))
            way = written(way.select("node", "at", F.coalesce("f.a", "node").alias("to"), own.alias("cluster")), "way")
            while not (open_ := way.filter("cluster IS NULL")).isEmpty():
                step = way.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("cluster").alias("_cluster"))
                moved = open_.drop("cluster").join(step, "to").select("node", "at", F.col("_to").alias("to"), F.col("_cluster").alias("cluster"))
                way = written(way.filter("cluster IS NOT NULL").unionByName(moved), "way")
            part = self._write(way.select("node", "at", "cluster"), "nodes")
            if self.log.commit((entries[-1]["version"] if entries else 0) + 1, {"nodes": part}):
                return self.spark.read.parquet(f"{self.folder}/{part}")
            delete(self.spark, f"{self.folder}/{part}")

    def merge(self, edges: DataFrame) -> int:
        """Make one cluster of those that edges (a, b) between stored nodes join, named by the earliest of their names.

        Nodes aren't written again: a table of names, one row for each merged cluster, is. Returns how many names gave way.
        """
        while True:
            entries = self.log.entries()
            stored, names = self._read(entries)
            if stored is None:
                return 0
            now = self._named(stored, names).select("node", "cluster")
            pairs = edges.join(now.withColumnsRenamed({"node": "a", "cluster": "x"}), "a").join(now.withColumnsRenamed({"node": "b", "cluster": "y"}), "b")
            roots = written(components(pairs.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()), "merged")
            dated = roots.join(stored.select("node", "at"), "node")
            into = dated.groupBy("root").agg(F.min_by("node", F.struct("at", "node")).alias("into"))
            new = written(roots.join(into, "root").select(F.col("node").alias("cluster"), "into").filter("cluster <> into"), "names")
            n = new.count()
            if not n:
                return 0
            if names is not None:
                moved = names.join(new.select(F.col("cluster").alias("into"), F.col("into").alias("_into")), "into", "left")
                new = new.unionByName(moved.select("cluster", F.coalesce("_into", "into").alias("into")))
            part = self._write(new, "names")
            if self.log.commit(entries[-1]["version"] + 1, {"names": part}):
                return n
            delete(self.spark, f"{self.folder}/{part}")

"""Snapshots of a link graph kept as tables, compared by a tree of digests: only buckets that differ are read.

A snapshot's pages are dealt to buckets by the hash of their names. A bucket has a digest of its rows, FAN buckets have one of
theirs, and so on up to the root, which the manifest holds. Two snapshots are compared from the root down: subtrees of equal digests
are left alone, and of the others' leaves the rows are read, by filters on the sorted bucket column. Equal digests mean equal rows, but
for collisions of 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .versions import Versions

#: Pages of a bucket, about; buckets of a group, and groups of the next; the most buckets that are listed in a filter.
PAGES, FAN, MAX_LISTED = 16, 16, 2000
MAX_LEVELS = 5


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Versions(spark, root)
        #: Of the last comparison: buckets there are, and those that were read.
        self.buckets: dict[str, int] = {}

    def save(self, pages: DataFrame) -> int:
        """Keeps graph.snapshot(pages) as the next version. The first version's size sets the number of buckets."""
        rows = graph.snapshot(pages)
        after = self.store.latest()
        old = self.store.manifest(after)
        if old:
            levels = old["levels"]
        else:
            n, levels = rows.count(), 1
            while levels < MAX_LEVELS and FAN**levels * PAGES < n:
                levels += 1
        bucket = F.pmod(F.xxhash64("name"), F.lit(FAN**levels))
        # what a difference is made of, in a fixed order
        same = F.struct("name", "type", "title", F.sort_array("tags"), F.sort_array("links"))
        rows = rows.withColumn("bucket", bucket).withColumn("a", F.xxhash64(same)).withColumn("b", F.xxhash64(F.lit(1), same))
        folder = self.store.new_folder("snapshot")
        self.store.write(rows.repartitionByRange("bucket").sortWithinPartitions("bucket", "name"), f"{folder}/rows")
        leaves = self.store.read(f"{folder}/rows").groupBy("bucket").agg(F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b"), F.count(F.lit(1)).alias("n"))
        tree = leaves.select(F.lit(levels).alias("level"), F.col("bucket").alias("node"), "a", "b", "n")
        self.store.write(tree.sortWithinPartitions("node"), f"{folder}/level={levels}")
        below = tree
        for level in range(levels - 1, -1, -1):
            # a digest of the children's digests and places
            below = self.store.read(f"{folder}/level={level + 1}").groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
                F.expr("bit_xor(xxhash64(node, a, b, n))").alias("a"), F.expr("bit_xor(xxhash64(n, b, a, node))").alias("b"), F.sum("n").alias("n")
            )
            below = below.select(F.lit(level).alias("level"), "node", "a", "b", "n")
            self.store.write(below.sortWithinPartitions("node"), f"{folder}/level={level}")
        root = self.store.read(f"{folder}/level=0").first()
        return self.store.commit({"folder": folder, "levels": levels, "root": [root.a, root.b, root.n] if root else []}, after)

    def rows(self, version: int) -> DataFrame:
        """A snapshot as graph.snapshot() gave it."""
        return self.store.read(f"{self.store.manifest(version)['folder']}/rows").drop("bucket", "a", "b")

    def _unequal(self, before: dict, after: dict) -> DataFrame:
        """The leaves (column bucket) whose digests differ."""
        differ = self.spark.createDataFrame([(0,)] if before["root"] != after["root"] else [], "node long")
        for level in range(1, before["levels"] + 1):
            sides = []
            for state, tag in ((before, "x"), (after, "y")):
                nodes = self.store.read(f"{state['folder']}/level={level}").withColumn("up", F.floor(F.col("node") / FAN))
                nodes = nodes.join(differ.select(F.col("node").alias("up")), "up", "left_semi")
                sides.append(nodes.select("node", F.struct("a", "b", "n").alias(tag)))
            both = sides[0].join(sides[1], "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
            # the upper levels are small: at most FAN to the level
            differ = self.spark.createDataFrame([tuple(r) for r in both.collect()], "node long") if level <= 2 else both
        return differ.withColumnRenamed("node", "bucket")

    def _sides(self, old: int, new: int) -> tuple[DataFrame, DataFrame]:
        """The rows of two versions that lie in unequal buckets."""
        before, after = self.store.manifest(old), self.store.manifest(new)
        if before["levels"] != after["levels"]:
            raise ValueError("the snapshots have different numbers of buckets")
        unequal = self._unequal(before, after).persist()
        n = unequal.count()
        self.buckets = {"total": FAN ** before["levels"], "read": n}
        listed = [r.bucket for r in unequal.collect()] if n <= MAX_LISTED else None

        def side(state: dict) -> DataFrame:
            rows = self.store.read(f"{state['folder']}/rows")
            kept = rows.where(F.col("bucket").isin(listed)) if listed is not None else rows.join(unequal, "bucket", "left_semi")
            return kept.drop("bucket", "a", "b")

        return side(before), side(after)

    def diff(self, old: int, new: int) -> DataFrame:
        """added, removed and modified pages, as graph.diff() of the whole snapshots."""
        return graph.diff(*self._sides(old, new))

    def edge_diff(self, old: int, new: int) -> DataFrame:
        """Links added and removed, as graph.edge_diff() of the whole snapshots; a link is in its page's bucket."""
        links = [rows.select(F.col("name").alias("from"), F.explode("links").alias("to")).distinct() for rows in self._sides(old, new)]
        return graph.edge_diff(*links)

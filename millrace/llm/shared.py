"""Tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Written tables under the session's checkpoint folder; a lost executor loses none of them.

    Without the setting a local session gets a folder of its own, as in tests; on a cluster it is an error, as
    a folder of one machine would scatter the tables.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root, self.turn = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", itertools.count()
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """With a bound on its rows, the table is written in files of about 200,000."""
        path = f"{self.root}/{name}-{next(self.turn)}"
        if rows is not None:
            df = df.coalesce(1 + rows // 200_000)
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        return saved

    def drop(self, saved: DataFrame | None) -> None:
        """Deletes a table that `save` returned and that nothing will read any more."""
        path = self.paths.pop(id(saved), None) if saved is not None else None
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """`edges` (a, b) -> (node, component): the smallest node reachable, for every node that is not the smallest.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Minima are partial aggregates and
    the neighbours of a node are never one list, so that adaptive execution can split a node with very many; each
    round is written to the shared folder and the round before it deleted.
    """
    small = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    small = scratch.save(small, "edges", rows)
    before = None
    while True:
        both = small.union(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(lows, both["a"] == lows["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large, "large", rows)
        scratch.drop(small)
        lows = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        linked = large.join(lows, large["a"] == lows["u"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = scratch.save(linked.union(lows.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small", rows)
        scratch.drop(large)
        # a sum of hashes shows whether the edges are the same as after the last round
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return small.select(F.col("a").alias("node"), F.col("b").alias("component"))

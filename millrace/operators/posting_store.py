"""Stored postings in blocks, read by term, with early stop.

A block holds a term's postings in a range of item ids, with the largest weight in it. Blocks lie in folders by a hash of the
term, sorted by term, so that a search reads the folders and row groups of its terms. For each query the largest weights
of its terms in a range bound what an item there can reach; the ranges with the highest bounds are scored first, and
a range whose bound stays below the k-th score found so far is never opened. The result is that of scoring all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.retrieve import bounded, postings, top_k
from millrace.sources.tables import shared_folder

#: Up to so many terms are pushed to the scan as a list.
LISTED_TERMS = 5_000
BLOCK = "term string, span bigint, top double, n bigint, postings array<struct<item_id: bigint, weight: double, n: bigint, positions: array<int>>>, bucket int"


def _rank(weight):
    return F.bround(weight / (weight + 1), 6)


class PostingStore:
    """Postings in the folder `path`, in `buckets` folders; see build."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    @staticmethod
    def build(items: DataFrame, fields: dict[str, str], path: str, buckets: int = 64, ids: int = 1024, parts: int = 8) -> PostingStore:
        """Writes the postings of `items` (item_id and the text columns of `fields`, with their classes).

        A block covers `ids` item ids, so it never has more postings. A bucket is written in up to `parts` tasks by range, so a term
        that a third of the items holds does not meet in one. Postings are shuffled once. Without items the store is empty.
        """
        spark = items.sparkSession
        dealt = PostingStore.dealt(items, fields, buckets, ids, parts)
        dealt.write.partitionBy("bucket").parquet(path)
        return PostingStore(spark, path, buckets)

    @staticmethod
    def dealt(items: DataFrame, fields: dict[str, str], buckets: int, ids: int, parts: int) -> DataFrame:
        """The blocks in the order and the partitions in which they are written."""
        posts = postings(items, fields).withColumn("span", F.floor(F.col("item_id") / ids))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        # dealt as they are to be written, so that the blocks are put together without a second shuffle
        dealt = posts.withColumns({"bucket": bucket, "part": F.pmod("span", F.lit(parts))}).repartition("bucket", "part")
        blocks = dealt.groupBy("bucket", "part", "term", "span").agg(F.max("weight").alias("top"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("item_id", "weight", "n", "positions"))).alias("postings"))
        return blocks.drop("part").sortWithinPartitions("bucket", "term", "span")

    def blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks of the asked terms: by pushed lists of terms and buckets, or, for very many terms, by a join."""
        stored = self.spark.read.schema(BLOCK).parquet(self.path)
        asked = terms.select("term").filter("term IS NOT NULL").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        few = asked.limit(LISTED_TERMS + 1).collect()  # a list for the scan, bounded
        if len(few) <= LISTED_TERMS:
            return stored.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted(r["term"] for r in few)))
        return stored.join(bounded(asked), ["bucket", "term"], "left_semi")

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, item_id, weight, n, positions) of the asked terms, as retrieve.postings gives them."""
        return self.blocks(terms).select("term", F.explode("postings").alias("p")).select("term", "p.item_id", "p.weight", "p.n", "p.positions")

    def bounds(self, terms: DataFrame) -> DataFrame:
        """(query_id, span, bound, n): the highest rank an item of the range can have, and how many items it has at least."""
        heads = self.blocks(terms).select("term", "span", "top", "n")
        sums = heads.join(terms.select("query_id", "term").distinct(), "term").groupBy("query_id", "span").agg(F.sum("top").alias("most"), F.max("n").alias("n"))
        # sums in another order may differ in their last bits
        return sums.select("query_id", "span", _rank(F.col("most") * (1 + 1e-12)).alias("bound"), "n")

    def _scored(self, terms: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
        asked = terms.select("query_id", "term").distinct()
        opened = asked.join(ranges.select("query_id", "span"), "query_id")
        keys = bounded(opened.select("term", "span").distinct())
        hits = self.blocks(terms).join(keys, ["term", "span"], "left_semi").select("term", "span", F.explode("postings").alias("p"))
        summed = hits.select("term", "span", "p.item_id", "p.weight").join(opened, ["term", "span"]).groupBy("query_id", "item_id").agg(F.sum("weight").alias("r"))
        return top_k(summed.select("query_id", "item_id", _rank(F.col("r")).alias("kw_rank")), k, [F.desc("kw_rank"), "item_id"])

    def plan(self, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """First hits of the ranges that are scored first, and the ranges (query_id, span) that must be opened after them."""
        bounds = self._written(self.bounds(terms))
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span").rowsBetween(Window.unboundedPreceding, -1)
        turns = bounds.withColumn("before", F.coalesce(F.sum("n").over(best), F.lit(0)))
        first = self._written(self._scored(terms, turns.filter(F.col("before") < k), k))
        least = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("kw_rank").alias("kth"))
        rest = turns.filter(F.col("before") >= k).join(least, "query_id").filter((F.col("found") < k) | (F.col("bound") >= F.col("kth")))
        return first, rest.select("query_id", "span")

    def _written(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "postings")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keyword_or_leg(self, terms: DataFrame, k: int = 100) -> DataFrame:
        """The rows of retrieve.keyword_or_leg. `terms` is (query_id, term) and is read several times."""
        first, rest = self.plan(terms, k)
        both = first.drop("rank").unionByName(self._scored(terms, rest, k).drop("rank"))
        return top_k(both, k, [F.desc("kw_rank"), "item_id"])

"""Mixing sources to target weights by capped water-filling.

Each source has a weight. The mix is a given share of all sizes; what a source would
get beyond `max_epochs` times its own size goes to the others by weight until no source
is above. Sources sorted by size / weight saturate in that order, so the
fixed point of the redistribution is one running sum over the sources.

A target becomes whole repetitions of every document plus one further
repetition for the documents that come first in a seeded order. The cut of that order is
found from sums over 4,096 slices of it, then within the one slice that holds
it, so no source is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch
from millrace.llm.words import WORD

SLICE_DIGITS = 3


def seeded_order(seed: int) -> Column:
    """A hexadecimal key that orders documents; rows without an id are told apart by their text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """`sizes` has a row (source, source_size) per source; adds weight and target.

    Weights go round over the sources by code point, null last. A source of size 0 has target 0.
    The table has one row a source, so one task orders it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(fill), F.lit(0.0))) / (F.col("_all") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    return (
        sizes.withColumn("weight", weight)
        .withColumns({"_cap": cap, "_ratio": cap / F.col("weight"), "_budget": F.sum("source_size").over(every) * F.lit(float(share)), "_all": F.sum("weight").over(every)})
        .withColumn("_level", level)
        # from the first source that stays below its cap on, all share one level
        .withColumn("_level", F.first(F.when(F.col("_level") * F.col("weight") < F.col("_cap"), F.col("_level")), ignorenulls=True).over(Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("weight"))))
        .select("source", "source_size", "weight", "target")
    )


def plan(sized: DataFrame, **options) -> DataFrame:
    """One row per source: sizes, target, whole repetitions and the cut of the seeded order.

    `sized` has doc columns source, size, order_key.
    """
    slice_of = F.substring("order_key", 1, SLICE_DIGITS)
    cells = sized.groupBy("source", slice_of.alias("slice")).agg(F.sum("size").alias("cell"))
    sizes = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    targets = source_targets(sizes, **options).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("slice")
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    upto = cells.withColumn("upto", F.sum("cell").over(running)).alias("c")
    t = targets.select("source", "rest").alias("t")
    last = (
        upto.join(t, null_safe(cells, targets), "inner")
        .filter((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")))
        .groupBy("c.source")
        .agg(F.min(F.struct("c.slice", (F.col("c.upto") - F.col("c.cell")).alias("before"), "t.rest")).alias("at"))
        .select(F.col("source").alias("l_source"), "at.*")
    )
    inside = sized.join(last, sized["source"].eqNullSafe(F.col("l_source")) & (slice_of == F.col("slice")), "inner")
    reached = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("order_key"))
    cuts = (
        inside.withColumn("reached", reached)
        .groupBy("source")
        .agg(
            F.min("slice").alias("slice"),
            F.min(F.struct(F.abs(F.col("reached") - F.col("rest")).alias("off"), F.col("order_key").alias("key"))).alias("near"),
            F.min(F.abs(F.col("before") - F.col("rest"))).alias("off_before"),
        )
        .select(F.col("source").alias("k_source"), F.when(F.col("off_before") <= F.col("near.off"), F.col("slice")).otherwise(F.concat("near.key", F.lit("~"))).alias("cut"))
    )
    return targets.join(cuts, targets["source"].eqNullSafe(F.col("k_source")), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


ADDED = ("size", "source_size", "target", "repeats", "taken")


def mix(docs: DataFrame, seed: int = 17, broadcast_sources: int = 1_000_000, **options) -> DataFrame:
    """All columns of `docs` plus size, source_size, target, repeats and taken (repeats * size).

    `docs` has doc_id, text and source. Columns with one of the five added names are replaced, all others come
    out as they are, whatever their names. Null sources form one source, a null or empty text has size 0 and is taken
    as often as its source is whole; texts are counted whole. Ties of the seeded order need equal ids, and those share one
    decision, as repeated rows do. An empty table gives no rows. Only sums by source and slice and one
    row a source move between tasks. The rows of the plan go to all tasks up to `broadcast_sources`
    sources, so that no text is shuffled; beyond it sources are joined in 64 salted parts each, so that a hot
    one meets in no single task.
    """
    names = [c for c in docs.columns if c not in ADDED]
    # the caller's row is one column here, so that no name of it can meet a name of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    rows = rows.withColumns({"size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"), "order_key": seeded_order(seed)})
    rows = rows.select("row", "source", "size", "order_key")
    plans = plan(rows.select("source", "size", "order_key"), **options).withColumnRenamed("source", "p_source")
    plans = Scratch(docs.sparkSession, "mix").save(plans, "plan")
    same = rows["source"].eqNullSafe(plans["p_source"])
    if plans.count() <= broadcast_sources:
        joined = rows.join(F.broadcast(plans), same, "left")
    else:
        salt = F.pmod(F.xxhash64("order_key"), F.lit(64))
        spread = plans.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        rows = rows.withColumn("salt", salt)
        joined = rows.join(spread, rows["source"].eqNullSafe(spread["p_source"]) & (rows["salt"] == spread["p_salt"]), "left")
    repeats = F.col("whole") + (F.col("order_key") < F.col("cut")).cast("long")
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "repeats": repeats, "taken": repeats * F.col("size")}
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[added[c].alias(c) for c in ADDED])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP8_CTES = r"""
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, text, '')) AS k FROM {docs}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM s
), f AS (
  SELECT w.*, (SELECT sum(source_size) * 1.5::DOUBLE FROM w) AS budget FROM w
), lv AS (
  SELECT a.source AS at, (any_value(a.budget) - coalesce(sum(2.0::DOUBLE * b.source_size) FILTER (2 * b.source_size / b.weight < 2 * a.source_size / a.weight), 0))
         / sum(b.weight) FILTER (2 * b.source_size / b.weight >= 2 * a.source_size / a.weight) AS level, any_value(2 * a.source_size / a.weight) AS ratio
  FROM f a CROSS JOIN f b GROUP BY a.source
), l AS (
  SELECT min_by(level, ratio) AS level FROM lv WHERE level < ratio
), t AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce((SELECT level FROM l) * weight, 2.0 * source_size))::DOUBLE AS target FROM w
), c AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT source, min_by(upto, (abs(upto - (target - whole * source_size)), k)) AS upto, min(abs(upto - (target - whole * source_size))) AS off,
         any_value(target - whole * source_size) AS rest FROM c GROUP BY source
)"""
OP8_SQL = f"""
WITH {OP8_CTES.format(docs="documents")}
SELECT c.doc_id, c.size, c.source_size, round(c.target, 6) AS target,
       (c.size * (c.whole + CASE WHEN cut.rest > 0 AND cut.off < cut.rest AND c.upto <= cut.upto THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN cut ON c.source IS NOT DISTINCT FROM cut.source
"""

"""Writes: upserts, provenance, ledgers, logs, exports and purges, as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_items(target: DataFrame, batch: DataFrame, key: str = "canonical_url", keep: tuple[str, ...] = ("item_id", "slug", "created_at"), keep_if_null: tuple[str, ...] = ("embedding",), as_of: Column | None = None) -> DataFrame:
    """The new snapshot with a status a row: inserted, updated or kept.

    Rows of the batch without a key are left out (see skipped); of rows with one key the last
    by item_id counts. `keep` columns of known rows never change; `keep_if_null` ones only to a value. With `as_of`
    inserted rows get it as created_at and updated_at, updated rows as updated_at and last_crawled_at, where there are such columns.
    One full outer join on the key.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("item_id")))
    new = batch.filter(F.col(key).isNotNull()).withColumn("_turn", turn).filter("_turn = 1").drop("_turn")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    joined = target.withColumn("_old", F.lit(True)).alias("t").join(n, F.col(f"t.{key}") == F.col(f"n.{key}"), "full")
    inserted, touched = F.col("t._old").isNull(), F.col("n._new").isNotNull()
    out = []
    for c in target.columns:
        old, fresh = F.col(f"t.{c}"), F.col(f"n.{c}") if c in batch.columns else F.lit(None)
        if as_of is not None and c == "created_at":
            value = F.when(inserted, as_of).otherwise(old)
        elif as_of is not None and c == "updated_at":
            value = F.when(touched, as_of).otherwise(old)
        elif as_of is not None and c == "last_crawled_at":
            value = F.when(touched & ~inserted, as_of).otherwise(old)
        elif c == key or c in keep:
            value = F.coalesce(old, fresh)
        elif c in keep_if_null:
            value = F.coalesce(fresh, old)
        else:
            value = F.when(touched, fresh).otherwise(old)
        out.append(value.alias(c))
    status = F.when(inserted, "inserted").when(~touched, "kept").otherwise("updated")
    return joined.select(*out, status.alias("status"))


def skipped(batch: DataFrame, key: str = "canonical_url") -> DataFrame:
    return batch.filter(F.col(key).isNull())


def provenance(snapshot: DataFrame, source: str = "source_type") -> DataFrame:
    """One row a newly inserted item, with the source that the row names."""
    return snapshot.filter("status = 'inserted'").select("item_id", F.col(source).alias("source"))


def ledger_row(snapshot: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(source_type, status, found, changed, inserted, error): what a run brought, per source.

    `errors` (source_type, error) are runs that failed; a source with an error has that status, even if it brought nothing.
    """
    rows = snapshot.filter("status <> 'kept'").groupBy("source_type").agg(F.count("*").alias("found"), F.count_if(F.col("status") == "inserted").alias("inserted"))
    failed = errors if errors is not None else snapshot.sparkSession.createDataFrame([], "source_type string, error string")
    both = rows.join(failed.groupBy("source_type").agg(F.min("error").alias("error")), "source_type", "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return both.select("source_type", F.when(F.col("error").isNull(), "done").otherwise("error").alias("status"), n("found").alias("found"), n("found").alias("changed"), n("inserted").alias("inserted"), "error")


def export_top(items: DataFrame, limit: int, min_quality: float) -> DataFrame:
    return items.filter(F.col("quality") >= min_quality).orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("remix"), "item_id").limit(limit)


def log_impressions(results: DataFrame, depth: int = 20) -> DataFrame:
    """(query_id, impression): the first hits with 0-based positions."""
    top = results.filter(F.col("rank") <= depth)
    return top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((F.col("rank") - 1).alias("pos"), F.col("item_id").alias("id")))).alias("impression"))


def log_actions(actions: DataFrame) -> DataFrame:
    """Clicks and stars; a star without a query is not logged."""
    return actions.filter("kind = 'click' OR (kind = 'star' AND query_id IS NOT NULL)").select("event_id", "kind", "query_id", "item_id", "position")


def purge(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return rows.join(keys.select(F.col(column)).distinct(), column, "left_anti")


def apply_stars(stars: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The pairs after adding, once each, and removing."""
    return stars.unionByName(added).dropDuplicates(["user_id", "item_id"]).join(removed, ["user_id", "item_id"], "left_anti")


def credibility(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """One point a request, whether the pair was new or not."""
    n = requests.groupBy("user_id").agg(F.count("*").alias("n"))
    return profiles.join(n, "user_id", "left").select("user_id", (F.col("credibility") + F.coalesce("n", F.lit(0))).alias("credibility"))


def seed_defaults(items: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    return items.unionByName(seeds.join(items.select(key), key, "left_anti").select(*items.columns))

"""A keyed table in buckets, of which an upsert rewrites only those that its batch touches.

`data` holds folders of rows by bucket, `versions` one manifest a version: which folder each bucket is read from, the last batch
of each source and what that batch brought. A batch is staged by bucket as it is read, once; the buckets it touches are joined
with it and written anew; then the next manifest is put in place in one step. A batch that a manifest names is not applied
again, so a job that dies anywhere and starts over ends with the same table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from millrace.sources import sinks
from millrace.sources.versions import Folder, Log

LEDGER = "version bigint, source string, batch bigint, seen bigint, skipped bigint, gated bigint, inserted bigint, updated bigint, buckets_written bigint"
COUNTERS = ("seen", "skipped", "gated", "inserted", "updated")


class SnapshotStore:
    """The table in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.versions = Folder(spark, self.path), Log(spark, f"{self.path}/versions")

    @staticmethod
    def create(rows: DataFrame, path: str, key: str = "canonical_url", buckets: int = 64) -> SnapshotStore:
        """A new table with these rows, one a key; rows without a key are left out. It fails where there is one already."""
        store = SnapshotStore(rows.sparkSession, path)
        first = {"version": 0, "key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": {}, "batches": {}}
        marked = rows.filter(F.col(key).isNotNull()).withColumns({"_source": F.lit(None).cast("string"), "_batch": F.lit(None).cast("bigint"), "_status": F.lit("kept")})
        first["folders"] = store._write(marked, key, buckets, "start")
        store.versions.append(first)
        return store

    def manifest(self) -> dict:
        return self.versions.last()

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, key: str, buckets: int, name: str) -> dict[str, str]:
        """Writes rows by bucket and gives the folder of each bucket that got any."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(key, buckets)).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return self._folders(folder)

    def _folders(self, folder: str) -> dict[str, str]:
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_bucket=")}

    def _rows(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"])).add("_source", StringType()).add("_batch", LongType()).add("_status", StringType())
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The rows of the last version."""
        now = self.manifest()
        return self._rows(now, list(now["folders"].values())).drop("_source", "_batch", "_status")

    def changes(self) -> DataFrame:
        """The rows with `status`, what the last batch did to them: inserted, updated or kept."""
        now = self.manifest()
        ours = (F.col("_source") == F.lit(now.get("source"))) & (F.col("_batch") == F.lit(now.get("batch")))
        status = F.when(F.coalesce(ours, F.lit(False)), F.col("_status")).otherwise("kept")
        return self._rows(now, list(now["folders"].values())).withColumn("status", status).drop("_source", "_batch", "_status")

    def upsert(self, batch: DataFrame, batch_id: int, source: str = "batch", ok: Column | None = None, **rules) -> dict[str, int]:
        """Applies a batch as sinks.upsert_items does and gives its counters; a batch that is known already changes nothing.

        `batch` is read once. Rows that `ok` does not hold for are counted as gated, those without a key as skipped. Batches of a
        source come in the order of their ids. Of two writers at once one gets a Conflict and may start over.
        """
        now = self.manifest()
        key, buckets = now["key"], now["buckets"]
        if now["batches"].get(source, -1) >= batch_id:
            known = [m for m in map(self.versions.get, self.versions.numbers()) if (m.get("source"), m.get("batch")) == (source, batch_id)]
            return {c: known[-1][c] for c in COUNTERS} if known else dict.fromkeys(COUNTERS, 0)
        read, wrote = Observation(), Observation()
        fine, keyed = F.coalesce(ok if ok is not None else F.lit(True), F.lit(False)), F.col(key).isNotNull()
        marked = batch.withColumn("_ok", fine).observe(read, F.count(F.lit(1)).alias("seen"), F.count_if(~keyed).alias("skipped"), F.count_if(~F.col("_ok")).alias("gated"))
        staging = f"staging/{source}-{batch_id}-{uuid.uuid4().hex}"
        staged = marked.filter(F.col("_ok") & keyed).drop("_ok").withColumn("_bucket", self._bucket(key, buckets))
        staged.write.partitionBy("_bucket").parquet(f"{self.path}/{staging}")
        touched = self._folders(staging)
        counters, folders = {k: int(v) for k, v in read.get.items()} | {"inserted": 0, "updated": 0}, dict(now["folders"])
        if touched:
            fresh = self.spark.read.schema(batch.schema).parquet(*[f"{self.path}/{f}" for f in touched.values()])
            fresh = fresh.withColumns({"_source": F.lit(source), "_batch": F.lit(batch_id).cast("bigint"), "_status": F.lit("")})
            old = self._rows(now, [folders[b] for b in touched if b in folders])
            joined = sinks.upsert_items(old, fresh, key, **rules)
            joined = joined.withColumn("_status", F.when(F.col("status") == "kept", F.col("_status")).otherwise(F.col("status"))).drop("status")
            ours = (F.col("_source") == source) & (F.col("_batch") == batch_id)
            joined = joined.observe(wrote, *[F.count_if(F.coalesce(ours, F.lit(False)) & (F.col("_status") == c)).alias(c) for c in ("inserted", "updated")])
            folders |= self._write(joined, key, buckets, f"{source}-{batch_id}")
            counters |= {k: int(v) for k, v in wrote.get.items()}
        self._swap(now | {"version": now["version"] + 1, "folders": folders, "batches": now["batches"] | {source: batch_id}, "source": source, "batch": batch_id, "buckets_written": len(touched)} | counters)
        self.files.delete(staging)
        return counters

    def _swap(self, manifest: dict) -> None:
        if self.versions.append(manifest) != manifest["version"]:
            raise RuntimeError("a version was skipped")

    def ledger(self) -> DataFrame:
        """One row for each batch that was applied, with its counters."""
        return self.versions.table(LEDGER).filter("batch IS NOT NULL")

    def clean(self) -> list[str]:
        """Deletes folders of rows that the last manifest does not name, and what failed batches left. No writer may be at work."""
        used = {f.rsplit("/", 1)[0].removeprefix("data/") for f in self.manifest()["folders"].values()}
        gone = [f"data/{n}" for n in self.files.names("data") if n not in used] + [f"staging/{n}" for n in self.files.names("staging")]
        for name in gone:
            self.files.delete(name)
        return gone

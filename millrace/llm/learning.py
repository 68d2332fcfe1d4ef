"""Folds, bounded training samples and one-task fits."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPREAD = 1 << 40
#: Up to this many groups of a sample, their sizes go to every task.
BROADCAST_GROUPS = 10_000


def fold(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, limit: int, key: Column, by: str | None = None) -> DataFrame:
    """At most `limit` rows with different keys, of each value of `by` where given: the first by a hash of the key.

    Counts of keys give a hash threshold first, so that about twice `limit` rows of a group
    are ranked in one task, whatever the input; keys that repeat are one row.
    """
    hashed = rows.withColumns({"_key": key, "_group": F.col(by) if by else F.lit("")})
    hashed = hashed.withColumn("_turn", F.pmod(F.xxhash64("_key", F.lit(29)), F.lit(_SPREAD)))
    sizes = hashed.groupBy("_group").agg(F.approx_count_distinct("_key").alias("_keys"))
    known = sizes.limit(BROADCAST_GROUPS + 1).collect()
    if len(known) <= BROADCAST_GROUPS:  # a small table of its own, so that no row is shuffled before it is chosen
        sizes = F.broadcast(rows.sparkSession.createDataFrame(known, sizes.schema))
    near = hashed.join(sizes, "_group").filter(F.col("_turn") / _SPREAD * F.col("_keys") < 2 * limit + 100)
    single = near.dropDuplicates(["_group", "_key"])
    first = F.row_number().over(Window.partitionBy("_group").orderBy("_turn", "_key"))
    return single.withColumn("_first", first).filter(F.col("_first") <= limit).select(*rows.columns)


def fit_in_one_task(sample: DataFrame, fit) -> dict[str, np.ndarray]:
    """`fit(table) -> {name: array}` on a sample whose rows the caller has bounded.

    Only the sample is shuffled into the one task, so reading and choosing stay parallel; only the
    arrays come back to the driver. Without rows there is no model. `fit` must not depend on the order of rows.
    """

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(tables) if tables else None
        out = io.BytesIO()
        np.savez(out, **(fit(table) if table is not None else {}))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    if row is None:
        return {}
    with np.load(io.BytesIO(bytes(row["model"])), allow_pickle=False) as data:
        return {k: data[k] for k in data.files}


def by_rows(cumulative: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums by row of per-word values, given offsets; rows without words have 0."""
    total = np.concatenate([np.zeros((1, *cumulative.shape[1:])), np.cumsum(cumulative, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]

"""Approximate nearest items: an inverted file of cells with compact codes, re-scored exactly.

Cells are the nearest centroids of a k-means; inside a cell an item is 16 bytes, one code word for each sixteenth of its
vector. A query looks at the codes of a few cells, and only its best candidates by code are fetched and scored with
their whole vectors. Centroids and code words come from a bounded sample; every item is indexed. How many cells a query
needs for the wanted recall is measured on rows of the sample: few where near items lie together, about half of
them where vectors are spread evenly.

The index is a folder: `model` has one row, `codes` is partitioned by cell, so that a search reads the cells asked for.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import grid
from millrace.operators.retrieve import top_k

PARTS, WORDS = 16, 256
#: Rows that the fit sees at most, and rows of them that measure the recall.
SAMPLE, PROBED = 20_000, 256
MAX_CELLS = 1024
#: Codes in one stored block, and parts in which a cell is written, so that no task holds a large cell.
BLOCK_ROWS, CELL_PARTS = 16_384, 8
QUERIES_A_BLOCK = 4096


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids; the first ones are rows spread over the sample, an empty cell keeps its centroid."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Model:
    """Centroids, code words (PARTS x WORDS x width / PARTS) and the number of cells a query looks at."""

    centroids: np.ndarray
    words: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def fitted(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of the model's width."""
        x = x[:, : self.width]
        return grid.units(np.pad(x, ((0, 0), (0, self.width - x.shape[1]))))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """For each row the cells it looks at, the nearest first."""
        half = (self.centroids * self.centroids).sum(axis=1) / 2
        return np.argsort(-(unit @ self.centroids.T - half), axis=1, kind="stable")[:, : self.probes]

    def encode(self, unit: np.ndarray) -> np.ndarray:
        step = self.words.shape[2]
        return np.stack([nearest(unit[:, j * step : (j + 1) * step], w) for j, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], axis=1)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, words=self.words, probes=self.probes)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Model:
        with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
            return Model(z["centroids"], z["words"], int(z["probes"]))


def fit(x: np.ndarray, cells: int, recall: float, k: int) -> Model:
    """From a sample of vectors; `recall` is that of the cells alone for the k nearest other rows of the sample."""
    width = -(-x.shape[1] // PARTS) * PARTS
    x = grid.units(np.pad(x, ((0, 0), (0, width - x.shape[1]))))
    step = width // PARTS
    words = np.stack([np.pad(w, ((0, WORDS - len(w)), (0, 0)), mode="edge") for w in (k_means(x[:, j * step : (j + 1) * step], WORDS) for j in range(PARTS))])
    model = Model(k_means(x, cells), words, cells)
    model.probes = len(model.centroids)
    asked = np.linspace(0, len(x) - 1, min(PROBED, len(x))).astype(int)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-sims, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(model.cells(x[asked]), axis=1)  # by cell, how many are looked at before it
    found = np.sort(np.take_along_axis(place, nearest(x, model.centroids)[near], axis=1).reshape(-1))
    if len(found):
        model.probes = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite numbers that is not all zeros."""
    x = F.col(vector)
    return rows.filter(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0))


class VectorIndex:
    """An index in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.model = Model.unpack(spark.read.schema("model binary").parquet(f"{path}/model").first()["model"])

    @staticmethod
    def build(items: DataFrame, path: str, recall: float = 0.97, k: int = 10, sample: int = SAMPLE, cells: int | None = None) -> VectorIndex:
        """Indexes every row (item_id, embedding) that has a finite vector other than zero; repeated ids are kept as they are.

        Only the sample, chosen by a hash of the id, meets in one task; codes are shuffled once, by cell and part of a cell.
        """
        spark = items.sparkSession
        rows = _usable(items.select("item_id", "embedding"), "embedding")
        n = rows.count()
        if not n:
            raise ValueError("no item has a vector")
        size = cells or max(1, min(MAX_CELLS, int(n**0.5)))
        turn = F.pmod(F.xxhash64("item_id", F.lit(7)), F.lit(1 << 40))
        chosen = rows.withColumn("turn", turn).filter(F.col("turn") / (1 << 40) * n <= 2 * sample + 100).orderBy("turn").limit(sample).select("embedding")

        def learn(batches):
            held = [b for b in batches if b.num_rows]
            x = _matrix(pa.Table.from_batches(held).column(0).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([fit(x, size, recall, k).pack()], pa.binary())], names=["model"])

        chosen.coalesce(1).mapInArrow(learn, "model binary").write.parquet(f"{path}/model")
        index = VectorIndex(spark, path)
        shared = spark.sparkContext.broadcast(index.model)

        def encode(batches):
            for batch in batches:
                if batch.num_rows:
                    unit = shared.value.fitted(_matrix(batch.column(1)))
                    codes = shared.value.encode(unit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nearest(unit, shared.value.centroids).astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "item_id", "code"]
                    )

        def pack(table: pa.Table) -> pa.Table:
            plain = table.select(["item_id", "code"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * PARTS, pa.int32()), pa.array(np.frombuffer(b"".join(plain.column("code").to_pylist()), np.uint8)))
            packed = grid._pack(pa.table({"item_id": plain.column("item_id"), "code": lists, "cell": table.column("cell")}))
            return pa.table({"cell": table.column("cell").slice(0, 1), "n": pa.array([len(table)], pa.int64()), "block": pa.array([packed], pa.binary())})

        coded = rows.mapInArrow(encode, "cell int, item_id bigint, code binary")
        # large cells are cut into parts of about BLOCK_ROWS
        parts = max(1, -(-4 * n // (size * BLOCK_ROWS)))
        part = F.pmod(F.xxhash64("item_id", F.lit(11)), F.lit(max(parts, CELL_PARTS if n > size * BLOCK_ROWS else 1)))
        blocks = coded.withColumn("part", part).groupBy("cell", "part").applyInArrow(pack, "cell int, n bigint, block binary")
        blocks.write.partitionBy("cell").parquet(f"{path}/codes")
        return index

    def codes(self) -> DataFrame:
        return self.spark.read.schema("n bigint, block binary, cell int").parquet(f"{self.path}/codes")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, query_vector, cells) with the cells each query looks at, the nearest first."""
        shared = self.spark.sparkContext.broadcast(self.model)

        def look(batches):
            for batch in batches:
                if batch.num_rows:
                    cells = shared.value.cells(shared.value.fitted(_matrix(batch.column(1)))).astype(np.int32)
                    offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1)))], names=["query_id", "query_vector", "cells"])

        return _usable(queries.select("query_id", "query_vector"), "query_vector").mapInArrow(look, "query_id bigint, query_vector array<double>, cells array<int>")

    def candidates(self, queries: DataFrame, depth: int) -> DataFrame:
        """(query_id, item_id, similarity): the `depth` best of each query by code, in the cells it looks at."""
        asked = self.asked(queries)
        n = queries.count()
        # queries of neighbouring cells share a block, so that a block asks for few cells where cells are few a query
        groups = max(1, -(-n // QUERIES_A_BLOCK))
        q = F.floor(F.col("cells")[0] * groups / len(self.model.centroids)).cast("int")
        pairs = asked.select(q.alias("q"), F.explode("cells").alias("cell")).distinct()
        wanted = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # at most MAX_CELLS numbers
        blocks = grid.query_blocks(asked, q)
        if groups * len(self.model.centroids) <= 1_000_000:
            pairs = F.broadcast(pairs)
        if n * self.model.width * 8 <= grid.BROADCAST_BYTES:
            blocks = F.broadcast(blocks)
        met = self.codes().filter(F.col("cell").isin(wanted)).join(pairs, "cell").join(blocks, "q")
        model = self.model
        found = grid.work_through(met, lambda: Coded(depth, model), "query_id bigint, item_id bigint, similarity double")
        return top_k(found, depth, [F.desc("similarity"), "item_id"])

    def search(self, queries: DataFrame, items: DataFrame, k: int = 10, depth: int | None = None) -> DataFrame:
        """(query_id, item_id, similarity, rank): the k nearest of the candidates, by the cosine of whole vectors, to 6 digits.

        `depth` candidates a query are scored, 20 * k where nothing is said, and at most a fifth of all items. Queries without a
        usable vector find nothing.
        """
        total = self.codes().agg(F.sum("n")).first()[0]
        depth = max(k, min(depth or 20 * k, total // 5))
        near = self.candidates(queries, depth).select("query_id", "item_id")
        vectors = items.select("item_id", "embedding").filter("embedding IS NOT NULL")
        scored = near.join(vectors, "item_id").join(queries.select("query_id", "query_vector"), "query_id")
        return top_k(scored.select("query_id", "item_id", F.bround(T.cosine(F.col("query_vector"), F.col("embedding")), 6).alias("similarity")), k, [F.desc("similarity"), "item_id"])


class Coded(grid.Keeper):
    """The best of each query by code, where it looks at the block's cell."""

    def __init__(self, depth: int, model: Model):
        super().__init__(depth)
        self.model = model

    def add(self, q, queries, items):
        lists = queries.column("cells")
        looks = (np.asarray(lists.flatten()).reshape(len(queries.ids), -1) == items.column("cell")[0].as_py()).any(axis=1)
        rows = np.flatnonzero(looks)
        if not len(rows):
            return
        unit, held = self.model.fitted(queries.vectors[rows]), self.model.decode(items.vectors.astype(np.int64))
        found = []
        for start in range(0, len(rows), grid.PANEL):
            sims = np.round(unit[start : start + grid.PANEL] @ held.T, 6)
            row, col = grid.best(sims, self.k)
            found.append((rows[row + start], col, sims[row, col]))
        row, col, score = (np.concatenate(x) for x in zip(*found))
        yield from self.keep(q, [queries.ids[row], np.zeros(len(row), np.int64), items.ids[col], score])

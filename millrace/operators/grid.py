"""All queries against all items, in blocks that meet on a grid key.

Vectors are packed into blocks of some thousand rows, items where they are read. Every block of
queries meets every block of items by an equi join on the number of the query block; a worker in the task
cuts each pair of blocks down and keeps what it needs over all blocks that the task sees, so that a task gives a few
rows a query. Query blocks go to all tasks as a broadcast while their size, counted before, is small. Beyond that, the
cells of the grid are shuffled: items once for each query block, query blocks once for each slice of the
items. The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as pst

#: Bytes of vectors in one block, which bounds the rows of a block.
BLOCK_BYTES = 4 << 20
#: Queries scored at a time, so that their scores of one block take some 30 MB.
PANEL = 256
#: Query vectors of up to so many bytes go to all tasks.
BROADCAST_BYTES = 64 << 20
#: Slices of the items where the cells of the grid are shuffled.
SLICES = 32
#: A worker lets its rows go beyond so many.
HELD_ROWS = 1 << 20


class Block:
    """Ids, a matrix of vectors (shorter ones end in zeros) and further columns of a block."""

    def __init__(self, packed: bytes):
        table = pa.ipc.open_stream(packed).read_all().combine_chunks()
        self.names, self.table = table.column_names, table
        self.ids = table.column(0).to_numpy()
        lists = table.column(1).combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
        width = int(sizes.max()) if len(sizes) else 0
        if (sizes == width).all():
            self.vectors = flat.reshape(len(sizes), width)
        else:
            self.vectors = np.zeros((len(sizes), width))
            self.vectors[np.arange(width) < sizes[:, None]] = flat

    def column(self, name: str) -> pa.Array:
        return self.table.column(name).combine_chunks()


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _rows_a_block(width: int) -> int:
    return max(64, min(16_384, BLOCK_BYTES // max(1, width * 4)))


def item_blocks(items: DataFrame) -> DataFrame:
    """(block): each partition's rows (id, vector, further columns) in blocks, packed where they are read."""

    def run(batches):
        held, rows, most = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            most = max(most, -(-len(batch.column(1).flatten()) // batch.num_rows))
            size = _rows_a_block(most)
            if rows >= size:
                table = pa.Table.from_batches(held)
                for start in range(0, rows - rows % size, size):
                    yield pa.RecordBatch.from_arrays([pa.array([_pack(table.slice(start, size))], pa.binary())], names=["block"])
                rest = table.slice(rows - rows % size)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(pa.Table.from_batches(held))], pa.binary())], names=["block"])

    return items.mapInArrow(run, "block binary")


def query_blocks(queries: DataFrame, q: Column) -> DataFrame:
    """(q, query_block): rows (id, vector, further columns) in one block for each value of `q`, a number."""

    def run(table: pa.Table) -> pa.Table:
        packed = _pack(table.drop_columns(["q"]))
        return pa.table({"q": table.column("q").slice(0, 1), "query_block": pa.array([packed], pa.binary())})

    return queries.withColumn("q", q.cast("int")).groupBy("q").applyInArrow(run, "q int, query_block binary")


class Worker:
    """Gets pairs of blocks; what it yields goes on to the next step, in rows of `schema`."""

    def add(self, q: int, queries: Block, items: Block) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def finish(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def meet(queries: DataFrame, items: DataFrame, worker: Callable[[], Worker], schema: str, broadcast_bytes: int = BROADCAST_BYTES, slices: int = SLICES) -> DataFrame:
    """Rows of one worker a task that has seen each of the task's pairs of a query block and an item block.

    Both sides are (id bigint, vector, further columns) without null vectors. A query id should stand for one row. Without
    queries or items there are no rows.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(queries.columns[1])).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    if not n:
        return items.sparkSession.createDataFrame([], pst._parse_datatype_string(schema))
    groups = -(-n // _rows_a_block(width))
    asked, held = query_blocks(queries, F.pmod(F.xxhash64(queries.columns[0]), F.lit(groups))), item_blocks(items)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    if n * width * 8 <= broadcast_bytes:
        met = held.withColumn("q", every(groups)).join(F.broadcast(asked), "q")
    else:
        cut = held.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("q", every(groups))
        met = cut.join(asked.withColumn("s", every(slices)), ["q", "s"])

    return work_through(met, worker, schema)


def work_through(met: DataFrame, worker: Callable[[], Worker], schema: str) -> DataFrame:
    """One worker a task over pairs (q, query_block, block) of packed blocks."""

    def run(batches):
        work = worker()
        known: dict[int, Block] = {}
        for batch in batches:
            for q, asked, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if q not in known:
                    known = {q: Block(asked.as_py())}
                yield from work.add(q, known[q], Block(block.as_py()))
        yield from work.finish()

    return met.select("q", "query_block", "block").mapInArrow(run, schema)


def first_of_each(groups: list[np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each combination of group columns, by score and then by id, in that order."""
    order = np.lexsort((ids, -score, *groups[::-1]))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    start = np.flatnonzero(fresh)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
    return order[place < k]


def units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, where=norm > 0, out=np.zeros_like(x))


def widths(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same number of columns; missing ones are zeros."""
    w = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == w else np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the finite scores that are not below their row's k-th."""
    if k < scores.shape[1]:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep = scores >= least[:, None]
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & np.isfinite(scores))


class Keeper(Worker):
    """Keeps the k best rows of each (query, part) over the blocks, in numpy columns.

    Rows of a query block are collected and cut to the best when they have doubled, so each is sorted a few times only.
    """

    names: tuple[str, ...] = ("query_id", "item_id", "similarity")

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, list[list[np.ndarray]]] = {}
        self.sizes: dict[int, tuple[int, int]] = {}

    def keep(self, q: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """`columns` are query id, part, item id and score."""
        self.held.setdefault(q, []).append(columns)
        best_, rows = self.sizes.get(q, (0, 0))
        rows += len(columns[0])
        self.sizes[q] = (best_, rows)
        if rows > max(1 << 18, 2 * best_):
            self.cut(q)
        if sum(n for _, n in self.sizes.values()) > HELD_ROWS:
            yield from self.finish()

    def cut(self, q: int) -> None:
        columns = [np.concatenate(parts) for parts in zip(*self.held[q])]
        at = first_of_each(columns[:2], columns[3], columns[2], self.k)
        self.held[q] = [[c[at] for c in columns]]
        self.sizes[q] = (len(at), len(at))

    def batch(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        query, _, item, score = columns
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(item), pa.array(score)], names=list(self.names))

    def finish(self):
        for q in list(self.held):
            self.cut(q)
            (columns,) = self.held.pop(q)
            if len(columns[0]):
                yield self.batch(columns)
        self.sizes = {}


class Nearest(Keeper):
    """The k nearest items of each query by cosine, rounded to 6 digits.

    `below` names a query column of upper limits (exclusive). `part` names a bigint query column that tells rows of one id
    apart and comes out after the id; without it there should be one row a query.
    """

    def __init__(self, k: int, below: str | None = None, part: str | None = None):
        super().__init__(k)
        self.below, self.part = below, part

    def batch(self, columns):
        if self.part is None:
            return super().batch(columns)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", self.part, "item_id", "similarity"])

    def add(self, q, queries, items):
        a, b = widths(units(queries.vectors), units(items.vectors))
        limit = queries.column(self.below).to_numpy(zero_copy_only=False) if self.below else None
        part = queries.column(self.part).to_numpy() if self.part else np.zeros(len(a), np.int64)
        found = []
        for start in range(0, len(a), PANEL):
            sims = np.round(a[start : start + PANEL] @ b.T, 6) + 0.0
            sims[np.isnan(sims)] = -np.inf  # a vector with a null or non-finite component is near nothing
            if limit is not None:
                sims[~(sims < limit[start : start + PANEL, None])] = -np.inf
            row, col = best(sims, self.k)
            found.append((row + start, col, sims[row, col]))
        row, col, score = (np.concatenate(x) for x in zip(*found))
        yield from self.keep(q, [queries.ids[row], part[row], items.ids[col], score])


class Above(Worker):
    """Every pair with a cosine, rounded to 6 digits, of at least `least`. Nothing is held: the pairs of a panel go on at once."""

    def __init__(self, least: float):
        self.least = least

    def add(self, q, queries, items):
        a, b = widths(units(queries.vectors), units(items.vectors))
        for start in range(0, len(a), PANEL):
            sims = np.round(a[start : start + PANEL] @ b.T, 6) + 0.0
            row, col = np.nonzero(sims >= self.least)
            if len(row):
                columns = (queries.ids[row + start], items.ids[col], sims[row, col])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "item_id", "similarity"])

    def finish(self):
        return iter(())


class SharedCells(Keeper):
    """The k nearest items of each query by cosine among those that share one of its `cells` and lie within `radius`.

    Both sides have a list of as many cells a row; cells are compared by their place in it.
    """

    def __init__(self, k: int, radius: float):
        super().__init__(k)
        self.radius = radius

    @staticmethod
    def cells(block: Block) -> np.ndarray:
        return block.column("cells").flatten().to_numpy().reshape(len(block.ids), -1)

    def add(self, q, queries, items):
        a, b = widths(queries.vectors, items.vectors)
        own, other = self.cells(queries), self.cells(items)
        unit_a, unit_b, square = units(a), units(b), (b * b).sum(axis=1)
        for start in range(0, len(a), PANEL):
            part = slice(start, start + PANEL)
            far = (a[part] * a[part]).sum(axis=1)[:, None] + square - 2 * (a[part] @ b.T) >= self.radius**2
            shared = np.zeros(far.shape, bool)
            for t in range(own.shape[1]):
                shared |= own[part, t][:, None] == other[:, t]
            sims = np.round(unit_a[part] @ unit_b.T, 6) + 0.0
            sims[far | ~shared | np.isnan(sims)] = -np.inf
            row, col = best(sims, self.k)
            yield from self.keep(q, [queries.ids[row + start], np.zeros(len(row), np.int64), items.ids[col], sims[row, col]])

"""Boosted trees for ranking: histogram split search over lambda gradients.

A query's hits are one packed row, so gradients, which need the order of a whole query, never cross tasks. Up to FIT_BYTES of packed
hits are sent to a task for each model, which grows all its trees. Beyond it each level of a tree is one
job: tasks sum gradients by leaf, feature and bin, a groupBy adds the sums of all tasks up, and the driver, which sees these few
thousand sums only, chooses the splits; the models of all folds grow in the same jobs.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Bytes of packed hits up to which a task holds all of them, and bytes of a hit besides its bins.
FIT_BYTES = 32 << 20
HIT_BYTES = 8
#: Sums (feature, bin, [g, h, n]) of the open leaves of models.
Sums = dict[tuple[int, int], np.ndarray]


@dataclass
class Tree:
    """Nodes as columns; a leaf has feature -1. A row goes left if its bin is at most the node's."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, n, n + 1
        for column, start in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [start, start]
        return n, n + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, bin_, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (feature[at] >= 0).any():
            f = feature[at]
            at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= bin_[at], left[at], right[at]))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


@dataclass
class Ranker:
    """Cut points of each feature and the trees over the bins between them."""

    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return sum((t.predict(b) for t in self.trees), np.zeros(len(x)))

    def dump(self) -> dict:
        return {"cuts": self.cuts, "trees": [vars(t) for t in self.trees]}

    @staticmethod
    def load(data: dict) -> Ranker:
        return Ranker(data["cuts"], [Tree(**t) for t in data["trees"]])


def lambdas(score: np.ndarray, grade: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of a query's hits: each pair of a better and a worse one, one of them among the first `depth`, pulls
    by the change of nDCG that a swap would bring."""
    gain = 2.0**grade - 1
    place = np.empty(len(score), np.int64)
    place[np.argsort(-score, kind="stable")] = np.arange(len(score))
    discount = np.where(place < depth, 1 / np.log2(place + 2), 0.0)
    ideal = (np.sort(gain)[::-1][:depth] / np.log2(np.arange(min(depth, len(gain))) + 2)).sum()
    if ideal <= 0:
        return np.zeros(len(score)), np.zeros(len(score))
    # no other pair can change the sum
    top = np.flatnonzero(place < depth)
    order = np.sign(grade[top, None] - grade[None, :])
    change = np.abs((gain[top, None] - gain[None, :]) * (discount[top, None] - discount[None, :])) / ideal
    change[:, top] /= 2  # both of them are among the first, so the pair comes twice
    rho = 1 / (1 + np.exp(np.clip(order * (score[top, None] - score[None, :]), -50, 50)))
    pull, curve = order * change * rho, change * rho * (1 - rho)
    g, h = pull.sum(axis=0), curve.sum(axis=0)
    g[top] -= pull.sum(axis=1)
    h[top] += curve.sum(axis=1)
    return g, h


def packed(rows: DataFrame, features: tuple[str, ...], cuts: list[list[float]]) -> DataFrame:
    """(query_id, fold, n, bins, grades, base): one row a query; `rows` has query_id, fold, grade and the features."""
    ranker = Ranker(cuts)

    def pack(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(f).to_numpy() for f in features], axis=1)
        grade = table.column("grade").to_numpy().astype(np.float64)
        one = {"query_id": table.column("query_id").slice(0, 1), "fold": table.column("fold").slice(0, 1), "n": pa.array([len(table)])}
        return pa.table(one | {"bins": pa.array([ranker.bins(x).tobytes()], pa.binary()), "grades": pa.array([grade.tobytes()], pa.binary())})

    chosen = rows.select("query_id", F.col("fold").cast("int").alias("fold"), "item_id", F.col("grade").cast("double").alias("grade"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    # gradients depend on the order of equal scores, so hits have one
    return chosen.repartition("query_id").sortWithinPartitions("query_id", "item_id").groupBy("query_id").applyInArrow(pack, "query_id bigint, fold int, n bigint, bins binary, grades binary")


def train(
    rows: DataFrame, features: tuple[str, ...], save: Callable[[DataFrame], DataFrame], folds: int = 0, trees: int = 120, leaves: int = 15, rate: float = 0.08, least: int = 10, depth: int = 30, smooth: float = 1.0
) -> list[Ranker]:
    """A ranker for each fold, fitted on the queries of the other folds, and one fitted on all queries, last.

    `rows` has query_id, item_id, fold, grade (0 where there is none) and the features; nulls count as 0. A query's hits are one group,
    so they must be few: those of a search are. `save` writes a table that all jobs read. A split must leave `least` hits on both
    sides and have a gain; a model that finds none stops. Without rows the rankers are empty.
    """
    quantiles = [i / BINS for i in range(1, BINS)]
    cuts = [sorted(set(c)) for c in rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).approxQuantile(list(features), quantiles, 0.001)]
    table = save(packed(rows, features, cuts))
    width = len(features)
    options = (cuts, folds, trees, leaves, rate, least, smooth)
    n = table.agg(F.sum("n")).first()[0] or 0
    if not n:
        return [Ranker(cuts) for _ in range(folds + 1)]
    if n * (width + HIT_BYTES) > FIT_BYTES:
        return grow(functools.partial(_sums, table, width=width, folds=folds, depth=depth), set(range(folds + 1)), *options)
    spark = table.sparkSession
    held = spark.sparkContext.broadcast([tuple(r) for r in table.select("fold", "n", "bins", "grades").orderBy("query_id").collect()])

    def run(batches):
        for batch in batches:
            for m in batch.column(0).to_pylist():
                found = grow(Held(held.value, width, folds, depth).sums, {m}, *options)[m]
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([json.dumps(found.dump())])], names=["m", "model"])

    made = spark.range(0, folds + 1, 1, folds + 1).mapInArrow(run, "m bigint, model string").collect()
    held.destroy()
    return [Ranker.load(json.loads(r["model"])) for r in sorted(made, key=lambda r: r["m"])]


class Held:
    """All hits in one task: scores and gradients of a model are made once a tree."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]], width: int, folds: int, depth: int):
        fold, n, bins, grades = zip(*rows)
        self.x, self.grade = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, width), np.frombuffer(b"".join(grades))
        self.ends, self.folds, self.last, self.depth = np.cumsum([0, *n]), np.repeat(np.array(fold, np.int64), n), folds, depth
        self.known: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}

    def sums(self, models: list[Ranker], young: dict[int, Tree], open_: dict[int, list[int]]) -> Sums:
        out: Sums = {}
        for m in (m for m, o in open_.items() if o):
            trees = models[m].trees
            done, score, g, h = self.known.get(m, (-1, np.zeros(len(self.x)), None, None))
            if done < len(trees):
                score = sum((t.predict(self.x) for t in trees[max(0, done) :]), score)
                g, h = slopes(score, self.grade, self.ends, self.depth)
                self.known[m] = len(trees), score, g, h
            add_sums(out, m, young[m], open_[m], self.x, g, h, (self.folds == m) & (m < self.last))
        return out


def slopes(score: np.ndarray, grade: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """`lambdas` of each query."""
    g, h = zip(*[lambdas(score[i:j], grade[i:j], depth) for i, j in zip(ends, ends[1:])])
    return np.concatenate(g), np.concatenate(h)


def add_sums(out: Sums, m: int, tree: Tree, open_: list[int], x: np.ndarray, g: np.ndarray, h: np.ndarray, kept_out: np.ndarray) -> None:
    """Adds the sums of a model's open leaves over the hits that it learns from."""
    at = np.where(kept_out, -1, tree.leaves(x))
    for leaf in open_:
        here = np.flatnonzero(at == leaf)
        s = out.setdefault((m, leaf), np.zeros((x.shape[1], BINS, 3)))
        for j in range(x.shape[1]):
            b = x[here, j]
            for k, w in enumerate((g[here], h[here], None)):
                s[j, :, k] += np.bincount(b, w, BINS)


def grow(sums_of: Callable[[list[Ranker], dict[int, Tree], dict[int, list[int]]], Sums], growing: set[int], cuts: list[list[float]], folds: int, trees: int, leaves: int, rate: float, least: int, smooth: float) -> list[Ranker]:
    """The rankers, of which those of `growing` get trees; `sums_of` gives the sums of all hits for their open leaves."""
    models = [Ranker(cuts) for _ in range(folds + 1)]
    for _ in range(trees):
        young = {m: Tree() for m in growing}
        open_ = {m: [0] for m in growing}  # leaves that may be split
        totals: dict[tuple[int, int], tuple[float, float]] = {}
        first = True
        while any(open_.values()):
            sums = sums_of(models, young, open_)
            for m in sorted(m for m, o in open_.items() if o):
                found = []
                for leaf in open_[m]:
                    h = sums.get((m, leaf))
                    if h is None:
                        continue
                    totals[m, leaf] = tuple(h[0].sum(axis=0)[:2])
                    found += _best_split(h, leaf, least, smooth)
                grown = []
                for gain, leaf, f, b in sorted(found, reverse=True):
                    if sum(x < 0 for x in young[m].feature) >= leaves:
                        break
                    grown += young[m].split(leaf, f, b)
                if first and not grown:
                    growing.discard(m)
                open_[m] = grown
            first = False
            # leaves of the last round need their sums only
            if all(sum(x < 0 for x in young[m].feature) >= leaves for m, o in open_.items() if o) and any(open_.values()):
                for key, h in sums_of(models, young, open_).items():
                    totals[key] = tuple(h[0].sum(axis=0)[:2])
                break
        for m, tree in young.items():
            if m in growing:
                for leaf, f in enumerate(tree.feature):
                    if f < 0 and (m, leaf) in totals:
                        g, h = totals[m, leaf]
                        tree.value[leaf] = float(-rate * g / (h + smooth))
                models[m].trees.append(tree)
        if not growing:
            break
    return models


def _best_split(h: np.ndarray, leaf: int, least: int, smooth: float) -> list[tuple[float, int, int, int]]:
    """(gain, leaf, feature, bin) of the best split of sums (feature, bin, [g, h, n]), if there is one."""
    left = np.cumsum(h, axis=1)
    all_ = left[:, -1:, :]
    right = all_ - left
    part = lambda s: s[..., 0] ** 2 / (s[..., 1] + smooth)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), part(left) + part(right) - part(all_), -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return [(float(gain[f, b]), leaf, int(f), int(b))] if gain[f, b] > 1e-9 else []


def _sums(table: DataFrame, models: list[Ranker], young: dict[int, Tree], open_: dict[int, list[int]], width: int, folds: int, depth: int) -> Sums:
    """Sums (feature, bin, [g, h, n]) of each model's open leaves over the queries it learns from."""
    shared = table.sparkSession.sparkContext.broadcast((models, young, {m: o for m, o in open_.items() if o}))

    def run(batches):
        done, fresh, open_now = shared.value
        out: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, n, bins, grades = (batch.column(c).to_pylist() for c in range(1, 5))
            x, grade = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, width), np.frombuffer(b"".join(grades))
            ends, folds_ = np.cumsum([0, *n]), np.repeat(fold, n)
            for m, leaves_ in open_now.items():
                score = sum((t.predict(x) for t in done[m].trees), np.zeros(len(x)))
                add_sums(out, m, fresh[m], leaves_, x, *slopes(score, grade, ends, depth), (folds_ == m) & (m < folds))
        for (m, leaf), s in out.items():
            j, b = np.nonzero(s[..., 2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), v, np.int32)) for v in (m, leaf)] + [pa.array(c.astype(np.int32)) for c in (j, b)] + [pa.array(s[j, b, k]) for k in range(3)], names=["m", "leaf", "j", "b", "g", "h", "n"])

    parts = table.mapInArrow(run, "m int, leaf int, j int, b int, g double, h double, n double")
    sums: dict[tuple[int, int], np.ndarray] = {}
    # at most leaves * features * bins rows a model
    for m, leaf, j, b, g, h, n in parts.groupBy("m", "leaf", "j", "b").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect():
        sums.setdefault((m, leaf), np.zeros((width, BINS, 3)))[j, b] = g, h, n
    shared.destroy()
    return sums


def with_score(rows: DataFrame, features: tuple[str, ...], rankers: list[Ranker], fold: str | None = None, name: str = "score") -> DataFrame:
    """Adds the score of the last ranker, or of the one that the number in column `fold` names, in Arrow batches."""

    @F.pandas_udf("double")
    def score(which: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.stack([c.fillna(0.0).to_numpy(float) for c in columns], axis=1)
        out = np.zeros(len(x))
        for m in np.unique(which):
            at = np.flatnonzero(which.to_numpy() == m)
            out[at] = rankers[m].score(x[at])
        return pd.Series(out)

    return rows.withColumn(name, F.bround(score(F.col(fold).cast("int") if fold else F.lit(len(rankers) - 1), *[F.col(f).cast("double") for f in features]), 6))

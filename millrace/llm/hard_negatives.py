"""Hard-negative mining by slot-decomposed selection.

An anchor's positives each ask for the best rows of other labels within a window of scores that ends
clearly below the positive. The windows overlap. Their upper limits, which fall with the positives, cut the scores
into disjoint slots, and one pass over the rows answers all windows: a combiner in every
task keeps the k best rows of each slot, the k best over all tasks are found by a window, and merges from the lowest
slot upwards give for each positive the k best rows below its limit. The lower limit then cuts the tail of that list, as
the list is in descending order.

Anchors meet rows in blocks (`operators.grid`): no row is paired with another outside a matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch
from millrace.operators import grid

EXACT = 2.0**53
#: 100 times a score must fit into 64 bits.
TOO_LARGE = 1 << 56


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: as doubles where no sum can pass 2**53, else as Python integers."""
    a, b = grid.widths(a, b)
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    return whole(a) @ whole(b).T


class Positives(grid.Keeper):
    """The first rows of an anchor's label that are not the anchor."""

    names = ("anchor_id", "positive_id", "score")

    def add(self, q, queries, items):
        a, b = np.floor(256 * queries.vectors), np.floor(256 * items.vectors)
        own, theirs = (x.column("label").to_numpy() for x in (queries, items))
        order = np.argsort(theirs, kind="stable")
        found = []
        for label in np.unique(own):
            rows = np.flatnonzero(own == label)
            cols = order[np.searchsorted(theirs[order], label) : np.searchsorted(theirs[order], label, side="right")]
            for start in range(0, len(rows) if len(cols) else 0, grid.PANEL):
                part = rows[start : start + grid.PANEL]
                scores = products(a[part], b[cols])
                near = np.where(queries.ids[part, None] != items.ids[None, cols], scores.astype(float), -np.inf)
                row, col = grid.best(near, self.k)
                found.append((queries.ids[part[row]], items.ids[cols[col]], whole(scores[row, col])))
        if found:
            anchor, item, score = (np.concatenate(x) for x in zip(*found))
            yield from self.keep(q, [anchor, np.zeros(len(anchor), np.int64), item, score])


def whole(scores: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; larger scores are an error, as their windows could not be computed."""
    if scores.dtype == object and len(scores) and max(map(abs, scores)) >= TOO_LARGE:
        raise OverflowError("an inner product passes 2**56")
    return scores.astype(np.int64)


def limits(positives: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest whole score of each window: least * p <= 100 * s <= most * p, for whole p."""
    return -((-least * positives) // 100), (most * positives) // 100


class Slots(grid.Keeper):
    """The k best rows of other labels in each slot of each anchor."""

    names = ("anchor_id", "slot", "negative_id", "score")

    def __init__(self, k: int, least: int, most: int):
        super().__init__(k)
        self.least, self.most = least, most

    def batch(self, columns):
        anchor, slot, item, score = columns
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(slot.astype(np.int32)), pa.array(item), pa.array(score)], names=list(self.names))

    def add(self, q, queries, items):
        a, b = np.floor(256 * queries.vectors), np.floor(256 * items.vectors)
        own, theirs = (x.column("label").to_numpy() for x in (queries, items))
        lists = queries.column("scores")
        sizes = np.diff(lists.offsets.to_numpy())
        # scores fall along a list; places after its end have a window that nothing fits
        place = np.arange(sizes.max()) < sizes[:, None]
        p = np.zeros(place.shape, np.int64)
        p[place] = lists.flatten().to_numpy()
        low, high = limits(p, self.least, self.most)
        open_ = place & (low <= high)
        floor = np.where(open_, low.astype(float), np.inf).min(axis=1)
        ceiling = np.where(open_, high.astype(float), -np.inf).max(axis=1)
        found = []
        for start in range(0, len(a), grid.PANEL):
            part = np.arange(start, min(len(a), start + grid.PANEL))
            part = part[np.isfinite(floor[part])]
            if not len(part):
                continue
            scores = products(a[part], b)
            row, col = np.nonzero((scores >= floor[part, None]) & (scores <= ceiling[part, None]) & (own[part, None] != theirs[None, :]))
            score = whole(scores[row, col])
            row = part[row]
            # the last positive whose upper limit is not passed
            slot = ((high[row] >= score[:, None]) & place[row]).sum(axis=1) - 1
            at = grid.first_of_each([row, slot], score, items.ids[col], self.k)
            found.append((queries.ids[row[at]], slot[at], items.ids[col[at]], score[at]))
        if found:
            yield from self.keep(q, [np.concatenate(x) for x in zip(*found)])


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.col(vector)
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def mine(rows: DataFrame, anchors: Column, n_positives: int = 5, k: int = 3, least: int = 50, most: int = 95, **grid_options) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchors` chooses.

    `rows` has vec_id bigint, embedding (array of float or double) and label int; other columns are left alone. A component x counts as
    floor(256 * x), scores are exact inner products, and a vector shorter than another counts as if it ended
    in zeros. Higher scores come first, ties by smaller vec_id. An anchor's positives are its first
    `n_positives` rows with its label and another id, the negatives of each are the first `k` rows with another label and
    least * positive_score <= 100 * negative_score <= most * positive_score. `least` and `most` are percentages of at most 100.

    Rows without an id, a label or a vector and rows with a null or non-finite component take no part. Repeated rows are
    candidates of their own; anchors that share an id are one, with the smallest label and vector among them. An
    anchor without a positive, or a positive without a negative, gives no row; so does an empty table. A
    score of 2**56 or more raises an error.
    """
    use = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    use = use.select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
    chosen = use.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("one")).select("vec_id", F.col("one.embedding").alias("embedding"), F.col("one.label").alias("label"))
    scratch = Scratch(rows.sparkSession, "negatives")
    asked = scratch.save(chosen, "anchors")

    near = grid.meet(asked, use, lambda: Positives(n_positives), "anchor_id bigint, positive_id bigint, score bigint", **grid_options)
    turn = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    firsts = near.withColumn("turn", turn).filter(F.col("turn") <= n_positives)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "positive_id", "score")))
    positives = scratch.save(firsts.groupBy("anchor_id").agg(ordered.alias("positives")), "positives")

    limited = asked.join(positives.select("anchor_id", F.col("positives.score").alias("scores")), asked["vec_id"] == positives["anchor_id"])
    limited = limited.select("vec_id", "embedding", "label", "scores")
    slots = grid.meet(limited, use, lambda: Slots(k, least, most), "anchor_id bigint, slot int, negative_id bigint, score bigint", **grid_options)
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "negative_id"))
    kept = slots.withColumn("place", place).filter(F.col("place") <= k)
    by_slot = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "negative_id", "score"))).alias("kept"))
    merged = by_slot.join(positives, "anchor_id").withColumn("windows", suffix_merges("kept", F.size("positives"), k))

    answered = merged.select("anchor_id", F.posexplode("positives").alias("at", "p"), "windows")
    fits = lambda e: (e["score"] * 100 >= F.col("p.score") * least) & (e["score"] * 100 <= F.col("p.score") * most)
    own = answered.withColumn("own", F.filter(F.element_at("windows", F.col("at") + 1), fits))
    out = own.select("anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("own").alias("n", "e"))
    return out.select("anchor_id", "positive_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("e.negative_id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))


def suffix_merges(kept: str, slots: Column, k: int) -> Column:
    """For each slot the first k rows of it and all later slots. `kept` is in the order of slots and places.

    Every score of a slot is above those of later slots, so a merge puts the slot's rows before what the later ones gave.
    """
    row = "struct<slot: int, place: int, negative_id: bigint, score: bigint>"
    start = F.struct(F.array().cast(f"array<{row}>").alias("top"), F.array().cast(f"array<array<{row}>>").alias("windows"))

    def step(state: Column, slot: Column) -> Column:
        top = F.slice(F.concat(F.filter(kept, lambda e: e["slot"] == slot), state["top"]), 1, k)
        return F.struct(top.alias("top"), F.concat(F.array(top), state["windows"]).alias("windows"))

    return F.aggregate(F.reverse(F.sequence(F.lit(0), slots - 1)), start, step, lambda s: s["windows"])


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return mine(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS turn FROM scored WHERE same) WHERE turn <= 5
)
SELECT * FROM (
  SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
         s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
) WHERE rank <= 3
"""

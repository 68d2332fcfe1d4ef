"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, their stems, word pairs and pairs with one word between. Per-
coordinate rates and an L1 term (McMahan et al. 2013) leave few weights; only those are
sent to the tasks that score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import xxhash
from millrace.llm import words as W
from millrace.llm.learning import bounded_sample, fit_in_one_task, fold

#: The fit sees at most this many labelled texts.
SAMPLE = 12_000
#: Features of fewer texts of the sample are left out of the fit.
LEAST_TEXTS = 2
_EDGES = ".,;:!?\"'()[]{}*%$&#<>|-"
#: Lengths of the stems that stand beside each word, as inflected forms of one word differ at the end.
STEMS = (4, 5, 6)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def word_features(known: pa.Array) -> np.ndarray:
    """One row a distinct word: the hash of the word and of its stems (0 where it is no longer than the stem)."""
    h = xxhash.xxh64_intdigest
    plain = [w.lower().strip(_EDGES) for w in known.to_pylist()]
    flat = [[h(w), *(h(w[:k], k) if len(w) > k else 0 for k in STEMS)] for w in plain]
    return np.array(flat, np.uint64).reshape(len(flat), 1 + len(STEMS))


def _pairs(h: np.ndarray, row: np.ndarray):
    """Rows and hashes of word pairs and of pairs with one word between."""
    for gap in (1, 2):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            yield row[:-gap][same], W.mix(h[:-gap] * _STEPS[gap] + h[gap:])[same]


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """For every feature occurrence its row and 64-bit hash."""
    offsets, words = W.split(texts)
    index, known = W.distinct(words)
    own = word_features(known)[index]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, hashes = [], []
    for k in range(own.shape[1]):
        full = own[:, k] != 0
        rows.append(row[full])
        hashes.append(own[full, k])
    for r, h in _pairs(own[:, 0], row):
        rows.append(r)
        hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


def _fit(table: pa.Table, epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1, seed: int = 6, least_texts: int = LEAST_TEXTS) -> dict[str, np.ndarray]:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    y = table["toxic"].to_numpy()
    docs = []
    for start in range(0, table.num_rows, 500):
        part = table.slice(start, 500)
        row, h = features(part["text"].combine_chunks())
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, bool)
        row, h = row[fresh], h[fresh]
        docs += np.split(h, np.searchsorted(row, np.arange(1, part.num_rows)))
    every, counts = np.unique(np.concatenate(docs), return_counts=True) if docs else (np.zeros(0, np.uint64), np.zeros(0, int))
    every = every[counts >= least_texts]
    ids = []
    for h in docs:
        at = np.searchsorted(every, h)
        at[at == len(every)] = 0
        ids.append(at[every[at] == h] + 1 if len(every) else at[:0])
    z, n = np.zeros(len(every) + 1), np.zeros(len(every) + 1)  # 0 is the intercept, which has no L1 term
    draw = np.random.default_rng(seed)

    def weight(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(z[i]) <= l1] = 0
        if len(i) and i[0] == 0:
            w[0] = -z[0] / ((beta + np.sqrt(n[0])) / alpha + l2)
        return w

    for _ in range(epochs):
        for j in draw.permutation(len(ids)):
            i = np.concatenate([[0], ids[j]])
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[j]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(len(z)))
    kept = np.flatnonzero(w[1:])
    return {"hashes": every[kept], "weights": w[1:][kept], "bias": np.array(w[0])}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_texts: int = LEAST_TEXTS) -> dict[str, np.ndarray]:
    """Fit on at most `sample` labelled texts of the learning folds, the first by hash of the id.

    An id with several labels counts as toxic if one of them is, an id with several rows has the first of their texts, so the fit
    never sees more than `sample` rows. Features of fewer than `least_texts` texts of the sample get no weight; 1 keeps
    all of them. The chosen ids are at most `sample` rows, so they go to every task that reads the texts.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold() != 0)
    marked = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(marked, sample, F.xxhash64("doc_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return fit_in_one_task(rows.select(F.col("doc_id").cast("string"), "text", "toxic"), lambda table: _fit(table, least_texts=least_texts))


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text).

    A null or empty text has the score of the intercept; without a model every score
    is 0. Rows without an id are not held out; a score of just 0.5 is predicted as 1; repeated rows get equal
    answers. Texts are read whole, some megabytes of them at a time. Other columns are not
    read and do not come out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        hashes, weights = (m["hashes"], m["weights"]) if m else (np.zeros(0, np.uint64), np.zeros(0))
        hint = np.zeros(1 << 16, bool)
        hint[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

        def find(h: np.ndarray) -> np.ndarray:
            """The number of each hash among the weights, or -1."""
            out = np.full(h.shape, -1)
            near = np.nonzero(hint[(h & np.uint64(0xFFFF)).astype(np.int64)])
            if len(near[0]):
                at = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
                out[near] = np.where(hashes[at] == h[near], at, -1)
            return out

        for part in W.slices(batches):
            n = part.num_rows
            offsets, words = W.split(part.column(2))
            index, known = W.distinct(words)
            own = word_features(known)
            at = find(own)
            row = np.repeat(np.arange(n), np.diff(offsets))
            hit = np.flatnonzero((at >= 0).any(axis=1)[index])
            found = [(np.repeat(row[hit], own.shape[1]), at[index[hit]].reshape(-1))]
            found += [(r, find(h)) for r, h in _pairs(own[:, 0][index], row)]
            row, at = (np.concatenate(x) for x in zip(*found))
            row, at = row[at >= 0], at[at >= 0]
            pair = np.unique(row.astype(np.int64) * max(1, len(hashes)) + at)
            width = max(1, len(hashes))
            total = np.bincount(pair // width, weights[pair % width] if len(pair) else None, minlength=n).astype(float)
            s = 1 / (1 + np.exp(-np.clip(total + float(m["bias"]), -35, 35))) if m else np.zeros(n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, train(docs, labels))

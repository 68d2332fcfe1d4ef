"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (byte 2- to 5-grams of `<word>`, hashed
into buckets); a linear softmax over that average gives the language. Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample. As the model is
linear after the average, embeddings are folded into one row of scores a bucket for
prediction. A temperature and a rejection threshold are calibrated on texts kept out of the fit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.learning import bounded_sample, by_rows, fit_in_one_task, fold

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4, 5)
#: The fit sees at most this many texts a language.
PER_LANGUAGE = 600
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def subwords(known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by word and bucket numbers of the subwords of every distinct word."""
    marked = pc.binary_join_element_wise("<", pc.utf8_lower(known), ">", "")
    size = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    raw = np.frombuffer("".join(marked.to_pylist()).encode(), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    places, codes = [], []
    code = np.zeros(len(raw), np.uint64)
    for k in range(max(SIZES)):
        n = len(raw) - k
        if n <= 0:
            break
        code = code[:n] * np.uint64(257) + raw[k:]
        if k + 1 in SIZES:
            whole = word[:n] == word[k:]
            places.append(word[:n][whole])
            codes.append((W.mix(code[whole] + np.uint64(k) * np.uint64(1 << 56)) % np.uint64(BUCKETS)).astype(np.int32))
    if not places:
        return np.zeros(len(size) + 1, np.int64), np.zeros(0, np.int32)
    place, code = np.concatenate(places), np.concatenate(codes)
    order = np.argsort(place, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(size)))]), code[order]


def _fit(table: pa.Table, epochs: int = 6, rate: float = 0.5, seed: int = 5) -> dict[str, np.ndarray]:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    languages = sorted(set(table["lang"].to_pylist()))
    label = np.array([languages.index(x) for x in table["lang"].to_pylist()])
    draw = np.random.default_rng(seed)
    examples = []
    texts = table["text"].combine_chunks()
    offsets, words = W.split(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
    index, known = W.distinct(words)
    starts, codes = subwords(known)
    for i, y in enumerate(label):
        own = index[offsets[i] : offsets[i + 1]]
        # the whole text, and short runs of it, as short texts occur too
        for n in (len(own), 30, 8, 2):
            at = int(draw.integers(0, max(1, len(own) - n + 1)))
            part, times = np.unique(own[at : at + n], return_counts=True)
            if not len(part):
                continue
            grams = np.concatenate([codes[starts[w] : starts[w + 1]] for w in part])
            if len(grams):
                g, back = np.unique(grams, return_inverse=True)
                c = np.bincount(back, np.repeat(times, starts[part + 1] - starts[part]))
                examples.append((g, (c / c.sum()).astype(np.float32), y, i % 5 == 0))
    train, test = [e for e in examples if not e[3]], [e for e in examples if e[3]]
    train = train or test
    emb = draw.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft = draw.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = epochs * max(1, len(train))
    for epoch in range(epochs):
        for k, j in enumerate(draw.permutation(len(train))):
            g, c, y, _ = train[j]
            lr = rate * (1 - (epoch * len(train) + k) / steps)
            hidden = c @ emb[g]
            z = hidden @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = soft @ p
            soft -= lr * np.outer(hidden, p)
            bias -= lr * p
            emb[g] -= lr * 20 * np.outer(c, back)
    table_of = emb @ soft
    z = np.array([c @ table_of[g] + bias for g, c, _, _ in test]).reshape(len(test), len(languages))
    y = np.array([e[2] for e in test], int)

    def soften(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(soften(t)[np.arange(len(y)), y] + 1e-9).mean() if len(y) else 0 for t in grid]
    t = float(grid[int(np.argmin(loss))])
    reject = 0.0
    if len(y):
        p = soften(t)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-top)
        good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= 0.99
        reject = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return {"table": (table_of / t).astype(np.float32), "bias": bias / t, "languages": np.array(languages), "reject": np.array(reject)}


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Fit on at most `per_language` texts of each language, whole, from rows of the learning folds.

    The model has BUCKETS scores a language, whatever the input.
    """
    usable = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").filter(fold() != 0)
    sample = bounded_sample(usable, per_language, F.xxhash64("doc_id"), "lang")
    return fit_in_one_task(sample.select(F.col("doc_id").cast("string"), "lang", "text"), _fit)


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of `docs` (doc_id, text).

    `und` with score 0 for null texts, texts without a letter, and all texts where nothing
    could be learned. Rows without an id are not held out; of languages with equal scores the first by
    name is taken; repeated rows get equal answers. Texts are read whole, some megabytes of them
    at a time. Other columns are not read and do not come out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part in W.slices(batches):
            texts, n = part.column(2), part.num_rows
            lettered = np.array([has_letter(t.as_py()) for t in texts], bool) & bool(m)
            lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            if lettered.any():
                offsets, words = W.split(texts)
                index, known = W.distinct(words)
                starts, codes = subwords(known)
                value = np.column_stack([by_rows(m["table"][codes], starts), np.diff(starts)])
                total = by_rows(value[index], offsets)
                z = total[:, :-1] / np.maximum(total[:, -1:], 1) + m["bias"]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                lang = np.where(lettered, m["languages"].astype(object)[p.argmax(axis=1)], UNDETERMINED)
                score = np.where(lettered, p.max(axis=1), 0.0)
            rejected = ~lettered | (score < (float(m["reject"]) if m else 1.0))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, train(docs))

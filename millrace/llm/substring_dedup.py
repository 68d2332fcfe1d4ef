"""Removal of long repeated passages with difference-cover anchors.

A window is 20 consecutive words. Hashing every window of a corpus would shuffle
one row a word. {0, 1, 3, 9} is a difference cover modulo 13: for any two starts i and
j some shift below 13 puts both on the cover. So two equal windows share an equal run
of 20 - 13 + 1 = 8 words that starts on the cover in both documents, and only such runs
(4 in 13) are hashed and compared over the corpus. Where an anchor repeats, the match
is extended: every window that holds it is hashed in full, and the first occurrence
of each is found. All other occurrences are removed.

Rows are shuffled by document once and by hash twice. An anchor that occurs twice in the batch that reads it is
known to repeat, so its places go straight to their documents and the others hear of it by one row a
batch; thus a passage that a third of all documents hold brings few rows to any task. Whole windows are told
apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W

PERIOD, COVER = 13, (0, 1, 3, 9)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
#: Bit of `rep` (and, 32 higher, of `at`) of rows without an id. They come after all others.
_NO_ID = 1 << 30


def _documents(docs: DataFrame) -> DataFrame:
    """doc, rep, copy and the packed text of every row.

    `doc` is the id, or a hash of the text for rows without one, which `rep` marks; so they are spread
    over the tasks. Different texts of one id are told apart by `rep`; equal rows are
    one document. `copy` says that an earlier document has the same whole text. Texts are packed,
    as they are the most of what is shuffled.
    """

    def pack(batches):
        for part in W.slices(batches):
            squeeze = zstandard.ZstdCompressor(level=1).compress
            raw = part.column(0).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([None if t is None else squeeze(t) for t in raw], pa.binary())], names=["doc", "no_id", "packed"])

    # a null text of no document has nothing to compare and stays where it is read
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.when(F.col("text").isNull(), F.xxhash64(F.spark_partition_id())).otherwise(F.xxhash64("text"))).alias("doc")
    no_id = F.col("doc_id").isNull().alias("no_id")
    digest = [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2")]
    known = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(doc, *digest).distinct()
    first = known.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = known.join(first, ["d1", "d2"]).filter("doc > first").select(F.col("doc").alias("c_doc"), F.lit(True).alias("copy")).distinct()
    # the filter holds for every row; with it all readers of the texts share one exchange
    packed = docs.select("text", doc, no_id).mapInArrow(pack, "doc bigint, no_id boolean, packed binary").filter("doc IS NOT NULL")
    # two texts under one id are rare, so that a copy is judged only where the id has one text
    turn = F.dense_rank().over(Window.partitionBy("doc").orderBy("no_id", "packed")) - 1
    ranked = packed.withColumn("turn", turn)
    ranked = ranked.withColumn("reps", F.max("turn").over(Window.partitionBy("doc")))
    joined = ranked.join(copies, ranked["doc"] == copies["c_doc"], "left")
    rep = F.col("turn") + F.when(F.col("no_id"), F.lit(_NO_ID)).otherwise(F.lit(0))
    alone = (F.col("reps") == 0) & ~F.col("no_id")
    return joined.select("doc", rep.alias("rep"), (F.coalesce("copy", F.lit(False)) & alone).alias("copy"), "packed")


def _unpacked(batches):
    """Slices of a batch with its texts in column `text`, unpacked."""
    for batch in batches:
        at = batch.schema.get_field_index("packed")
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            loosen = zstandard.ZstdDecompressor().decompress
            texts = [None if t is None else loosen(t) for t in part.column(at).to_pylist()]
            yield from W.slices([part.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))])


def _positions(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return row, np.arange(len(row)) - offsets[row]


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def anchors(keyed: DataFrame, window: int) -> DataFrame:
    """(hash, doc, at, n): runs on the cover.

    `at` is rep * 2**32 + position. Runs that their batch holds more than once have n = 2 and go, under a hash of their
    own, to no common task; one row without a place tells the others of that hash.
    """
    length = window - PERIOD + 1

    def run(batches):
        for part in _unpacked(batches):
            offsets, words = W.split(part.column(2))
            long = np.diff(offsets) >= window
            runs = W.windows(W.word_hashes(words), length)
            row, pos = _positions(offsets)
            row, pos = row[: len(runs)], pos[: len(runs)]
            use = np.flatnonzero(_ON_COVER[pos % PERIOD] & W.within(offsets, length) & long[row])
            runs, row, pos = runs[use], row[use], pos[use]
            doc, at = _column(part, "doc")[row].astype(np.int64), (_column(part, "rep")[row].astype(np.int64) << 32) + pos
            known, back, times = np.unique(runs, return_inverse=True, return_counts=True)
            again = times[back] > 1
            told = known[times > 1]
            runs = np.where(again, W.mix(runs ^ W.mix(doc.view(np.uint64))), runs)
            none = np.zeros(len(told), np.int64)
            hide = pa.array(np.concatenate([np.zeros(len(doc), bool), np.ones(len(told), bool)]))
            columns = [
                pa.array(np.concatenate([runs, told]).view(np.int64)),
                pc.if_else(hide, pa.scalar(None, pa.int64()), pa.array(np.concatenate([doc, none]))),
                pa.array(np.concatenate([at, none])),
                pa.array(np.concatenate([1 + again, none + 2]).astype(np.int8)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "doc", "at", "n"])

    return keyed.filter("NOT copy").select("doc", "rep", "packed").mapInArrow(run, "hash bigint, doc bigint, at bigint, n tinyint")


def repeated_anchors(found: DataFrame) -> DataFrame:
    """(m_doc, marks): for each document where the anchors start that occur elsewhere."""
    rows = found.withColumn("all", F.sum("n").over(Window.partitionBy("hash"))).filter("all > 1 AND doc IS NOT NULL")
    return rows.groupBy(F.col("doc").alias("m_doc")).agg(F.collect_list("at").alias("marks"))


def _marks(part: pa.RecordBatch, name: str, offsets: np.ndarray) -> np.ndarray:
    """Word numbers, over all rows, of lists of rep * 2**32 + position, of those that have the row's rep."""
    column = part.column(part.schema.get_field_index(name))
    at = column.flatten().to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), counts)
    own = (at >> 32) == _column(part, "rep")[row]
    return offsets[row[own]] + (at[own] & 0xFFFFFFFF)


def _candidates(offsets: np.ndarray, marked: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows, over all rows, that hold a marked anchor whole."""
    n = int(offsets[-1])
    delta = np.zeros(n + 1, np.int64)
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    low = np.maximum(row_start[marked], marked - (PERIOD - 1)) if len(marked) else marked
    np.add.at(delta, low, 1)
    np.add.at(delta, marked + 1, -1)
    near = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
    whole = W.within(offsets, window)
    near = near[near < len(whole)]
    return near[whole[near]]


def first_windows(marked: DataFrame, window: int) -> DataFrame:
    """(f_doc, firsts): for each document, the windows whose first occurrence it holds."""

    def run(batches):
        for part in _unpacked(batches):
            offsets, words = W.split(part.column(2))
            at = _candidates(offsets, _marks(part, "marks", offsets), window)
            one = W.word_hashes(words)
            hashes, others = W.windows(one, window)[at], W.windows(one, window, _OTHER)[at]
            row, pos = _positions(offsets)
            doc, place = _column(part, "doc")[row[at]], (_column(part, "rep")[row[at]].astype(np.int64) << 32) + pos[at]
            order = np.lexsort((place, doc, place >> 62, others, hashes))
            new = (np.diff(hashes[order]) != 0) | (np.diff(others[order]) != 0) if len(order) else np.zeros(0, bool)
            order = order[np.concatenate([[True], new])] if len(order) else order
            yield pa.RecordBatch.from_arrays([*(pa.array(x[order].view(np.int64)) for x in (hashes, others)), pa.array(doc[order]), pa.array(place[order])], names=["hash", "other", "doc", "at"])

    windows = marked.select("doc", "rep", "packed", "marks").mapInArrow(run, "hash bigint, other bigint, doc bigint, at bigint")
    # rows without an id come last
    firsts = windows.groupBy("hash", "other").agg(F.min(F.struct(F.shiftright("at", 62).alias("no_id"), "doc", "at")).alias("o")).select("o.*")
    return firsts.groupBy(F.col("doc").alias("f_doc")).agg(F.collect_list("at").alias("firsts"))


def deduplicate(docs: DataFrame, window: int = 20, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of `docs` (doc_id, text).

    A word goes if a window that covers it also starts earlier: in a smaller doc_id, or earlier in
    the same document. A null or empty text has no words. Equal rows are one document and get equal
    answers. Different texts under one doc_id come in a fixed order, that of their packed bytes; rows without
    doc_id come after all others, in the order of a hash of their texts. Texts are read whole, some megabytes of them
    at a time. An empty table gives no rows. Other columns are not read and do not come out.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = _documents(docs)
    repeated = repeated_anchors(anchors(keyed, window))
    marked = keyed.filter("NOT copy").join(repeated, keyed["doc"] == repeated["m_doc"], "inner")
    firsts = first_windows(marked, window)
    whole = keyed.join(repeated, keyed["doc"] == repeated["m_doc"], "left")
    whole = whole.join(firsts, whole["doc"] == firsts["f_doc"], "left").select("doc", "rep", "packed", "copy", "marks", "firsts")
    fields = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def run(batches):
        for part in _unpacked(batches):
            text = part.column(2)
            offsets, words = W.split(text)
            size = np.diff(offsets)
            again = _candidates(offsets, _marks(part, "marks", offsets), window)
            again = np.setdiff1d(again, _marks(part, "firsts", offsets))
            delta = np.zeros(int(offsets[-1]) + 1, np.int64)
            delta[again] += 1
            np.add.at(delta, again + window, -1)
            gone = (np.cumsum(delta[:-1]) > 0) | np.repeat(_column(part, "copy") & (size >= window), size)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
            texts = []
            for i, raw in enumerate(text):
                kept = (raw.as_py() or "").encode().split()
                if removed[i]:
                    kept = [w for w, g in zip(kept, gone[offsets[i] : offsets[i + 1]].tolist()) if not g]
                texts.append(b" ".join(kept))
            doc = pc.if_else(pa.array(_column(part, "rep") >= _NO_ID), pa.scalar(None, pa.int64()), part.column(0))
            out = [doc, pa.array(size), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.binary()).cast(pa.string())] * keep_text, names=fields)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return whole.mapInArrow(run, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM w WHERE len(w) > 19)
), a AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM x) WHERE r > 1
), g AS (
  SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM a) GROUP BY doc_id
), p AS (
  SELECT w.doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM w WHERE len(w) > 0
), k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(g) AS p FROM g) q WHERE q.doc_id = p.doc_id AND q.p = p.p) GROUP BY p.doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

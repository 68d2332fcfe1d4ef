"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

Documents with equal shingle sets become one class first. Classes whose
signatures agree in a band share a bucket. Exact bounds then thin the pairs, and drop none that could link: a
class's shingles that no other candidate has cannot be shared, so a class with too many of them links
with nothing, and a pair can share at most what both have left; nor can a pair share more than the smaller of
its two counts in each of 128 cells of the hash space. Inside a bucket a few hubs are compared
with all members, in rounds: whatever is already in the hub's component needs no
comparison, and a hub that has been compared with its whole bucket retires. Rounds go on with
more hubs until no bucket holds two components with a pair not compared. So a bucket
of mutual copies costs one comparison a member. A pair that shares several bands is taken in the first
of them. Large buckets are split into parts that all meet the hubs. Every link is confirmed on the full sets.
So a link is missed only if no band agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import Scratch, components

SHINGLE = 5
BANDS, ROWS = 16, 4
SLOTS = BANDS * ROWS
CELLS = 128
#: Members of a bucket that one part of it may hold.
PART_ROWS = 1000
HUBS_GROW = 8
#: Pairs of a member and a hub that a task compares, rows it reads for them, and the most tasks.
TASK_PAIRS = 100_000
TASK_ROWS = 20_000
MOST_TASKS = 2000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by row and the sorted distinct shingle hashes of every text."""
    offsets, words = W.split(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = W.word_hashes(words)
    runs = W.windows(hashes, SHINGLE)
    sets = []
    for start, end in zip(offsets[:-1], offsets[1:]):
        n = end - start
        if n >= SHINGLE:
            sets.append(np.unique(runs[start : end - SHINGLE + 1]))
        else:  # the whole sequence as one, or nothing
            sets.append(W.windows(hashes[start:end], int(n)) + np.uint64(n) if n else np.zeros(0, np.uint64))
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def superminhash(offsets: np.ndarray, elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One signature a row (Ertl 2017), all rows level by level.

    At level j an element throws a value in [j, j + 1) at the next place of its own random
    permutation of the slots. A row stops as soon as all its slots hold values of
    levels reached, since later levels cannot lower them.
    """
    n_rows = len(offsets) - 1
    signature = np.full(n_rows * slots, np.inf)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    perm = swap = None
    for level in range(slots):
        if not len(row):
            break
        draw = W.mix(elements + np.uint64(int(_GOLD) * (level + 1) & 0xFFFFFFFFFFFFFFFF))
        value = level + (draw >> np.uint64(11)) * 2.0**-53
        place = (level + (W.mix(draw) >> np.uint64(16)) % np.uint64(slots - level)).astype(np.int64)
        if level == 0:
            slot, swap = place, place
        else:
            every = np.arange(len(row))
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(row), 1))
                perm[every, swap], perm[:, 0] = 0, swap
            slot = perm[every, place].astype(np.int64)
            perm[every, place] = perm[:, level]
            perm[:, level] = slot
        np.minimum.at(signature, row * slots + slot, value)
        open_rows = signature.reshape(n_rows, slots).max(axis=1) >= level + 1
        still = open_rows[row]
        if not still.all():
            row, elements = row[still], elements[still]
            if perm is not None:
                perm = perm[still]
            else:
                swap = swap[still]
    return signature.reshape(n_rows, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for r in range(ROWS):
        key = W.mix(key ^ bits[:, :, r])
    return key


def cell_counts(offsets: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of each row lie in each cell, up to 127, and how many are beyond these counts."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * CELLS + (elements >> np.uint64(57)).astype(np.int64), minlength=n * CELLS).reshape(n, CELLS)
    capped = np.minimum(counts, 127).astype(np.int8)
    return capped, (counts - capped).sum(axis=1)


def fingerprints(offsets: np.ndarray, elements: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums of hashes a row."""
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[offsets])
    return [pa.array(total(W.mix(x)).view(np.int64)) for x in (elements, elements ^ _GOLD)]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, two halves of the set's fingerprint, cells, beyond and the band keys (null for empty sets).

    Small slices: a shingle has 64 bytes of its own while signatures are made.
    """

    def run(batches):
        for part in W.slices(batches, limit=1 << 20):
            offsets, elements = shingle_sets(part.column(2))
            counts = np.diff(offsets)
            cells, beyond = cell_counts(offsets, elements)
            bands = _lists(band_keys(superminhash(offsets, elements)).view(np.int64))
            bands = pc.if_else(pa.array(counts > 0), bands, pa.scalar(None, bands.type))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), *fingerprints(offsets, elements), _lists(cells), pa.array(beyond), bands], names=["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "cells", "beyond", "bands"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, fp1 bigint, fp2 bigint, cells array<tinyint>, beyond bigint, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part in W.slices(batches, limit=1 << 20):
            offsets, elements = shingle_sets(part.column(0))
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*fingerprints(offsets, elements), sets], names=["fp1", "fp2", "shingles"])

    return docs.select("text").mapInArrow(run, "fp1 bigint, fp2 bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) whose full sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "ca", "cb")


def _grouped(docs: DataFrame, percent: int, broadcast_ids: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    docs = docs.select("doc_id", "text")
    signed = scratch.save(signatures(docs), "signatures")
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class has a number of its own, as several texts of one id have the same smallest id
    grouped = named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n_shingles", "cells", "beyond", "bands")])
    classes = scratch.save(grouped.withColumnRenamed("n_shingles", "n").withColumn("node", F.monotonically_increasing_id()), "classes")

    # candidates: classes that share a band
    banded = classes.select("node", "rep", "fp1", "fp2", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    ids = scratch.save(banded.join(shared, "key", "left_semi").select("node", F.col("rep").alias("doc_id"), "fp1", "fp2").distinct(), "candidates")
    picked = ids.select("doc_id")
    few = ids.count() <= broadcast_ids
    texts = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(F.broadcast(picked) if few else picked, "doc_id", "left_semi")
    wanted = ids.select("node", "fp1", "fp2")
    sets = full_sets(texts).join(F.broadcast(wanted) if few else wanted, ["fp1", "fp2"]).select("node", "shingles")
    sets = scratch.save(sets.dropDuplicates(["node"]), "sets")

    # shingles that one candidate alone has cannot be shared
    alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("c")).filter("c = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    left = sets.select("node").join(own, "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"))
    open_ = classes.join(left, "node").withColumn("most", F.col("n") - F.col("own")).filter(100 * F.col("most") >= percent * F.col("n"))
    members = scratch.save(open_.select("node", "n", "most", "beyond", "cells", "bands", F.posexplode("bands").alias("band", "key"), F.col("node").alias("comp")), "members")

    comps, hubs_a_round, rounds, live, before = None, 1, 0, members, None
    while True:
        # buckets that hold more than one component, in parts
        sizes = live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / PART_ROWS).alias("parts")).filter("lo <> hi").select("key", "parts")
        parted = live.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        live = scratch.save(parted, "open")
        scratch.drop(before)
        before = live
        c = F.col("c")
        rows, compared = live.groupBy("key").agg(F.count("*").alias("c")).agg(F.sum("c"), F.sum(c * F.least(c, F.lit(hubs_a_round)))).first()
        if not rows:
            break
        turn = F.xxhash64("node", F.lit(rounds))
        hubs = live.withColumn("turn", F.row_number().over(Window.partitionBy("key", "part").orderBy(turn, "node"))).filter(F.col("turn") <= hubs_a_round)
        hubs = hubs.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(turn, "node"))).filter(F.col("turn") <= hubs_a_round)
        hubs = hubs.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"h_{c}") for c in ("node", "n", "most", "beyond", "cells", "bands", "comp")])
        hubs = scratch.save(hubs, "hubs", rows)
        # hubs come first in the order, so each pair is taken once, from the earlier of the two
        later = F.struct(turn.alias("h"), F.col("node").alias("r")) > F.struct(F.xxhash64("h_node", F.lit(rounds)).alias("h"), F.col("h_node").alias("r"))
        linkable = lambda most: 100 * most >= percent * (F.col("n") + F.col("h_n") - most)
        first = F.array_position(F.zip_with("bands", "h_bands", lambda x, y: x == y), True) == F.col("band") + 1
        in_cells = F.aggregate(F.zip_with("cells", "h_cells", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x) + F.least("beyond", "h_beyond")
        near = (live["key"] == hubs["key"]) & (live["part"] == hubs["part"]) & (F.col("comp") != F.col("h_comp")) & later & linkable(F.least("most", "h_most")) & first & linkable(in_cells)
        ends = F.struct(F.greatest("node", "h_node").alias("a"), F.least("node", "h_node").alias("b"))
        # a few bytes of rows make many pairs, so pairs decide how many tasks compare them, not bytes
        tasks = min(MOST_TASKS, 1 + max(compared // TASK_PAIRS, rows // TASK_ROWS))
        pairs = live.repartition(tasks, "key", "part").join(hubs.repartition(tasks, "key", "part"), near).select(ends.alias("p"), F.least("comp", "h_comp").alias("ca"), F.greatest("comp", "h_comp").alias("cb")).select("p.*", "ca", "cb").distinct()
        found = scratch.save(confirmed(pairs, sets, percent), "links")
        retired = hubs.select("key", F.col("h_node").alias("node")).distinct()
        live = live.drop("part", "parts").join(retired, ["key", "node"], "left_anti")
        n_found = found.count()
        if n_found:
            joined = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, n_found).withColumnRenamed("node", "j_node")
            live = live.join(joined, live["comp"] == joined["j_node"], "left").withColumn("comp", F.coalesce("component", "comp")).drop("j_node", "component")
            known = members.select("node", "comp").distinct() if comps is None else comps
            comps = scratch.save(known.join(joined, known["comp"] == joined["j_node"], "left").select("node", F.coalesce("component", "comp").alias("comp")), "components")
        hubs_a_round, rounds = hubs_a_round * HUBS_GROW, rounds + 1

    found = classes.select("fp1", "fp2", "node", "rep")
    if comps is not None:
        # a component is named by the smallest id of its classes
        named_ = found.join(comps, "node")
        names = named_.groupBy("comp").agg(F.min("rep").alias("name"))
        renamed = named_.join(names, "comp").filter("rep <> name").select(F.col("node").alias("c_node"), "name")
        found = found.join(renamed, found["node"] == renamed["c_node"], "left").select("fp1", "fp2", F.coalesce("name", "rep").alias("component_id"))
    else:
        found = found.select("fp1", "fp2", F.col("rep").alias("component_id"))
    found = scratch.save(found, "found")
    out = signed.select("doc_id", "text_hash", "n_shingles", "fp1", "fp2").join(found, ["fp1", "fp2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def groups(docs: DataFrame, percent: int = 85, broadcast_ids: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    Null and blank texts have the empty set and link with nothing. A row without a
    doc_id links with nothing and is kept. Equal rows get equal answers; different texts under one doc_id
    are grouped each by itself, so one may be kept where the other is not. Texts are read whole, some
    megabytes of them at a time. Other columns are not read and do not come out. An empty table
    gives no rows. The texts of candidates are picked with a broadcast of their ids up to
    `broadcast_ids` ids, beyond it by a join.
    """
    return _grouped(docs, percent, broadcast_ids).drop("text_hash")


def keep_one(docs: DataFrame, percent: int = 85, broadcast_ids: int = 2_000_000) -> DataFrame:
    """The rows of `docs`, with all columns as they are, that represent their group.

    A row goes only for its own text: another text under its doc_id stays. Rows that repeat the
    representative stay too, as nothing tells them apart.
    """
    scratch = Scratch(docs.sparkSession, "near-dup-drop")
    out = _grouped(docs, percent, broadcast_ids).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    drop = scratch.save(out, "drop")
    few = drop.count() <= broadcast_ids
    # qualified by the caller's frame, so that columns of any name pass
    same = (docs["doc_id"].cast("bigint") == drop["gone_id"]) & (F.xxhash64(docs["text"]) == drop["gone_text"])
    return docs.join(F.broadcast(drop) if few else drop, same, "left_anti")


def op7_near_dup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

"""Vector search in blocks and by the inverted file, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import filters, grid, learn, vector_index
from millrace.operators import retrieve as J
from millrace.operators.vector_index import VectorIndex


def nearest(rows, asked, k, below=None):
    """(query, item, similarity) by hand."""
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    out = []
    for n, (q, v) in enumerate(asked):
        sims = sorted((-round(float(unit(v) @ unit(x)), 6), i) for i, x in rows)
        out += [(q, i, -s) for s, i in [p for p in sims if below is None or -p[0] < below[n]][:k]]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 6)]) for i in range(300)]
    return rows + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(20)] + [(400, [0.0] * 6)]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "slices": 3}])
def test_blocks_equal_brute_force(spark, vectors, options, monkeypatch):
    monkeypatch.setattr(grid, "_rows_a_block", lambda width: 64)
    monkeypatch.setattr(grid, "HELD_ROWS", 500)
    items = spark.createDataFrame([*vectors, (500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0])], "item_id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([*vectors[:150], (999, None)], "query_id bigint, query_vector array<double>")
    near = J.top_k(J.similarities(asked, items, 7, **options), 7, [F.desc("similarity"), "item_id"]).drop("rank")
    assert sorted(map(tuple, near.collect())) == nearest(vectors, vectors[:150], 7)
    assert J.similarities(asked.limit(0), items, 7).count() == 0 and J.similarities(asked, items.limit(0), 7).count() == 0


def test_nothing_is_collected_for_many_queries(spark):
    asked = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(F.rand(1), F.rand(2)).alias("query_vector"))
    items = spark.range(50).select(F.col("id").alias("item_id"), F.array(F.rand(3), F.rand(4)).alias("embedding"))
    near = J.similarities(asked, items, 1, broadcast_bytes=0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and plan.count("Range (0, 50") == 1
    assert J.top_k(near, 1, [F.desc("similarity"), "item_id"]).count() == 100_000


def test_triplets_by_hand(spark, vectors):
    asked = vectors[:20]
    positives = [(q, i, s) for q, _ in asked for q2, i, s in nearest(vectors, asked, 3) if q2 == q]
    got = learn.mine_triplets(
        spark.createDataFrame(positives, "query_id bigint, item_id bigint, similarity double"), spark.createDataFrame(asked, "query_id bigint, query_vector array<double>"), spark.createDataFrame(vectors, "item_id bigint, embedding array<double>")
    )
    want, known = set(), {(q, i) for q, i, _ in positives}
    for q, pos, sim in positives:
        v = dict(asked)[q]
        rest = [(i, s) for _, i, s in nearest(vectors, [(q, v)], len(vectors), [0.95 * sim]) if (q, i) not in known]
        want |= {(q, pos, i, n + 1) for n, (i, _) in enumerate(sorted(rest, key=lambda r: (-r[1], r[0]))[:5])}
    assert set(map(tuple, got.collect())) == want


def recall(spark, items, asked, index, k=10):
    exact = J.top_k(J.similarities(asked, items, k), k, [F.desc("similarity"), "item_id"]).select("query_id", "item_id", "similarity")
    found = index.search(asked, items, k).select("query_id", "item_id", "similarity")
    n = exact.count()
    assert found.count() == n
    return exact.join(found, ["query_id", "item_id"]).count() / n


def test_index_on_evenly_spread_vectors(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    items = rows.select(F.col("vec_id").alias("item_id"), "embedding")
    index = VectorIndex.build(items, str(tmp_path / "index"))
    assert index.codes().agg(F.sum("n")).first()[0] == items.count()
    assert recall(spark, items, asked, index) >= 0.9
    # whole vectors are read for a fifth of the pairs at most; the others are seen as 16 bytes, if at all
    assert index.candidates(asked, 200).count() <= 0.2 * asked.count() * items.count()


def test_index_on_clusters_reads_few_cells(spark, tmp_path):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 24))
    x = centres[draw.integers(0, 40, 4000)] + 0.25 * draw.normal(size=(4000, 24))
    items = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "item_id bigint, embedding array<float>").repartition(4)
    asked = items.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex.build(items, str(tmp_path / "index"), cells=60)
    assert recall(spark, items, asked, index) >= 0.9
    sizes = index.codes().groupBy("cell").agg(F.sum("n").alias("n"))
    seen = index.asked(asked).select("query_id", F.explode("cells").alias("cell")).join(sizes, "cell").agg(F.sum("n")).first()[0]
    assert seen <= 0.2 * 80 * 4000
    one = index.candidates(asked.filter("query_id = 0"), 20)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString()


def test_index_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0]), (1, [1.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    index = VectorIndex.build(items, str(tmp_path / "index"))
    assert index.codes().agg(F.sum("n")).first()[0] == 4
    asked = spark.createDataFrame([(7, [2.0, 0.1]), (8, None), (9, [0.0, 0.0])], "query_id bigint, query_vector array<double>")
    assert {r["query_id"] for r in index.search(asked, items, 2).collect()} == {7}
    with pytest.raises(ValueError):
        VectorIndex.build(items.filter("item_id = 3"), str(tmp_path / "none"))


def test_fit_measures_the_cells():
    draw = np.random.default_rng(0)
    tight = np.repeat(draw.normal(size=(8, 16)), 50, axis=0) + 0.01 * draw.normal(size=(400, 16))
    assert vector_index.fit(tight, 8, 0.97, 10).probes <= 2
    assert vector_index.fit(draw.normal(size=(400, 16)), 8, 0.97, 10).probes >= 4


@pytest.mark.parametrize("options", [64 << 20, 0])
def test_near_pairs_are_all_pairs(spark, vectors, options, monkeypatch):
    monkeypatch.setattr(grid, "_rows_a_block", lambda width: 64)
    monkeypatch.setattr(grid, "PANEL", 20)
    items = spark.createDataFrame([*vectors, (500, None)], "item_id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([*vectors[:90], (999, None)], "query_id bigint, query_vector array<double>")
    want = [p for p in nearest(vectors, vectors[:90], len(vectors)) if p[2] >= 0.22]
    assert sorted(map(tuple, filters.near_pairs(asked, items).collect())) == want


def test_the_gate_judges_all_pairs_of_vectors(spark):
    """The query is not cut to one query an item (F7)."""
    from millrace.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = {(r["query_id"], r["item_id"]) for r in QUERIES["b7_semantic_gate"](spark, folder).collect()}
    held = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").join(spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("doc_id", "vec_id"), "vec_id").select("vec_id", "embedding").collect()]
    asked = [(i // 50, v) for i, v in ((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()) if i % 50 == 0]
    assert {(q, i) for q, i, s in nearest(held, asked, len(held)) if s >= 0.22} <= rows


def test_cells_are_compared_without_a_shuffle_of_pairs(spark, vectors):
    """Same rows as Spark's join of cells, whose candidates never leave a task here."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    short = [(i, [x / 8 for x in v]) for i, v in vectors]
    items, asked = spark.createDataFrame(short, "item_id bigint, embedding array<double>"), spark.createDataFrame(short[:40], "query_id bigint, query_vector array<double>")
    coded = lambda rows, c: rows.select(rows.columns[0], array_to_vector(c).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.1, numHashTables=2, seed=3).fit(coded(items, "embedding"))
    pairs = {(r[0], r[1]) for r in model.approxSimilarityJoin(coded(asked, "query_vector"), coded(items, "embedding"), 0.5, "dist").select("datasetA.query_id", "datasetB.item_id").collect()}
    assert 0 < len(pairs) < 40 * len(short) / 2
    ranked, want = {}, set()
    for q, i, s in sorted((p for p in nearest(short, short[:40], len(short)) if p[:2] in pairs), key=lambda p: (p[0], -p[2], p[1])):
        ranked.setdefault(q, []).append((q, i, s))
    for rows in ranked.values():
        want |= set(rows[:3])
    found = learn.lsh_search(asked, items, 3, bucket=0.1, tables=2, radius=0.5)
    assert {(r["query_id"], r["item_id"], r["similarity"]) for r in found.collect()} == want
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()

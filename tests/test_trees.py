"""Listwise boosted trees."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import evaluate as E
from millrace.operators import learn as L
from millrace.operators import trees


def saver(spark, folder):
    turn = iter(range(99))

    def save(df):
        path = str(folder / f"t{next(turn)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def planted(spark, queries=40, hits=30):
    """Hits are good where one of two features is high and the other low: no sum of features tells."""
    draw = np.random.default_rng(4)
    rows, grades = [], []
    for q in range(queries):
        for i in range(hits):
            a, b = map(float, draw.random(2))
            x = dict.fromkeys(L.FEATURES, 0.0) | {"relevance": a, "quality": b, "recency": float(draw.random())}
            rows.append((q, q * 100 + i, 0.01, float(draw.random()), *x.values()))
            if (a > 0.5) != (b > 0.5):
                grades.append((q, q * 100 + i, 3))
    cols = "query_id bigint, item_id bigint, fused double, final double, " + ", ".join(f"{f} double" for f in L.FEATURES)
    return spark.createDataFrame(rows, cols), spark.createDataFrame(grades, "query_id bigint, item_id bigint, grade int")


def test_trees_beat_pairs_on_an_interaction(spark, tmp_path):
    save = saver(spark, tmp_path)
    rows, qrels = (save(t) for t in planted(spark))
    queries = save(rows.select("query_id").distinct())
    out, ranker = L.cross_validate_trees(rows, qrels, queries, save, k=2, trees=8)
    got = {r["model"]: r for r in out.collect()}
    pairwise = E.metrics(L.apply_ranker(rows, L.train_ranker(rows, qrels)), qrels, queries).agg(F.avg("ndcg")).first()[0]  # seen in the fit
    assert got["trees"]["ndcg"] > pairwise + 0.15 and got["trees"]["ndcg"] > 0.9 and got["trees"]["adopted"]
    assert all(sum(f < 0 for f in t.feature) <= 15 for t in ranker.trees)
    again = trees.Ranker.load(ranker.dump())
    x = np.random.default_rng(0).random((50, len(L.FEATURES)))
    assert (again.score(x) == ranker.score(x)).all()


def test_sums_equal_one_task(spark, tmp_path):
    """The first split is that of all rows in numpy, whatever the partitions."""
    rows, qrels = planted(spark, 12, 20)
    graded = rows.join(qrels, ["query_id", "item_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))).withColumn("fold", F.lit(0))
    (model,) = trees.train(graded.repartition(5), L.FEATURES, saver(spark, tmp_path), trees=1, leaves=2, least=5)
    data = graded.orderBy("query_id", "item_id").toPandas()
    b = model.bins(data[list(L.FEATURES)].to_numpy())
    sums = np.zeros((len(L.FEATURES), trees.BINS, 3))
    for _, part in data.groupby("query_id"):
        g, h = trees.lambdas(np.zeros(len(part)), part["grade"].to_numpy(float), 30)
        for j in range(len(L.FEATURES)):
            for k, w in enumerate((g, h, None)):
                sums[j, :, k] += np.bincount(b[part.index, j], w, trees.BINS)
    _, _, feature, bin_ = trees._best_split(sums, 0, 5, 1.0)[0]
    assert (model.trees[0].feature[0], model.trees[0].bin[0]) == (feature, bin_)


def test_nothing_to_learn(spark, tmp_path):
    rows, _ = planted(spark, 3, 5)
    flat = rows.withColumns({"grade": F.lit(0), "fold": F.lit(0)})
    (model,) = trees.train(flat, L.FEATURES, saver(spark, tmp_path), trees=3)
    assert model.trees == [] and trees.with_score(flat, L.FEATURES, [model]).agg(F.sum("score")).first()[0] == 0


def test_models_grown_in_a_task_are_those_of_the_jobs(spark, tmp_path, monkeypatch):
    rows, qrels = planted(spark, 16, 20)
    graded = rows.join(qrels, ["query_id", "item_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))).withColumn("fold", F.col("query_id") % 2)
    found = [trees.train(graded, L.FEATURES, saver(spark, tmp_path / "task"), 2, trees=3, leaves=5, least=5)]
    monkeypatch.setattr(trees, "FIT_BYTES", 0)
    found.append(trees.train(graded, L.FEATURES, saver(spark, tmp_path / "jobs"), 2, trees=3, leaves=5, least=5))
    for a, b in zip(*found):
        assert a.cuts == b.cuts and len(a.trees) == len(b.trees) == 3
        for x, y in zip(a.trees, b.trees):
            assert (x.feature, x.bin, x.left, x.right) == (y.feature, y.bin, y.left, y.right)
            assert np.allclose(x.value, y.value, rtol=1e-9)


def test_the_registered_query_grows_all_trees(monkeypatch):
    """No parameter of the query leaves trees out: it takes the 120 of the function."""
    import inspect

    from millrace.plans import QUERIES
    from millrace.plans import search_queries as Q

    given = {}
    for name in ("hits", "qrels_of"):
        monkeypatch.setattr(Q, name, lambda *a: None)
    monkeypatch.setattr(Q, "written", lambda s, df: df)
    monkeypatch.setattr(Q, "now", lambda: None)
    monkeypatch.setattr(Q.X, "queries", lambda *a: None)
    monkeypatch.setattr(Q.L, "ltr_features", lambda *a: None)
    monkeypatch.setattr(Q.L, "cross_validate_trees", lambda *a, **options: (given.update(options), None))
    QUERIES["k6b_listwise_trees"](None, "")
    assert given == {} and inspect.signature(trees.train).parameters["trees"].default == 120

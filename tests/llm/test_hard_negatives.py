"""Hard negatives against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, score string, block string"


def rows():
    draw = random.Random(3)
    out = []
    for i in range(400):
        v = [draw.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)]
        out.append((i, v, draw.choice([0, 1, 2, 9])))
    out += [(400, None, 1), (401, [1.0, None, 0.5], 1), (402, [float("nan"), 1.0], 2), (403, [float("inf")] * 6, 0), (404, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    out += [(450, [1.0, 0.5], 0), (451, [1.0] * 9, 2), (452, [], 1), (7, out[7][1], out[7][2]), (60, [1.0] * 6, 1), (60, [1.0] * 6, 1), (500, [-1.0] * 6, 5)]
    return out


def expected(table, is_anchor, n_positives=5, k=3):
    use = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in table if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, v, y in use:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    for anchor, (label, a) in anchors.items():
        scored = sorted((-sum(x * z for x, z in zip(a, v)), i, y) for i, v, y in use if i != anchor)
        for s, positive, _ in [r for r in scored if r[2] == label][:n_positives]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:k]
            out += [(anchor, positive, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "slices": 3}])
def test_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(hard_negatives.grid, "_rows_a_block", lambda width: 64)
    table = rows()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in table], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options)
    assert sorted(tuple(r) for r in got.collect()) == expected(table, lambda i: i % 10 == 0)


def test_empty_and_lonely(spark):
    one = F.col("vec_id") % 10 == 0
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), one).count() == 0
    lonely = spark.createDataFrame([(10, [1.0], 1, "", "", ""), (11, [1.0], 2, "", "", "")], SCHEMA)
    assert hard_negatives.mine(lonely, one).count() == 0
    assert hard_negatives.mine(lonely, F.col("vec_id") > 99).count() == 0


def test_large_components_are_exact(spark):
    big = 2.0**19 + 1 / 256
    table = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big * 0.75, 0.5], 2), (3, [big * 0.75, 0.25], 2)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0).collect()) == expected(table, lambda i: i == 0)
    with pytest.raises(Exception, match="2\\*\\*56"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e9], 1), (1, [1e9], 1)], df.schema), F.col("vec_id") == 0).collect()

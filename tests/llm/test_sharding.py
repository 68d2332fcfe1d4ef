"""The hash tree against a plain Python descent, and what moves when it changes."""

import hashlib
import math
import tempfile
import zlib
from collections import Counter
from dataclasses import replace

import pytest

from millrace.llm import sharding
from millrace.llm.sharding import Leaf

SCHEMA = "doc_id bigint, text string, shard string, slot string, cell string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def expected(key, leaves):
    def draw(nodes):
        return min((-math.log((int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight, i) for i, (name, weight) in enumerate(nodes))[1]

    at, inside = "root", [(i, leaf) for i, leaf in enumerate(leaves) if leaf.weight > 0]
    for level in ("region", "rack", "shard"):
        groups = {}
        for i, leaf in inside:
            groups.setdefault(i if level == "shard" else getattr(leaf, level), []).append((i, leaf))
        names = sorted(groups)
        chosen = names[draw([(f"{at}.{n}", sum(leaf.weight for _, leaf in groups[n])) for n in names])]
        at, inside = f"{at}.{chosen}", groups[chosen]
    return inside[0][0]


@pytest.fixture(scope="module")
def rows():
    out = [(i, "word " * (i % 7) + "é") for i in range(600)]
    return out + [(600, None), (601, ""), (None, "no id"), (None, "no id"), (None, None), (3, "other text"), (602, "x" * 200_000)] + [(77, "copy")] * 500


def test_ledger(spark, rows):
    tree = [Leaf(0, 0, 2.0), Leaf(0, 1), Leaf(0, 1, 0.5), Leaf(1, 0), Leaf(2, 0, 3.0), Leaf(2, 0, 0.0)]
    more = sharding.grown(tree, 2.0)
    got = sharding.ledger(frame(spark, rows).repartition(5), tree, more).collect()
    assert len(got) == len(rows)
    text = lambda t: (t or "").encode()
    key = lambda i, t: str(i) if i is not None else "text:" + hashlib.md5(t.encode()).hexdigest() if t is not None else ""
    want = Counter((i, len(text(t)) + 16, zlib.crc32(text(t)), "key", expected(key(i, t), tree), expected(key(i, t), more)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {len(tree)}
    again = sharding.ledger(frame(spark, rows[::-1]).repartition(2), tree, more).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_movement_stays_in_changed_subtrees(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    tree = sharding.layout(24)
    heavier = [replace(leaf, weight=2.0) if i == 9 else leaf for i, leaf in enumerate(tree)]
    moved = sharding.movement(docs, tree, heavier).collect()
    # shard 9 is in rack 0 of region 1: others move only into that region, its racks only into that rack, its shards only into 9
    assert moved and {r["target"] // 8 for r in moved} == {1}
    assert {r["target"] // 4 for r in moved if r["source"] // 8 == 1} == {2}
    assert {r["target"] for r in moved if r["source"] // 4 == 2} == {9}
    sizes = Counter(r["shard"] for r in sharding.place(docs, sharding.layout(40)).collect())
    assert len(sizes) == 40 and max(abs(n - 100) for n in sizes.values()) < 45
    taken = sharding.movement(docs, sharding.layout(40), sharding.grown(sharding.layout(40))).collect()
    assert {r["target"] for r in taken} == {40} and 60 < sum(r["n_rows"] for r in taken) < 140


def test_columns_empty_and_files(spark, rows):
    docs, tree = frame(spark, rows), sharding.layout(10)
    placed = sharding.place(docs, tree)
    assert set(placed.columns) == set(docs.columns) and dict(placed.dtypes)["shard"] == "int"
    none = spark.createDataFrame([], SCHEMA)
    assert sharding.ledger(none, tree, sharding.grown(tree)).count() == 0 and sharding.place(none, tree).count() == 0
    path = tempfile.mkdtemp(prefix="spark-") + "/shards"
    written = sharding.write(docs, tree, path)
    assert {r["shard"]: r["n_rows"] for r in written.collect()} == dict(Counter(r["shard"] for r in placed.collect()))
    with pytest.raises(ValueError):
        sharding.place(docs, [Leaf(0, 0, 0.0)])

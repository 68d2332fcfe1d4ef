"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluate as E
from millrace.operators import filters as B
from millrace.operators import learn as L
from millrace.operators import retrieve as J
from millrace.operators.rank import mmr
from millrace.sources import feeds, sinks
from millrace.sources.models import ModelStore
from millrace.sources.snapshots import SnapshotStore
from millrace.sources.versions import Conflict, Log
from millrace.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://WWW.Example.com:80/a/?utm_source=x&b=1#t", "https://example.com/a?b=1"),
        ("example.com/", "https://example.com"),
        ("https://x.com:8080/p?ref=a", "https://x.com:8080/p"),
        ("", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, T.canonical_url(F.lit(url))) == want


def test_dates(spark):
    assert str(value(spark, T.parse_date(F.lit("Tue, 2 Jan 2024 03:04:05 +0000")))) == "2024-01-02 03:04:05"
    assert value(spark, T.parse_date(F.lit("soon"))) is None


def test_setup_commands_and_paragraph(spark):
    text = "# T\n\n![b](x)\n\nThis is the first paragraph of prose, long enough.\n\n```bash\n$ pip install a\nls\n```\n"
    assert value(spark, T.setup_commands(F.lit(text))) == ["pip install a"]
    assert value(spark, T.first_paragraph(F.lit(text))).startswith("This is the first")


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id bigint, item_id bigint, rank int")
    qrels = spark.createDataFrame([(1, 11, 3), (1, 12, 1)], "query_id bigint, item_id bigint, grade bigint")
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    rows = {r["query_id"]: r for r in E.metrics(run, qrels, queries, 2).collect()}
    assert rows[1]["recall"] == 0.5 and rows[1]["mrr"] == 0.5
    assert rows[1]["ndcg"] == pytest.approx(3 / 1.5849625 / (3 + 1 / 1.5849625), abs=1e-5)
    assert (rows[2]["recall"], rows[2]["ndcg"]) == (1.0, 0.0)


def test_guard(spark):
    good = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.6, 0.5)], "query_id bigint, ndcg double, recall double")
    bad = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.7, 0.5)], "query_id bigint, ndcg double, recall double")
    assert E.regression_guard(good, good).count() == 0
    assert {r["reason"] for r in E.regression_guard(good, bad).collect()} == {"ndcg fell", "query 1 fell"}
    assert L.refresh_guard(good, good, "v1").first()["adopted"] is True


def test_keyword_legs(spark):
    items = spark.createDataFrame([(1, "red blue green", "x"), (2, "red or far far far far blue", "y"), (3, "green", "red")], "item_id bigint, title string, summary string")
    posts = J.postings(items, {"title": "A", "summary": "B"})
    terms = spark.createDataFrame([(7, "red"), (7, "blue")], "query_id bigint, term string")
    both = {r["item_id"]: r["kw_rank"] for r in J.keyword_and_leg(terms, posts).collect()}
    assert set(both) == {1, 2} and both[1] > both[2]
    web = spark.createDataFrame([(7, '"red blue" or green -y')], "query_id bigint, query string")
    assert {r["item_id"] for r in J.keyword_web_leg(web, posts).collect()} == {1, 3}


def test_mmr_prefers_other_tokens(spark):
    hits = spark.createDataFrame([(1, 1, 1, ["a", "b"]), (1, 2, 2, ["a", "b"]), (1, 3, 3, ["c"])], "query_id bigint, item_id bigint, rank int, tokens array<string>")
    assert [r["item_id"] for r in mmr(hits, 2).orderBy("mmr_rank").collect()] == [1, 3]


def test_upsert_twice_is_the_same(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "item_id bigint, canonical_url string, summary string")
    new = spark.createDataFrame([(9, "a", "z"), (8, None, "q"), (7, "c", "w")], "item_id bigint, canonical_url string, summary string")
    once = sinks.upsert_items(old, new, keep_if_null=())
    assert {(r["item_id"], r["summary"], r["status"]) for r in once.collect()} == {(1, "z", "updated"), (2, "y", "kept"), (7, "w", "inserted")}
    twice = sinks.upsert_items(once.drop("status"), new, keep_if_null=())
    assert {(r["item_id"], r["summary"]) for r in twice.collect()} == {(1, "z"), (2, "y"), (7, "w")}
    assert sinks.skipped(new).count() == 1


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; b</title><link>http://x.com/1?utm_a=1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Tue, 2 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>"
    row = feeds.map_feed_articles(spark.createDataFrame([(rss,)], "value string")).first()
    assert (row["canonical_url"], row["title"], row["summary"]) == ("https://x.com/1", "A & b", "Hi")
    assert row["published_at"] is not None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, 'click' AS event_type, id % 3 AS user_id FROM range(400)")
    rows.write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):  # a restart adds nothing
        jobs.run_to_end(jobs.windowed_counts(jobs.read_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "check"))
    closed = spark.read.parquet(str(tmp_path / "out"))
    batch = jobs.windowed_counts(rows)
    assert closed.count() >= 4
    assert closed.exceptAll(batch).count() == 0


def test_click_rates_stream_equals_batch(spark, tmp_path):
    shown = spark.range(400).selectExpr("id % 7 AS query_id", "id AS item_id", "cast(id % 4 AS int) AS pos", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts")
    clicks = shown.filter("item_id % 3 = 0").selectExpr("query_id", "item_id", "ts + make_interval(0, 0, 0, 0, item_id % 9) AS ts")
    clicks = clicks.unionByName(clicks.filter("item_id % 30 = 0"))  # some are clicked twice
    batch = jobs.click_rates(shown, clicks)
    want = {}
    for i in range(400):
        n = want.setdefault((i // 24, i % 4), [0, 0])
        n[0] += 1
        n[1] += (1 + (i % 30 == 0)) * (i % 3 == 0 and i % 9 <= 6)
    got = {((r["start"] - min(x["start"] for x in batch.collect())).days, r["pos"]): [r["shown"], r["clicks"]] for r in batch.collect()}
    assert got == want
    for name, rows in (("i", shown), ("c", clicks)):
        for day in range(0, 18, 4):  # files in the order of their times
            since = F.datediff("ts", F.lit("2024-01-01"))
            rows.filter((since >= day) & (since < day + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [jobs.read_stream(spark, str(tmp_path / name), rows.schema, 1) for name, rows in (("i", shown), ("c", clicks))]
    for _ in range(2):  # a restart adds nothing
        jobs.run_to_end(jobs.click_rates(*streams), str(tmp_path / "out"), str(tmp_path / "check"))
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert closed.count() > 20 and closed.exceptAll(batch).count() == 0


def posts_of(spark, path, ids):
    rows = [(f'{{"objectID": "{i}", "title": "t{i}", "url": "http://x.com/{i % 3}", "points": 9, "created_at": "2024-01-02"}}',) for i in ids]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").parquet(path)


def post_items(batch):
    return feeds.map_forum_posts(batch).withColumn("item_id", F.xxhash64("title"))


def test_ingest_stream(spark, tmp_path):
    posts_of(spark, str(tmp_path / "in"), range(6))
    store = SnapshotStore.create(post_items(spark.createDataFrame([], "value string")), str(tmp_path / "store"), buckets=8)
    run = lambda: jobs.ingest(jobs.read_stream(spark, str(tmp_path / "in"), "value string"), post_items, store, str(tmp_path / "check"), gate=F.col("title") != "t5")
    got = [r.asDict() for r in run().collect()]
    assert [{k: r[k] for k in ("batch", "seen", "skipped", "gated", "inserted", "updated")} for r in got] == [{"batch": 0, "seen": 6, "skipped": 0, "gated": 1, "inserted": 3, "updated": 0}]
    assert sorted(r["canonical_url"] for r in store.read().collect()) == [f"https://x.com/{i}" for i in range(3)]
    posts_of(spark, str(tmp_path / "in"), [7])
    assert [r["updated"] for r in run().orderBy("batch").collect()] == [0, 1]


def test_a_killed_ingest_starts_over(spark, tmp_path, monkeypatch):
    posts_of(spark, str(tmp_path / "in"), range(6))
    store = SnapshotStore.create(post_items(spark.createDataFrame([], "value string")), str(tmp_path / "store"), buckets=8)
    run = lambda: jobs.ingest(jobs.read_stream(spark, str(tmp_path / "in"), "value string"), post_items, store, str(tmp_path / "check"))
    swap = SnapshotStore._swap

    def dies_before(self, manifest):
        raise OSError("killed")

    def dies_after(self, manifest):
        swap(self, manifest)
        raise OSError("killed")

    for fault, rows in ((dies_before, 0), (dies_after, 3)):
        monkeypatch.setattr(SnapshotStore, "_swap", fault)
        with pytest.raises(Exception, match="killed"):
            run()
        assert store.read().count() == rows
    monkeypatch.setattr(SnapshotStore, "_swap", swap)
    assert [(r["seen"], r["inserted"]) for r in run().collect()] == [(6, 3)]
    assert store.read().count() == 3
    assert store.clean() and store.read().count() == 3 and not store.clean()


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    old = spark.range(2000).selectExpr("id AS item_id", "concat('u', id) AS canonical_url", "'x' AS summary")
    store = SnapshotStore.create(old, str(tmp_path / "s"), buckets=32)
    before = store.manifest()["folders"]
    batch = spark.createDataFrame([(9, "u17", "new"), (10, "fresh", "y"), (11, None, "z")], "item_id bigint, canonical_url string, summary string")
    rules = {"keep_if_null": ()}
    assert store.upsert(batch, 0, **rules) == {"seen": 3, "skipped": 1, "gated": 0, "inserted": 1, "updated": 1}
    after = store.manifest()["folders"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(before) == 32
    want = sinks.upsert_items(old, batch, **rules)
    assert sorted(map(tuple, store.changes().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # the same batch again, or an earlier one, changes nothing
    assert store.upsert(batch, 0, **rules)["inserted"] == 1 and store.manifest()["folders"] == after
    assert store.upsert(batch.limit(0), 1, **rules) == {"seen": 0, "skipped": 0, "gated": 0, "inserted": 0, "updated": 0}
    assert store.upsert(spark.createDataFrame([(1, "u1", "a")], batch.schema), 5, source="other", **rules)["updated"] == 1
    assert store.read().count() == 2001 and store.ledger().count() == 3


def test_of_two_writers_one_starts_over(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.last() is None and log.append({"a": 1}) == 0
    with pytest.raises(Conflict):
        log.folder.write_once("0000000000.json", "{}")
    assert log.last() == {"a": 1} and log.append({"a": 2}) == 1 and log.table("a int").count() == 2


def test_models_are_adopted_and_rolled_back(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    metrics = lambda model: spark.createDataFrame([(1, (model or {}).get("ndcg", 0.2), 0.5)], "query_id bigint, ndcg double, recall double")
    assert store.adopted() is None
    refresh = lambda ndcg: store.refresh(lambda: {"ndcg": ndcg}, metrics, E.regression_guard)
    assert refresh(0.5) == (0, []) and store.adopted() == 0
    version, reasons = refresh(0.3)  # worse
    assert version == 1 and "ndcg fell" in reasons and store.adopted() == 0 and store.model(store.adopted()) == {"ndcg": 0.5}
    assert refresh(0.6) == (2, []) and store.adopted() == 2
    assert store.roll_back() == 0 and store.adopted() == 0 and store.roll_back() is None and store.adopted() is None
    assert [r["event"] for r in store.history().orderBy("turn").collect()] == ["adopted", "adopted", "rolled back", "adopted", "rolled back", "rolled back"]


def test_lsh_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    items = rows.select(F.col("vec_id").alias("item_id"), "embedding")
    exact = J.top_k(J.similarities(asked, items, 10), 10, [F.desc("similarity"), "item_id"]).select("query_id", "item_id")
    found = L.lsh_search(asked, items, k=10).select("query_id", "item_id")
    n, hits = exact.count(), exact.join(found, ["query_id", "item_id"]).count()
    assert n == 400 and hits >= 0.9 * n


def test_rotation_goes_round(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 10), ("a", 50_000), ("a", 9_000), ("b", 7), (None, 1), ("b", None)], "source_type string, item_id bigint")
    offsets = spark.createDataFrame([("a", 3), ("c", 1)], "source_type string, offset bigint")
    window, after = B.rotate(rows, offsets, 2)
    assert {tuple(r) for r in window.collect()} == {("a", 50_000), ("a", 3), ("b", 7)}
    assert {tuple(r) for r in after.collect()} == {("a", 1), ("b", 0)}
    again, _ = B.rotate(rows, after, 2)
    assert {tuple(r) for r in again.collect()} == {("a", 10), ("a", 9_000), ("b", 7)}


def test_semantic_gate_passes_the_unknown(spark):
    found = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, [0.0, 1.0]), (1, 12, None), (2, 13, [1.0, 0.0]), (3, 14, [1.0]), (1, 15, [0.0, 0.0])], "query_id bigint, item_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id bigint, query_vector array<double>")
    assert {r["item_id"]: r["similarity"] for r in B.semantic_gate(found, asked).collect()} == {10: 0.995037, 12: 0.0, 13: 0.0, 14: 0.0}


def test_vectors_as_text_are_rounded_from_their_binary_value(spark):
    values = [0.0703125, -0.0703125, 0.0078125, 1.0000005, 0.5, -0.0, 123456789.1234567, 0.9999999, -0.0000001, float("nan"), float("inf")]
    rows = spark.createDataFrame([(1, values), (2, []), (3, None), (4, [1.0, None, 2.5])], "id bigint, v array<double>")
    got = {r["id"]: r["t"] for r in rows.select("id", T.format_vector(F.col("v")).alias("t")).collect()}
    assert got == {1: "[" + ",".join(f"{x:.6f}" for x in values) + "]", 2: "[]", 3: None, 4: "[1.000000,2.500000]"}


@pytest.mark.parametrize("text, score", [("an ai thing", 10), ("aiè.", 0), ("éai", 0), ("ml", 10), ("ai_x", 0), ("(ml)", 10), ("air", 0)])
def test_short_words_end_where_letters_of_any_script_end(spark, text, score):
    import duckdb

    from millrace.functions import scores as S
    from millrace.plans.item_queries import HYPE

    long_enough = "x" * 30
    row = spark.createDataFrame([(text, "one two three four " + text, long_enough, True, ["run"])], "summary string, title string, core string, has_code boolean, commands array<string>")
    full = row.withColumns({"use_case": F.lit(""), "has_demo": F.lit(False), "has_paper": F.lit(False)})
    got = full.select(S.hype_risk().alias("h")).first()["h"]
    names = "title, summary, use_case, core, has_code, has_demo, has_paper, commands"
    sql = duckdb.execute(f"SELECT {HYPE} FROM (SELECT * FROM (VALUES (?, ?, '', ?, true, false, false, ['run'])) v({names}))", ["one two three four " + text, text, long_enough]).fetchone()[0]
    assert got == sql == score + 15

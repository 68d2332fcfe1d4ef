"""Rows that have no SQL: small cases with known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import contains
from millrace.operators import evaluate as E
from millrace.operators import intent as I
from millrace.operators import learn as L
from millrace.operators import rank as R
from millrace.operators import retrieve as J
from millrace.sources import feeds
from millrace.streaming import jobs

ITEM = "item_id bigint, title string, summary string, use_case string, core string, tags array<string>, tools array<string>, frameworks array<string>, languages array<string>, commands array<string>, artifact_type string, source_type string, source_url string, has_code boolean, has_demo boolean, has_paper boolean, quality double, remix double, hype double, underground double, popularity double, stars bigint, published_at timestamp"


def item(i, title="a tool", summary="", use_case="", core="", tags=(), tools=(), frameworks=(), languages=(), commands=(), kind="open_source_project", source="github", url="https://github.com/o/r", code=False, demo=False, paper=False, quality=50.0, remix=50.0, hype=50.0, under=50.0):
    return (i, title, summary, use_case, core, list(tags), list(tools), list(frameworks), list(languages), list(commands), kind, source, url, code, demo, paper, quality, remix, hype, under, 10.0, 5, None)


def intents(spark, *texts):
    return I.enrich_intent(I.extract_intent(spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")))


def test_infer_fields(spark):
    text = "An MCP server in TypeScript with Next.js and OpenAI\n```bash\nnpm install x\nnpm install x\n```\n- Configure the API key first\n- short"
    row = I.infer_fields(spark.createDataFrame([(1, text), (2, "a dataset"), (3, "")], "doc_id bigint, text string"), "doc_id", "text").orderBy("doc_id").collect()
    assert (row[0]["artifact_type"], row[1]["artifact_type"], row[2]["artifact_type"]) == ("mcp_server", "dataset", "open_source_project")
    assert row[0]["frameworks"] == ["Next.js"] and row[0]["tools"] == ["OpenAI", "MCP"] and row[0]["apis"] == ["OpenAI"]
    assert row[0]["languages"] == ["TypeScript"] and row[0]["tags"] == ["TypeScript", "Next.js", "OpenAI", "MCP"]
    assert "Configure the API key first" in row[0]["steps"] and "npm install x" in row[0]["commands"]


def test_presentation(spark):
    rows = [
        item(1, "o/r", "A tool that reads documents and answers questions about them.", commands=["pip install r", "python -m r"], tools=["pgvector"], code=True, remix=80.0, under=70.0, hype=20.0),
        item(2, "Paper", source="arxiv", url=None, kind="research_paper", paper=True),
        item(3, "Plain", source="rss", url=None, quality=90.0),
    ]
    one, two, three = R.presentation(spark.createDataFrame(rows, ITEM)).orderBy("item_id").collect()
    assert one["headline"] == "r" and one["simple_implementation"] == "pip install r"
    assert one["start_steps"] == ["git clone https://github.com/o/r", "cd r", "pip install r", "python -m r"]
    assert one["key_points"][1] == "Stack: pgvector" and len(one["stands_out"]) == 3 and one["about"].startswith("A tool that reads")
    assert two["simple_implementation"] == "" and len(two["start_steps"]) == 3 and two["stands_out"] == ["Backed by research"]
    assert three["stands_out"] == ["High quality and well documented"] and three["how_it_helps"] != ""


@pytest.mark.parametrize(
    "query, made, start",
    [
        ("chrome extension rag for papers", item(1), "Fits as it joins a browser"),
        ("anything", item(1, "rag in a browser"), "Fits as it is a browser extension"),
        ("lecture quiz", item(1), "Fits as it turns lectures"),
        ("mcp", item(1, tools=["MCP"]), "Fits as it is tooling for coding agents, with MCP"),
        ("webcam pose", item(1), "Fits as it applies computer vision"),
        ("redis", item(1, frameworks=["Redis"], code=True), "Fits as it uses Redis and its code is open."),
        ("nothing", item(1, code=True), "Fits as its code is open."),
        ("nothing", item(1, summary="words"), "Fits by its summary"),
        ("nothing", item(1), "Fits by meaning"),
    ],
)
def test_why_relevant(spark, query, made, start):
    hits = R.with_blob(spark.createDataFrame([made], ITEM)).join(R.asked(intents(spark, query)))
    assert R.why_relevant(hits).first()["why"].startswith(start)


def test_suggestions(spark):
    cols = "query_id bigint, rank int, tools array<string>, frameworks array<string>, tags array<string>"
    rows = [(q, r, ["Qdrant"], [], ["offline", "github"]) for q in (0, 1, 2) for r in (1, 2, 3)] + [(3, 1, ["Qdrant"], [], [])]
    asked = intents(spark, "note taking", "note taking with react", "offline notes for me", "one hit")
    confident = asked.select("query_id", F.when(F.col("query_id") == 9, 80).otherwise(20).alias("confidence"))
    got = {r["query_id"]: r["suggestion"] for r in I.suggest_query(spark.createDataFrame(rows, cols), asked, confident).collect()}
    assert got == {0: "note taking with Qdrant, focused on offline", 1: "note taking with react for offline", 2: "offline notes for me with Qdrant"}
    sure = asked.select("query_id", F.lit(80).alias("confidence"))
    assert I.suggest_query(spark.createDataFrame(rows, cols), asked, sure).count() == 0


def test_terms_by_automaton_and_by_join(spark, monkeypatch):
    items = spark.createDataFrame([(1, "storage of ragas", "x"), (2, "", "ci"), (3, None, "K8s"), (4, "aaa", "aa")], "item_id bigint, title string, body string")
    terms = spark.createDataFrame([(7, "rag"), (7, "ci"), (8, "k8s"), (8, "aa"), (8, ""), (9, "zzz")], "query_id bigint, term string")
    fields = {"title": F.lower("title"), "body": F.lower("body")}
    want = {(1, "rag", True, False), (2, "ci", False, True), (3, "k8s", False, True), (4, "aa", True, True)}
    assert set(map(tuple, J.contained_terms(items, terms, fields).collect())) == want
    monkeypatch.setattr(contains, "BROADCAST_TERMS", 1)
    assert set(map(tuple, J.contained_terms(items, terms, fields).collect())) == want
    plan = J.contained_terms(items, terms, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    # texts meet candidates once: no row of an exploded side holds one
    assert plan.count("Generate explode(m#") == 1 and "Generate explode(terms" not in plan


def test_rerankers(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, "red"), (1, 11, 0.8, "blue sky"), (1, 12, 0.7, "green")], "query_id bigint, item_id bigint, final double, summary string")
    queries = spark.createDataFrame([(1, "blue sky")], "query_id bigint, query string")
    got = {r["item_id"]: r["final"] for r in R.pair_order(queries, L.overlap_logit)(hits).collect()}
    assert max(got, key=got.get) == 11
    assert got[10] == pytest.approx(0.45 / (1 + np.exp(2.0)) + 0.55 * 0.9)
    assert R.learned_order({}, F.current_timestamp())(hits) is hits


def test_rankers_learn_the_better_feature(spark):
    draw = np.random.default_rng(2)
    rows, grades = [], []
    for q, i in itertools.product(range(20), range(12)):
        good = i % 3 == 0
        x = dict.fromkeys(L.FEATURES, 0.0) | {"relevance": float(good) + 0.1 * draw.random(), "quality": draw.random()}
        rows.append((q, q * 100 + i, 0.01, float(draw.random()), *x.values()))
        grades += [(q, q * 100 + i, 3)] if good else []
    cols = "query_id bigint, item_id bigint, fused double, final double, " + ", ".join(f"{f} double" for f in L.FEATURES)
    table, qrels = spark.createDataFrame(rows, cols), spark.createDataFrame(grades, "query_id bigint, item_id bigint, grade int")
    queries = table.select("query_id").distinct()
    out = {r["model"]: r for r in L.cross_validate(table, qrels, queries, k=2).collect()}
    assert set(out) == {"blend", "pairwise", "pointwise"}
    assert out["pairwise"]["ndcg"] > 0.95 > out["blend"]["ndcg"] and not out["blend"]["adopted"] and not out["pointwise"]["adopted"]
    assert out["pairwise"]["adopted"] == (out["pairwise"]["ndcg"] >= out["pointwise"]["ndcg"])
    model = L.train_ranker(table, qrels)
    top = L.apply_ranker(table, model, 4).join(qrels, ["query_id", "item_id"], "left_anti").count()
    assert model["relevance"] > abs(model["quality"]) and top == 0


def test_sweep_by_hand(spark):
    assert len(E.param_sets()) == 501 and all(len(p) == 16 for p in E.param_sets()) and E.param_sets() == E.param_sets()
    cols = "query_id bigint, item_id bigint, arrival int, key string, kw_rank double, similarity double, ranks array<int>, " + ", ".join(f"{c} double" for c in E.SWEPT)
    rows = [(1, i, i, f"k{i % 5}", 0.5, None, [i, None, None], *([0.5] * len(E.SWEPT))) for i in range(1, 9)]
    qrels = spark.createDataFrame([(1, 2, 3), (2, 5, 1)], "query_id bigint, item_id bigint, grade int")
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    got = {(r["param"], r["query_id"]): r["ndcg"] for r in E.param_sweep(spark.createDataFrame(rows, cols), [E.BASELINE], qrels, queries).collect()}
    assert got == {(0, 1): pytest.approx(1 / np.log2(3), abs=1e-6), (0, 2): 0.0}


def test_bootstrap_holds_the_mean(spark):
    values = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "query_id bigint, ndcg double")
    row = E.bootstrap_interval(values, "ndcg", 400).first()
    assert row["low"] < row["mean"] < row["high"] and row["high"] - row["low"] == pytest.approx(4 * 2.0 / 60**0.5, rel=0.3)


def test_papers_are_capped(spark):
    entry = "<feed><entry><id>http://arxiv.org/abs/1</id><title> T </title><summary>Code at github.com/a/b is here for all to read</summary><published>2024-01-02T03:04:05Z</published></entry></feed>"
    row = feeds.map_papers(spark.createDataFrame([(entry,)], "value string")).first()
    assert row["has_code"] and row["remix"] <= feeds.CODE_CAP and row["hype"] >= feeds.HYPE_FLOOR
    plain = feeds.map_papers(spark.createDataFrame([(entry.replace("github.com/a/b", "our desk"),)], "value string")).first()
    assert not plain["has_code"] and plain["remix"] <= feeds.PAPER_CAP


def test_code_repos(spark):
    raw = '{"full_name": "o/r", "html_url": "https://GitHub.com/o/r/", "topics": ["RAG", "rag", "My Topic"], "language": "Rust", "stargazers_count": 100, "forks_count": 50, "pushed_at": "2024-01-02T03:04:05Z", "readme": "# T\\n\\nThis paragraph is long enough to be a summary of it.\\n"}'
    rows = feeds.map_code_repos(spark.createDataFrame([(raw,), ('{"html_url": "https://github.com/a/b", "archived": true}',)], "value string")).collect()
    assert len(rows) == 1
    assert rows[0]["summary"].startswith("This paragraph") and rows[0]["tags"] == ["rag", "my-topic"] and rows[0]["popularity"] == pytest.approx(21.0)


def test_streamed_first_seen(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, id % 4 AS user_id FROM range(50)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.first_seen(jobs.read_stream(spark, str(tmp_path / "in"), rows.schema), ["user_id"])
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 == jobs.first_seen(rows, ["user_id"]).count()


def test_embedding_fills_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "red red blue", None), (2, "x", [1.0]), (3, " ", None)], "item_id bigint, summary string, embedding array<float>")
    got = {r["item_id"]: r for r in L.embed_missing(rows, "summary").collect()}
    assert got[1]["filled"] and sum(v * v for v in got[1]["embedding"]) == pytest.approx(1.0) and got[2]["embedding"] == [1.0] and got[3]["embedding"] is None
    ones = {r["item_id"]: r["embedding"] for r in L.embed_missing(rows, "summary", "all", lambda texts: np.ones((len(texts), 2))).collect()}
    assert ones[1] == ones[2] == [1.0, 1.0] and ones[3] is None


def test_first_paragraph_of_headings_alone(spark):
    assert spark.range(1).select(T.first_paragraph(F.lit("# A\n\n- b")).alias("p")).first()["p"] is None

"""Groups of terms scored where the texts are read."""

import re

import numpy as np
from pyspark.sql import functions as F

from millrace import fixtures as X
from millrace.operators import contains, in_texts
from millrace.operators import evaluate as E
from millrace.operators import retrieve as J

FIELDS = {"title": "A", "summary": "B"}


def catalogue(spark, n=300):
    word = lambda k: F.concat(F.lit("w"), (F.col("id") * k % 11).cast("string"))
    both = F.when(F.col("id") % 50 == 0, F.lit("red green blue")).otherwise(F.lit("red"))
    return spark.range(n).repartition(3).select(F.col("id").alias("item_id"), F.concat_ws(" ", word(3), word(7), both).alias("title"), F.concat_ws(" ", word(5), F.lit("the red")).alias("summary"), F.array(word(3)).alias("tags"), F.array().cast("array<string>").alias("tools"), F.array(word(7)).alias("frameworks"), (F.col("id") % 7).cast("double").alias("quality"))


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, term string")


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_keyword_search_over_texts_gives_the_rows_of_postings(spark, monkeypatch):
    items = catalogue(spark).persist()
    any_terms = asked(spark, [(1, "w3"), (1, "w4"), (2, "red"), (2, "the"), (3, "nowhere"), (4, None)])
    all_terms = asked(spark, [(1, "red"), (1, "blue"), (2, "w5"), (3, "red"), (3, "the")])
    typed = spark.createDataFrame([(1, "green blue"), (2, 'w1 or "red green"'), (3, "w2 -blue"), (4, "")], "query_id bigint, query string")
    posts = J.postings(items, FIELDS)
    want = J.keyword_search(any_terms, all_terms, typed, posts, 9)
    assert {r["query_id"] for r in want.collect()} == {1, 2, 3}
    same(J.keyword_texts(any_terms, all_terms, typed, items, FIELDS, 9), want)
    same(J.keyword_or_texts(any_terms, items, FIELDS, 9), J.keyword_or_leg(any_terms, posts, 9))
    monkeypatch.setattr(contains, "BROADCAST_TERMS", 2)  # by postings
    same(J.keyword_texts(any_terms, all_terms, typed, items, FIELDS, 9), want)


def test_a_task_lets_few_hits_go(spark):
    """Ties included, some k rows a query and task leave the texts, whatever their number."""
    wanted = [(0, q, 0, t) for q in (1, 2) for t in ("red", f"w{q}")]
    texts = J.texts_of(catalogue(spark, 3000), FIELDS)
    found = in_texts.scored(texts, wanted, in_texts.words([1.0, 0.4], J.TOKEN, frozenset()), 5)
    assert found.count() <= 3 * 2 * 3 * 5
    leg = J.keyword_or_texts(asked(spark, [r[1::2] for r in wanted]), catalogue(spark, 3000), FIELDS, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in leg and "Join" not in leg


def test_intent_hits_are_cut_before_a_shuffle(spark):
    items = catalogue(spark)
    terms = asked(spark, [(1, "red"), (1, "w3"), (2, "w3"), (2, "ed gre")])
    got = J.term_leg(terms, items, list(FIELDS), k=4)
    hit = {1: lambda r: True, 2: lambda r: r["item_id"] % 50 == 0 or "w3" in r["title"].split() + r["summary"].split()}
    want = set()
    for q, test in hit.items():
        best = sorted((r for r in items.collect() if test(r)), key=lambda r: (-r["quality"], r["item_id"]))[:4]
        want |= {(q, r["item_id"], i, 0.55) for i, r in enumerate(best, 1)}
    assert set(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortMergeJoin" not in plan


def test_grades_are_summed_where_the_text_is(spark):
    items = catalogue(spark)
    terms = asked(spark, [(1, "red"), (1, "gree"), (1, "w1"), (2, "w1"), (2, "")])
    fields = {"title": (F.lower("title"), 2), "body": (F.lower("summary"), 1)}
    want = {tuple(r) for r in J.top_k(E.graded_terms(items, terms, fields), 6, [F.desc("grade"), "item_id"]).collect()}
    few = E.graded_terms(items, terms, fields, 6)
    assert {tuple(r) for r in J.top_k(few, 6, [F.desc("grade"), "item_id"]).collect()} == want
    assert "Aggregate" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_leaders_keep_what_rounding_makes_equal():
    r = np.array([1000.0, 1000.2, 2.0, 1000.2])
    at = in_texts.leaders(np.zeros(4, np.int64), np.array([1, 2, 3, 4]), r, 1)
    assert set(at) == {0, 1}  # 1000.0 has the same rank as 1000.2 and a smaller id
    assert len(in_texts.leaders(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 3)) == 0


def test_sums_by_cells_and_by_keys(monkeypatch):
    groups = in_texts.Groups([(0, 1, 0, "a"), (0, 1, 0, "b"), (1, 1, 0, "a"), (1, 1, 0, "b"), (2, 7, 3, "a")])
    row, term, weight = np.array([0, 0, 2]), np.array([groups.terms.index(t) for t in "aba"]), np.array([1.0, 0.5, 2.0])
    wide = [c.tolist() for c in groups.sums(row, term, weight)]
    monkeypatch.setattr(in_texts, "DENSE_CELLS", -99)
    row = row + 10**6
    assert [[r - 10**6 for r in groups.sums(row, term, weight)[0].tolist()], *[c.tolist() for c in groups.sums(row, term, weight)[1:]]] == wide
    assert sorted(zip(wide[0], wide[1], wide[2])) == [(0, 0, 1.5), (0, 1, 1.5), (0, 2, 1.0), (2, 0, 2.0), (2, 2, 2.0)]


def test_first_words_are_those_of_the_whole_text(spark):
    texts = ["", " \t", " a b", "a b c d e f g h i", "\na  b c d e f\t", "  a b c d e f g h", "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    whole, first = (F.slice(X.words("text", n), 1, 6) for n in (None, 6))
    assert rows.filter(whole == first).count() == len(texts)
    assert rows.filter(F.size(X.words(F.concat("text", F.repeat(F.lit("x y "), 50)), 6)) > 8).isEmpty()


def test_results_join_found_items_only(spark, monkeypatch):
    """The items that a search found are chosen before any is shuffled, and the search is written once for both readers."""
    from millrace.plans import search_queries as Q

    ids = spark.createDataFrame([(1, 5), (2, 5), (2, 7)], "query_id bigint, item_id bigint")
    monkeypatch.setattr(Q, "search", lambda s, d: ids)
    rows = Q.results(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LogicalRDD" not in plan
    assert sorted((r["query_id"], r["item_id"]) for r in rows.collect()) == [(1, 5), (2, 5), (2, 7)]


def test_intent_hits_are_cut_in_the_task(spark, monkeypatch):
    """A task gives k items of each term, so frequent terms of many queries make no pairs of items and queries; nulls and NaN rank as in Spark."""
    rank = F.when(F.col("item_id") % 9 == 0, None).when(F.col("item_id") % 20 == 3, float("nan")).otherwise(F.col("quality"))
    items = catalogue(spark, 900).withColumn("quality", rank).persist()
    terms = asked(spark, [(q, "red") for q in range(30)] + [(1, "w3"), (2, "w10"), (3, ""), (4, None)])
    texts = items.select("item_id", F.concat_ws("\n", "title", "summary").alias("text"), F.array("title").alias("elements"), "quality")
    assert contains.best_holders(texts, ["red", "w3"], 4).count() <= 3 * 2 * 4
    few = J.term_leg(terms, items, list(FIELDS), k=4)
    monkeypatch.setattr(contains, "BROADCAST_TERMS", 1)  # all hits
    same(few, J.term_leg(terms, items, list(FIELDS), k=4))


def test_words_of_a_batch_are_those_of_the_pattern():
    """Words are found for a whole batch at once, not text by text."""
    import re

    import pyarrow as pa

    texts = ["c++ a.b 3d-print", "", "é12ab34cd -x .9 x", "x" * 9 + " c++ c++ ünder", "7", "c++"]
    known = ["c++", "a.b", "3d", "print", "12ab", "34cd", "x", "9", "7", "nder", "the"]
    for column in (pa.array(texts), pa.array(["c++", *texts, "x"]).slice(1, len(texts))):
        row, term, r = in_texts.words([0.4], J.TOKEN, frozenset(["the"]))(known)([column])
        want = {}
        for i, text in enumerate(texts):
            for word in re.findall(J.TOKEN, text):
                if word in known:
                    want[i, word] = want.get((i, word), 0.0) + 0.4
        assert {(i, known[t]): x for i, t, x in zip(row.tolist(), term.tolist(), r.tolist())} == want


def test_relevance_looks_for_the_values_of_all_queries_at_once(spark, monkeypatch):
    """A text is read once, not for each of its hits; the same numbers as by looking into the text for each value."""
    from millrace.operators import rank as R

    list_ = lambda *w: list(w)
    asks = [
        (1, list_("Red X", "W3"), list_("w3", None), list_("red"), None, list_("the", "GREEN", "nowhere"), list_("Model"), "rag_app"),
        (2, [], [], [], [], [], [], None),
        (3, None, list_("", "w1"), list_("blue"), list_("w5"), list_(*"abcdefghijklmnopqrstuvw"), [], next(iter(R.PROFILE_WORDS))),
    ]
    lists = "frameworks tools tags languages search_terms types".split()
    intents = spark.createDataFrame(asks, "query_id bigint, " + ", ".join(f"{c} array<string>" for c in lists) + ", project_type string")
    items = catalogue(spark, 60).withColumns({"use_case": F.lit("Red X"), "core": F.lit(None).cast("string"), "languages": F.array("title"), "artifact_type": F.lit("model")})

    def scores():
        found, says = R.with_held(R.with_blob(items), intents)
        rel = R.relevance(F.when(F.col("item_id") % 2 == 0, 0.1), F.when(F.col("item_id") % 3 == 0, 0.4), says)
        return found.crossJoin(R.asked(intents)).select("query_id", "item_id", F.bround(rel, 9).alias("r"))

    at_once = scores()
    assert "Contains(blob" not in at_once._jdf.queryExecution().optimizedPlan().toString() and "held_blob" in at_once._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(contains, "BROADCAST_TERMS", 1)  # text by text
    same(at_once, scores())
    assert at_once.filter("r > 0").count() > 60


def test_many_groups_are_scored_in_parts(spark, monkeypatch):
    """More rows of terms than go to all tasks at once are asked part by part where the texts are, so no postings of all items are made and joined."""
    items = catalogue(spark).persist()
    terms = asked(spark, [(q, t) for q in range(20) for t in (f"w{q % 11}", "red", "the")])
    fields = {"title": (F.lower("title"), 2)}
    want = J.keyword_or_texts(terms, items, FIELDS, 6).collect()
    best = {tuple(r) for r in J.top_k(E.graded_terms(items, terms, fields, 6), 6, [F.desc("grade"), "item_id"]).collect()}
    monkeypatch.setattr(contains, "BROADCAST_TERMS", 45)
    parts = in_texts.few(J.grouped(0, terms))
    rows = [r for p in parts for r in p]
    assert len(parts) > 1 and len(set(rows)) == len(rows) == terms.distinct().count()
    assert sum(len({r[1] for r in p}) for p in parts) == 20
    leg, cut = J.keyword_or_texts(terms, items, FIELDS, 6), E.graded_terms(items, terms, fields, 6)
    assert not {"Aggregate", "Join"} & set(re.findall(r"\w+", leg._jdf.queryExecution().optimizedPlan().toString()))
    assert sorted(map(tuple, leg.collect())) == sorted(map(tuple, want))
    assert {tuple(r) for r in J.top_k(cut, 6, [F.desc("grade"), "item_id"]).collect()} == best
    monkeypatch.setattr(in_texts, "PARTS", 1)
    assert in_texts.few(J.grouped(0, terms)) is None


def test_equal_sums_are_cut_to_k_items(monkeypatch):
    """Sums are of a few weights, so many are equal: of a group a task holds its k best only, and forms no pair below them."""
    group, item = np.repeat(np.arange(3), 50), np.tile(np.arange(50)[::-1], 3)
    at = in_texts.leaders(group, item, np.where(item % 2 == 0, 1.0, 2.0), 30)
    assert len(at) == 90 and all(sorted(item[at][group[at] == g].tolist()) == sorted([*range(0, 10, 2), *range(1, 50, 2)]) for g in range(3))
    groups = in_texts.Groups([(0, 1, 0, "a"), (0, 2, 0, "b"), (1, 1, 0, "a"), (1, 1, 0, "b")])
    row, term, weight = np.array([0, 1, 1, 2]), np.array([0, 0, 1, 1]), np.array([0.2, 1.0, 0.4, 0.1])
    kept = [c.tolist() for c in groups.sums(row, term, weight, np.array([0.5, 0.1]))]
    assert sorted(zip(*kept)) == [(1, 0, 1.0), (1, 1, 0.4), (1, 2, 1.4), (2, 1, 0.1)]
    monkeypatch.setattr(in_texts, "DENSE_CELLS", -99)
    assert sorted(zip(*[c.tolist() for c in groups.sums(row + 10**6, term, weight, np.array([0.5, 0.1]))])) == [(r + 10**6, g, x) for r, g, x in sorted(zip(*kept))]

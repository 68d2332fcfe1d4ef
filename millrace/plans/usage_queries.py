"""Usage, ingest, sets and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixtures as X
from millrace.fixtures import sql
from millrace.functions import scores as S
from millrace.functions import text as T
from millrace.operators import evaluate as E
from millrace.operators import filters as B
from millrace.operators import intent as I
from millrace.operators import learn as L
from millrace.operators import stats as D
from millrace.plans import search_queries as Q
from millrace.plans.registry import query
from millrace.sources import feeds, sinks
from millrace.sources.models import ModelStore
from millrace.sources.snapshots import SnapshotStore
from millrace.sources.tables import shared_folder
from millrace.streaming import jobs


def raw(s, d, table: str, *columns):
    return X.table(s, d, table).select(*columns)


@query("a3_map_code_repos")
def _(s, d):
    doc = F.struct(
        F.concat(F.lit("o/"), F.col("doc_id").cast("string")).alias("full_name"),
        F.concat(F.lit("https://github.com/o/"), F.col("doc_id").cast("string")).alias("html_url"),
        F.col("text").alias("description"),
        F.col("lang").alias("language"),
        F.lit("2024-01-02T03:04:05Z").alias("pushed_at"),
        F.col("doc_id").cast("int").alias("stargazers_count"),
        F.array("source", "lang").alias("topics"),
        F.col("text").alias("readme"),
    )
    return feeds.map_code_repos(raw(s, d, "documents", F.to_json(doc).alias("value"))).select("canonical_url", "title", "summary", F.array_join("tags", ",").alias("tags"), "stars", F.bround("popularity", 6).alias("popularity"), "published_at")


@query("a4_map_forum_posts", r"SELECT 'https://github.com/p/' || doc_id AS canonical_url, source AS title, least(100, doc_id % 50)::DOUBLE AS popularity, TIMESTAMP '2024-01-02 03:04:05' AS published_at FROM documents WHERE doc_id % 50 >= 3")
def _(s, d):
    post = F.struct(F.col("source").alias("title"), F.concat(F.lit("http://www.github.com/p/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x")).alias("url"), (F.col("doc_id") % 50).cast("int").alias("points"), F.lit("2024-01-02T03:04:05Z").alias("created_at"))
    return feeds.map_forum_posts(raw(s, d, "documents", F.to_json(post).alias("value"))).select("canonical_url", "title", "popularity", "published_at")


@query("a5_map_papers", r"""SELECT 'https://arxiv.org/abs/' || doc_id AS canonical_url, source AS title, t AS summary, c AS has_code, least(CASE WHEN c THEN 70.0::DOUBLE ELSE 45 END, CASE WHEN c THEN 20.0::DOUBLE ELSE 0 END + CASE WHEN length(t) >= 30 THEN 10 ELSE 0 END + CASE WHEN length(t) >= 20 THEN 5 ELSE 0 END) AS remix
  FROM (SELECT *, regexp_matches(lower(t), 'github\.com|code is available|open-source') AS c FROM (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[<>&]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), '^ ', ''), ' $', '') AS t FROM documents))""")
def _(s, d):
    entry = F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/"), F.col("doc_id").cast("string"), F.lit("</id><title>"), F.col("source"), F.lit("</title><summary>"), F.regexp_replace("text", "[<>&]", ""), F.lit("</summary><published>2024-01-02T03:04:05Z</published></entry></feed>"))
    return feeds.map_papers(raw(s, d, "documents", entry.alias("value"))).select("canonical_url", "title", "summary", "has_code", "remix")


@query("a6_map_feed_articles")
def _(s, d):
    item = F.concat(F.lit("<rss><channel><item><title>"), F.col("source"), F.lit("</title><link>https://b.example.org/"), F.col("doc_id").cast("string"), F.lit("</link><description>"), F.regexp_replace(F.col("text"), "[<>&]", ""), F.lit("</description><pubDate>Tue, 2 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>"))
    return feeds.map_feed_articles(raw(s, d, "documents", item.alias("value")))


@query("a7_map_models", "SELECT 'https://models.example.org/' || source || '/' || doc_id AS canonical_url, round_even(least(100.0::DOUBLE, 10 * log10(n_chars + 1)), 6) AS popularity FROM documents")
def _(s, d):
    m = F.struct(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("id"), F.col("n_chars").alias("downloads"), F.lit("summarization").alias("pipeline_tag"), F.array("lang").alias("tags"))
    return feeds.map_models(raw(s, d, "documents", F.to_json(m).alias("value"))).select("canonical_url", F.bround("popularity", 6).alias("popularity"))


def upsert_input(s, d):
    """A table and a batch with changed, new and keyless rows."""
    stamp = F.lit("2024-01-05 00:00:00").cast("timestamp")
    old = lambda u: (F.concat(F.lit("slug-"), F.col("item_id").cast("string")).alias("slug"), *[u.alias(c) for c in ("created_at", "updated_at", "last_crawled_at")])
    items = X.items(s, d).select("item_id", F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("canonical_url"), "summary", "source_type")
    top = items.agg(F.max("item_id").alias("top"))
    changed = items.filter("item_id % 3 = 0").select((F.col("item_id") + 10).alias("item_id"), "canonical_url", F.concat("summary", F.lit(" (new)")).alias("summary"), "source_type")
    fresh = items.filter("item_id % 20 = 7").join(F.broadcast(top)).select((F.col("item_id") + F.col("top") + 1).alias("item_id"), F.concat(F.lit("n"), F.col("item_id").cast("string")).alias("canonical_url"), "summary", "source_type")
    none = items.filter("item_id % 100 = 5").select("item_id", F.lit(None).cast("string").alias("canonical_url"), "summary", "source_type")
    batch = changed.unionByName(fresh).unionByName(none).withColumn("slug", F.concat(F.lit("other-"), F.col("item_id").cast("string")))
    return items.select("*", *old(stamp)), batch


def upserted(s, d):
    return sinks.upsert_items(*upsert_input(s, d), keep_if_null=(), as_of=F.lit(X.AS_OF).cast("timestamp"))


UP = """up AS (SELECT item_id, 'u' || item_id AS canonical_url, CASE WHEN c THEN summary || ' (new)' ELSE summary END AS summary, source_type, 'slug-' || item_id AS slug, TIMESTAMP '2024-01-05' AS created_at, CASE WHEN c THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-05' END AS updated_at,
    CASE WHEN c THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-05' END AS last_crawled_at, CASE WHEN c THEN 'updated' ELSE 'kept' END AS status FROM (SELECT *, item_id % 3 = 0 AS c FROM items)
  UNION ALL SELECT id, 'n' || item_id, summary, source_type, 'other-' || id, TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-01', NULL, 'inserted' FROM (SELECT *, item_id + (SELECT max(item_id) FROM items) + 1 AS id FROM items WHERE item_id % 20 = 7))"""


@query("a8_upsert_items", sql("items", "SELECT * FROM up", UP))
def _(s, d):
    return upserted(s, d)


@query("a8b_upsert_snapshot", sql("items", "SELECT * FROM up", UP))
def _(s, d):
    table, batch = upsert_input(s, d)
    store = SnapshotStore.create(table, shared_folder(s, "snapshot"), buckets=16)
    store.upsert(batch, 1, keep_if_null=(), as_of=F.lit(X.AS_OF).cast("timestamp"))
    return store.changes()


@query("a9_provenance", sql("items", "SELECT item_id, source_type AS source FROM up WHERE status = 'inserted'", UP))
def _(s, d):
    return sinks.provenance(upserted(s, d))


@query("a10_run_ledger", sql("items", """SELECT source_type, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, coalesce(found, 0) AS found, coalesce(found, 0) AS changed, coalesce(inserted, 0) AS inserted, error
  FROM (SELECT source_type, count(*) AS found, count(*) FILTER (status = 'inserted') AS inserted FROM up WHERE status <> 'kept' GROUP BY source_type) FULL JOIN (SELECT DISTINCT source_type || CASE source_type WHEN 'src4' THEN '-b' ELSE '' END AS source_type, 'timeout' AS error FROM items WHERE source_type IN ('src2', 'src4')) USING (source_type)""", UP))
def _(s, d):
    failed = X.items(s, d).filter("source_type IN ('src2', 'src4')").select(F.when(F.col("source_type") == "src4", "src4-b").otherwise(F.col("source_type")).alias("source_type"), F.lit("timeout").alias("error"))
    return sinks.ledger_row(upserted(s, d), failed)


@query("a11_export_top", sql("items", "SELECT item_id, quality, remix FROM items WHERE quality >= 50 ORDER BY quality DESC, remix DESC, item_id LIMIT 40"))
def _(s, d):
    return sinks.export_top(X.items(s, d), 40, 50).select("item_id", "quality", "remix")


@query("a12_log_events", sql("items query_terms", "SELECT query_id, array_to_string(list(rank - 1 || ':' || item_id ORDER BY rank), ',') AS impression FROM kw WHERE rank <= 20 GROUP BY query_id", Q.POSTS, Q.KW))
def _(s, d):
    logged = sinks.log_impressions(Q.kw_leg(s, d))
    return logged.select("query_id", F.array_join(F.transform("impression", lambda p: F.concat(p["pos"].cast("string"), F.lit(":"), p["id"].cast("string"))), ",").alias("impression"))


@query("a12b_log_actions", sql("usage", "SELECT event_id, kind, item_id FROM usage WHERE kind <> 'search'"))
def _(s, d):
    return sinks.log_actions(X.usage(s, d)).select("event_id", "kind", "item_id")


@query("a14_purge", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(s, d):
    bad = raw(s, d, "customer", F.col("c_custkey").alias("o_custkey"), "c_acctbal").filter("c_acctbal < 0")
    return sinks.purge(raw(s, d, "orders", "o_orderkey", "o_custkey"), bad, "o_custkey")


@query("a15_apply_stars", "SELECT DISTINCT o_custkey AS user_id, o_orderkey % 50 AS item_id FROM orders WHERE NOT (o_custkey % 5 = 0 AND o_orderkey % 50 < 10)")
def _(s, d):
    stars = raw(s, d, "orders", F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("item_id"))
    return sinks.apply_stars(stars.filter("user_id % 2 = 0"), stars, stars.filter("user_id % 5 = 0 AND item_id < 10").distinct())


@query("a15b_credibility", "SELECT c_custkey AS user_id, round(c_acctbal + count(o_orderkey), 4) AS credibility FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal")
def _(s, d):
    out = sinks.credibility(raw(s, d, "customer", F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("credibility")), raw(s, d, "orders", F.col("o_custkey").alias("user_id")))
    return out.select("user_id", F.round("credibility", 4).alias("credibility"))


@query("a16_seed_defaults", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT n_nationkey FROM nation)")
def _(s, d):
    have = raw(s, d, "nation", F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("v"))
    return sinks.seed_defaults(have, raw(s, d, "part", F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), "k")


PROP = """rates AS (SELECT position, shown, coalesce(clicks, 0) AS clicks, coalesce(clicks, 0)::DOUBLE / shown AS ctr FROM (SELECT pos::BIGINT AS position, count(*) AS shown FROM impressions GROUP BY pos)
  LEFT JOIN (SELECT position, count(*) AS clicks FROM usage WHERE kind <> 'search' GROUP BY position) USING (position)),
prop AS (SELECT position, shown, clicks, round_even(ctr, 6) AS ctr, round_even(CASE WHEN ctr = 0 THEN 1.0 ELSE ctr / coalesce(nullif((SELECT ctr FROM rates WHERE position = 0), 0), nullif((SELECT max(ctr) FROM rates), 0), 1.0) END, 6) AS propensity FROM rates)"""


def propensity(s, d):
    return L.click_propensity(X.impressions(s, d), X.usage(s, d).filter("kind <> 'search'"))


def clicked(s, d):
    return X.usage(s, d).filter("kind <> 'search'").select("query_id", "item_id", "kind", "position")


@query("d7_click_propensity", sql("usage impressions", "SELECT position, shown, clicks, ctr, propensity FROM prop", PROP))
def _(s, d):
    return propensity(s, d)


PAIRS = "pairs AS (SELECT query_id, item_id, kind, round_even(max(least(5.0, 1.0::DOUBLE / greatest(coalesce(propensity, 1.0), 0.001)) * CASE kind WHEN 'star' THEN 2 ELSE 1 END), 3) AS weight FROM usage LEFT JOIN prop USING (position) WHERE kind <> 'search' GROUP BY query_id, item_id, kind)"


@query("d8_pair_weights", sql("usage impressions", "SELECT query_id, item_id, kind, weight FROM pairs", PROP, PAIRS))
def _(s, d):
    return L.pair_weights(clicked(s, d), propensity(s, d))


@query("k9_harvest_pairs", sql("usage impressions", "SELECT query_id, count(*) AS n, round_even(sum(weight), 6) AS weight FROM pairs GROUP BY query_id", PROP, PAIRS))
def _(s, d):
    return L.pair_weights(clicked(s, d), propensity(s, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.bround(F.sum("weight"), 6).alias("weight"))


def query_log(s, d):
    """Each user turn twice, as on a second visit, so that it counts as asked often."""
    turns = X.table(s, d, "conversations").filter("role = 'user'").select(F.concat(F.lit(" "), F.col("text")).alias("query"))
    return turns.union(turns)


def curated(s, d):
    return X.table(s, d, "conversations").filter("role = 'user' AND conv_id % 3 = 0").select(F.lower("text").alias("query"))


FREQ = r"""freq AS (SELECT query, 2 * count(*) AS n FROM (SELECT trim(' ' || text, ' ') AS query FROM conversations WHERE role = 'user') WHERE query <> '' GROUP BY query),
fresh AS (SELECT query, n FROM freq WHERE lower(query) NOT IN (SELECT lower(trim(text, ' ')) FROM conversations WHERE role = 'user' AND conv_id % 3 = 0))"""


@query("d9_frequent_queries", sql("", "WITH " + FREQ + " SELECT query, n FROM fresh"))
def _(s, d):
    return L.frequent_queries(query_log(s, d), curated(s, d))


@query("c7_new_queries", sql("", "WITH " + FREQ + " SELECT count(*) AS n, sum(n)::BIGINT AS asked FROM fresh"))
def _(s, d):
    return L.frequent_queries(query_log(s, d), curated(s, d)).agg(F.count("*").alias("n"), F.sum("n").alias("asked"))


HARVEST = "queries AS (SELECT row_number() OVER (ORDER BY query) AS query_id, query, n FROM fresh)"
DERIVED = """six AS (SELECT query_id, array_to_string(list(val ORDER BY o)[1:6], ' ') AS terms FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(val) ORDER BY o) AS r FROM (
  SELECT query_id, ord::DOUBLE AS o, val FROM words1 UNION ALL SELECT query_id, CASE kind WHEN 'tools' THEN 40000 WHEN 'frameworks' THEN 50000 ELSE 60000 END + ord / 1000000, lower(val) FROM listed1 WHERE kind IN ('tools', 'frameworks', 'tags') AND length(val) >= 3)) WHERE r = 1 GROUP BY query_id)"""


@query("k8_harvest_queries", sql("", "WITH " + ", ".join((FREQ, HARVEST, I.intent_sql(), DERIVED)) + " SELECT query, n, terms FROM queries JOIN six USING (query_id) WHERE contains(terms, ' ')"))
def _(s, d):
    return L.harvest_queries(query_log(s, d), curated(s, d)).select("query", "n", F.array_join("terms", " ").alias("terms"))


@query("h35_derived_terms", sql("queries", "SELECT query_id, coalesce(terms, '') AS terms FROM queries LEFT JOIN six USING (query_id)", I.intent_sql(), DERIVED))
def _(s, d):
    return I.derived_terms(I.extract_intent(X.queries(s, d))).select("query_id", F.array_join("terms", " ").alias("terms"))


FB = "fb AS (SELECT query_id, item_id, max(CASE kind WHEN 'star' THEN 3 ELSE 2 END)::BIGINT AS grade FROM usage WHERE kind <> 'search' GROUP BY query_id, item_id)"


@query("c8_feedback_grades", sql("usage", "SELECT query_id, item_id, grade FROM fb", FB))
def _(s, d):
    return L.feedback_grades(clicked(s, d))


@query("k1b_overlay", sql("items query_terms usage", "SELECT query_id, item_id, max(grade) AS grade FROM (SELECT * FROM qrels UNION ALL SELECT * FROM fb) GROUP BY query_id, item_id", Q.QRELS, FB))
def _(s, d):
    return E.oracle_qrels(X.items(s, d), X.query_terms(s, d), feedback=L.feedback_grades(clicked(s, d)))


@query("c9_profile_stars", "SELECT c_name AS username, count(o_orderkey) AS n_stars FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name")
def _(s, d):
    stars = raw(s, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return raw(s, d, "customer", "c_custkey", "c_name").join(stars, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_name").alias("username"), F.coalesce("n", F.lit(0)).alias("n_stars"))


@query("c10_click_coverage", sql("items query_terms usage", "SELECT count(*) AS n_pairs, count(*) FILTER (coalesce(grade, 0) > 0) AS covered, count(*) FILTER (coalesce(grade, 0) <= 0) AS missed FROM (SELECT DISTINCT query_id, item_id FROM usage WHERE kind <> 'search') LEFT JOIN qrels USING (query_id, item_id)", Q.QRELS))
def _(s, d):
    return E.click_coverage(clicked(s, d), Q.qrels_of(s, d))


@query("g2_merge_pairs", sql("usage", """SELECT query, item_id, CASE WHEN min(p) = 0 THEN 'feedback' ELSE 'oracle' END AS origin FROM (SELECT 'q' || query_id AS query, item_id, 0 AS p FROM usage WHERE kind = 'click'
  UNION ALL SELECT 'q' || user_id, item_id, 1 FROM usage WHERE kind = 'star') GROUP BY query, item_id"""))
def _(s, d):
    u = X.usage(s, d)
    named = lambda k, prefix: u.filter(F.col("kind") == k).select(F.concat(F.lit(prefix), F.col("query_id").cast("string")).alias("query"), "item_id")
    return L.merge_pairs(named("click", "Q"), named("star", "q"))


@query("g3_merge_queries", sql("queries", "SELECT query_id AS no, query FROM queries WHERE query_id < 20 UNION ALL SELECT 19 + row_number() OVER (ORDER BY query), query FROM queries WHERE query_id >= 20"))
def _(s, d):
    q = X.queries(s, d)
    return L.merge_queries(q.filter("query_id < 20").select(F.col("query_id").alias("no"), "query"), q.select("query"))


def rotated(s, d):
    """Lists by source, every third id left out, and offsets of all but one source."""
    rows = X.items(s, d).filter("item_id % 3 <> 1").select("source_type", "item_id")
    offsets = rows.groupBy("source_type").agg((F.max("item_id") % 97 + 90).alias("offset")).filter("source_type <> 'src2'")
    return B.rotate(rows, offsets, 12)


ROTATED = """lists AS (SELECT source_type, item_id, row_number() OVER (PARTITION BY source_type ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY source_type) AS n FROM items WHERE item_id % 3 <> 1),
offsets AS (SELECT source_type, n, CASE WHEN source_type <> 'src2' THEN max(item_id) % 97 + 90 ELSE 0 END % n AS start FROM lists GROUP BY source_type, n)"""


@query("e9_window_rotation", sql("items", "SELECT source_type, item_id FROM lists JOIN offsets o USING (source_type) WHERE (place - start + o.n) % o.n < least(12, o.n)", ROTATED))
def _(s, d):
    return rotated(s, d)[0]


@query("e9b_next_offsets", sql("items", "SELECT source_type, (start + least(12, n)) % n AS offset FROM offsets", ROTATED))
def _(s, d):
    return rotated(s, d)[1]


_MORE = ", ".join(f"('{t}', {list(w)})" for t, w in I.SYNONYMS.items())


@query("h30_expand_terms", f"""SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]), ' ') AS terms FROM (SELECT doc_id, flatten([[lang, lower(source)], [t], coalesce(w, []), ['repo']]) AS v
  FROM (SELECT doc_id, lang, source, ['llm', 'mcp', 'rag', 'k8s', 'stt', 'tts', 'ci', 'cd', 'vlm', 'gnn', 'ssg', 'none'][doc_id % 12 + 1] AS t FROM documents) LEFT JOIN (VALUES {_MORE}) m(t, w) USING (t))""")
def _(s, d):
    known = F.element_at(F.array(*map(F.lit, (*I.SYNONYMS, "none"))), (F.col("doc_id") % 12 + 1).cast("int"))
    terms = F.array("lang", "source", F.upper(known), F.lit(" Repo"))
    return X.table(s, d, "documents").select("doc_id", F.array_join(I.expand_terms(terms), " ").alias("terms"))


@query("h33_decode_impressions", sql("usage impressions", "SELECT event_id, pos, item_id FROM impressions"))
def _(s, d):
    shown = X.impressions(s, d).groupBy("event_id").agg(F.to_json(F.collect_list(F.struct("pos", F.col("item_id").alias("id")))).alias("j"))
    return shown.select("event_id", F.explode(F.from_json("j", "array<struct<id:bigint,pos:int>>")).alias("p")).select("event_id", "p.pos", F.col("p.id").alias("item_id"))


_SHOWN = ("frameworks", "tools", "languages", "apis", "models", "tags", "types")
_JOINED = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in _SHOWN)


def joined(rows, *more):
    return rows.select("query_id", *more, *[F.array_join(c, "|").alias(c) for c in _SHOWN])


@query("i9_extract_intent", sql("queries", f"SELECT query_id, {_JOINED} FROM intents0", I.intent_sql()))
def _(s, d):
    return joined(I.extract_intent(X.queries(s, d)))


@query("i11_enrich_intent", sql("queries", f"SELECT query_id, project_type, array_to_string(search_terms, '|') AS terms, {_JOINED} FROM intents", I.intent_sql()))
def _(s, d):
    return joined(Q.intents(s, d), "project_type", F.array_join("search_terms", "|").alias("terms"))


_LINE = lambda label, c: f"CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}, ', ') || '.' END"


@query("i12_retrieval_context", sql("queries", f"""SELECT query_id, concat_ws(chr(10), trim(query), 'Search for builders: projects, techniques, templates, servers and papers.', 'Project focus: ' || replace(project_type, '_', ' ') || '.', {_LINE('Frameworks', 'frameworks')}, {_LINE('Tools', 'tools')}, {_LINE('Languages', 'languages')}, {_LINE('Topics', 'tags')}, {_LINE('Models', 'models')},
  {_LINE('Looking for', "list_transform(types[1:6], lambda t: replace(t, '_', ' '))")}) AS context FROM intents""", I.intent_sql()))
def _(s, d):
    return I.retrieval_context(Q.intents(s, d))


@query("h37_intent_terms", sql("queries", "SELECT query_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i)[1:12], lambda i: v[i]), ' ') AS terms FROM (SELECT query_id, list_filter(list_transform(list_concat(list_concat(tags, tools), search_terms), lambda t: lower(t)), lambda t: length(t) >= 3) AS v FROM intents)", I.intent_sql()))
def _(s, d):
    return Q.intents(s, d).select("query_id", F.array_join(I.intent_terms(), " ").alias("terms"))


@query("i8_infer_fields")
def _(s, d):
    return I.infer_fields(X.table(s, d, "documents"), "doc_id", "text")


@query("i16_suggest_query")
def _(s, d):
    found = Q.written(s, Q.results(s, d))
    asked = Q.intents(s, d)
    return I.suggest_query(found, asked, Q.R.query_confidence(found, asked))


@query("k11_refresh_guard")
def _(s, d):
    # written, as the guard reads the metrics of both runs several times, and both the grades
    qrels, queries = Q.written(s, Q.qrels_of(s, d)), X.queries(s, d)
    before, after = (Q.written(s, E.metrics(run, qrels, queries)) for run in (Q.kw_leg(s, d).select("query_id", "item_id", "rank"), Q.fused_run(s, d)))
    return L.refresh_guard(before, after, "v2")


@query("k11b_model_refresh")
def _(s, d):
    """The learned ranker against the blend: put in use, judged by the guard, and rolled back where it has a reason."""
    rows, qrels = Q.written(s, L.ltr_features(Q.hits(s, d), Q.now())), Q.written(s, Q.qrels_of(s, d))
    judged = lambda model: E.metrics(L.apply_ranker(rows, model or {}).select("query_id", "item_id", "rank"), qrels, X.queries(s, d))
    store = ModelStore(s, shared_folder(s, "models"))
    store.adopt(store.put({}))
    store.refresh(lambda: L.train_ranker(rows, qrels), judged, E.regression_guard)
    return store.history()


@query("s3_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return jobs.windowed_counts(X.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("s4_click_through", sql("usage impressions", "SELECT i.query_id, i.item_id, i.pos, i.ts AS shown_at, c.ts AS clicked_at FROM impressions i JOIN usage c ON c.kind = 'click' AND c.query_id = i.query_id AND c.item_id = i.item_id AND c.ts >= i.ts AND c.ts <= i.ts + INTERVAL 6 HOUR"))
def _(s, d):
    return jobs.click_through(X.impressions(s, d), X.usage(s, d).filter("kind = 'click'"))


def clicked_impressions(s, d):
    """Impressions, and clicks on some of them up to 400 minutes later."""
    shown = X.impressions(s, d)
    clicks = shown.filter("pos = event_id % 20 AND event_id % 3 = 0").select("query_id", "item_id", (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 400).cast("int"))).alias("ts"))
    return shown, clicks


@query("s4b_click_rates", sql("usage impressions", """SELECT time_bucket(INTERVAL 1 DAY, shown_at) AS start, pos, sum(shown)::BIGINT AS shown, sum(clicked)::BIGINT AS clicks, round_even(sum(clicked) / sum(shown)::DOUBLE, 6) AS ctr FROM (
  SELECT ts AS shown_at, pos, 1 AS shown, 0 AS clicked FROM impressions UNION ALL SELECT i.ts, i.pos, 0, 1 FROM impressions i JOIN
  (SELECT query_id, item_id, ts + to_minutes(event_id % 400) AS ts FROM impressions WHERE pos = event_id % 20 AND event_id % 3 = 0) c ON c.query_id = i.query_id AND c.item_id = i.item_id AND c.ts >= i.ts AND c.ts <= i.ts + INTERVAL 6 HOUR) GROUP BY 1, 2"""))
def _(s, d):
    return jobs.click_rates(*clicked_impressions(s, d))


def streamed(s, d, make):
    """A stream over the events table, run to its end into the shared folder and read back."""
    base = shared_folder(s, "stream")
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = make(events)
    jobs.run_to_end(out, f"{base}/out", f"{base}/check")
    return s.read.schema(out.schema).parquet(f"{base}/out")


def post():
    """An event as the payload of a forum post."""
    user = F.col("user_id").cast("string")
    return F.struct(
        F.col("event_id").cast("string").alias("objectID"),
        F.concat(F.lit("post of "), user).alias("title"),
        F.concat(F.lit("http://www.example.org/u/"), user, F.lit("/?utm_source=x")).alias("url"),
        (F.col("event_id") % 10).cast("int").alias("points"),
        F.lit("2024-01-02T03:04:05Z").alias("created_at"),
    )


def ingested(s, d):
    """Events streamed as forum posts into a new store: the store, and the ledger of its batches."""
    base = shared_folder(s, "ingest")
    schema = s.read.parquet(f"{d}/events.parquet").schema
    posts = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(F.to_json(post()).alias("value"))
    mapper = lambda batch: feeds.map_forum_posts(batch).withColumn("item_id", F.xxhash64("canonical_url"))
    store = SnapshotStore.create(mapper(s.createDataFrame([], "value string")), f"{base}/store", buckets=16)
    return store, jobs.ingest(posts, mapper, store, f"{base}/check", gate=~F.endswith("title", F.lit("7")))


@query("s1_stream_ingest", "SELECT DISTINCT 'https://www.example.org/u/'.replace('www.', '') || user_id AS canonical_url, 'post of ' || user_id AS title FROM events WHERE event_id % 10 >= 3 AND user_id % 10 <> 7")
def _(s, d):
    return ingested(s, d)[0].read().select("canonical_url", "title")


@query("s1b_stream_counts")
def _(s, d):
    return streamed(s, d, lambda e: jobs.windowed_counts(e))


@query("s2_stream_dedupe")
def _(s, d):
    return streamed(s, d, lambda e: jobs.first_seen(e.select("ts", "user_id", "event_type"), ["user_id", "event_type"]))


@query("s5_outcome_counters", "SELECT count(*) AS seen, 0::BIGINT AS skipped, count(*) FILTER (user_id % 10 = 7) AS gated, count(DISTINCT user_id) FILTER (user_id % 10 <> 7) AS inserted, 0::BIGINT AS updated FROM events WHERE event_id % 10 >= 3")
def _(s, d):
    return ingested(s, d)[1].agg(*[F.sum(c).alias(c) for c in ("seen", "skipped", "gated", "inserted", "updated")])



@query("h25_rule_lines", sql("items", """SELECT item_id, CASE WHEN contains(t, 'hackathon') THEN 'For a demo at a hackathon.' WHEN artifact_type = 'mcp_server' THEN 'For wiring tools into an agent.' WHEN artifact_type = 'starter_template' THEN 'For starting from a forkable template.'
  WHEN contains(t, 'extension') OR contains(t, 'chrome') THEN 'For browser extensions.' WHEN contains(t, 'lecture') OR contains(t, 'video') OR contains(t, 'transcri') OR contains(t, 'whisper') THEN 'For transcripts, summaries and study tools.'
  WHEN contains(t, 'rag') OR contains(t, 'retrieval') THEN 'For search and answers over documents.' ELSE 'For a remixable starting point.' END AS use_case,
  CASE WHEN len(commands) > 0 THEN 'Run the commands, then swap the parts.' ELSE 'Copy the modules that you need.' END AS how_to_remix FROM (SELECT *, lower(title || ' ' || summary) AS t FROM items)"""))
def _(s, d):
    text = F.concat_ws(" ", "title", "summary")
    return X.items(s, d).select("item_id", S.use_case_line(text, F.col("artifact_type")).alias("use_case"), S.remix_line(F.col("commands"), F.col("summary")).alias("how_to_remix"))

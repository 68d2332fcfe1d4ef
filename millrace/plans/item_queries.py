"""Filters, facets, text functions and scores over the item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixtures as X
from millrace.fixtures import sql
from millrace.functions import scores as S
from millrace.functions import text as T
from millrace.operators import evaluate as E
from millrace.operators import filters as B
from millrace.operators import stats as D
from millrace.plans.registry import query
from millrace.sources import tables



def now():
    return F.to_timestamp(F.lit(X.AS_OF))

ST = r"regexp_replace(regexp_replace({0}, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')"


def st(c: str) -> str:
    return ST.format(c)


@query("a1_read_items", "SELECT doc_id, lang, n_chars FROM documents")
def _(s, d):
    return tables.read_items(s, f"{d}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("a2_get_item", sql("items", "SELECT item_id, title FROM items WHERE item_id = 17"))
def _(s, d):
    return tables.get_item(X.items(s, d), 17).select("item_id", "title")


@query("b1_facet_membership", sql("items", "SELECT item_id, title FROM items WHERE (list_contains(tags, 'fr') OR list_contains(tags, 'de')) AND list_contains(tools, 'src3')"))
def _(s, d):
    return B.facets(X.items(s, d), {"tags": ["fr", "de"], "tools": ["src3"]}).select("item_id", "title")


@query("b2_equality_facets", sql("items", "SELECT item_id FROM items WHERE source_type = 'src2' AND artifact_type = 'model'"))
def _(s, d):
    return B.equals(X.items(s, d), source_type="src2", artifact_type="model").select("item_id")


@query("b3_range_facets", sql("items", "SELECT item_id, quality, hype FROM items WHERE quality >= 60 AND hype <= 40"))
def _(s, d):
    return B.ranges(X.items(s, d), min_quality=60, max_hype=40).select("item_id", "quality", "hype")


@query("b4_element_match", sql("items", "SELECT item_id FROM items WHERE len(list_filter(list_concat(list_concat(tags, tools), frameworks), lambda x: lower(x) = 'of' OR lower(x) = 'src7')) > 0"))
def _(s, d):
    return X.items(s, d).filter(B.any_element("Of", "tags", "tools", "frameworks") | B.any_element("SRC7", "tags", "tools", "frameworks")).select("item_id")


@query("b5_substring_match", sql("items", "SELECT item_id FROM items WHERE contains(lower(title), 'the%') OR contains(lower(title), 'ouer') OR contains(lower(summary), 'the%') OR contains(lower(summary), 'ouer')"))
def _(s, d):
    return X.items(s, d).filter(B.any_substring(["the%", "Ouer"], "title", "summary")).select("item_id")


NOISE = " OR ".join(f"contains(lower(title), '{w}')" for w in B.NOISE_TITLES)
#: Every eleventh title gets a word of the noise table, so that all of them are met.
NOISY = f"CASE WHEN item_id % 11 = 0 THEN title || ' ' || {list(B.NOISE_TITLES)}[item_id % {len(B.NOISE_TITLES)} + 1] ELSE title END"


@query(
    "b6_heuristic_gate",
    sql("items", f"""SELECT item_id, length(trim(title || ' ' || summary || ' ' || use_case || ' ' || core)) >= 60 AND NOT ({NOISE})
    AND (len(frameworks) > 0 OR len(tools) > 0 OR len(languages) > 0 OR len(tags) > 0 OR has_code) AS passed FROM (SELECT * REPLACE ({NOISY} AS title) FROM items)"""),
)
def _(s, d):
    word = F.element_at(F.array(*map(F.lit, B.NOISE_TITLES)), (F.col("item_id") % len(B.NOISE_TITLES) + 1).cast("int"))
    noisy = X.items(s, d).withColumn("title", F.when(F.col("item_id") % 11 == 0, F.concat("title", F.lit(" "), word)).otherwise(F.col("title")))
    return noisy.select("item_id", B.heuristic_gate(("title", "summary", "use_case", "core")).alias("passed"))


COS = "(list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE)) / (sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({1}, lambda x: x::DOUBLE * x::DOUBLE)))))"


@query(
    "b7_semantic_gate",
    sql("items query_vectors item_vectors", f"""SELECT query_id, item_id, similarity FROM (SELECT c.query_id, item_id, CASE WHEN query_vector IS NULL OR embedding IS NULL THEN 0.0::DOUBLE ELSE round_even({COS.format('query_vector', 'embedding')}, 6) END AS similarity, query_vector IS NULL OR embedding IS NULL AS unknown
    FROM (SELECT item_id, item_id % 7 AS query_id, CASE WHEN item_id % 13 <> 0 THEN embedding END AS embedding FROM items LEFT JOIN embeddings ON vec_id = item_id) c LEFT JOIN (SELECT query_id, CASE WHEN query_id <> 3 THEN query_vector END AS query_vector FROM query_vectors) q ON q.query_id = c.query_id)
    WHERE unknown OR similarity >= 0.22
    UNION ALL SELECT query_id, item_id, similarity FROM (SELECT query_id, item_id, round_even({COS.format('query_vector', 'embedding')}, 6) AS similarity FROM query_vectors, item_vectors WHERE query_id <> item_id % 7) WHERE similarity >= 0.22"""),
)
def _(s, d):
    # each item is a candidate of the query item_id % 7, some of them without a vector on one side; all other pairs of vectors are judged too
    found = X.items(s, d, embedding=True).select("item_id", (F.col("item_id") % 7).alias("query_id"), F.when(F.col("item_id") % 13 != 0, F.col("embedding")).alias("embedding"))
    gated = B.semantic_gate(found, X.query_vectors(s, d).withColumn("query_vector", F.when(F.col("query_id") != 3, F.col("query_vector"))))
    rest = B.near_pairs(X.query_vectors(s, d), X.items(s, d, embedding=True).select("item_id", "embedding"))
    return gated.union(rest.filter(F.col("query_id") != F.col("item_id") % 7))


@query("b8_prefilter", sql("items", "SELECT item_id FROM items WHERE NOT has_paper AND NOT (coalesce(stars, 0) < 900 AND length(summary) < 100)"))
def _(s, d):
    return B.prefilter(X.items(s, d), drop_flags=["has_paper"], min_stars=900, min_summary=100).select("item_id")


@query("b9_min_points", sql("items", "SELECT item_id, coalesce(stars, 0) AS stars FROM items WHERE coalesce(stars, 0) >= 3 AND title <> ''"))
def _(s, d):
    return B.min_points(X.items(s, d), "stars", 3, required=["title"]).select("item_id", F.coalesce("stars", F.lit(0)).alias("stars"))


@query(
    "b11_moderate",
    sql("items", """SELECT item_id, CASE WHEN quality >= 70 AND hype <= 45 THEN 'approved' ELSE 'rejected' END AS status,
    concat_ws('; ', CASE WHEN quality < 70 THEN 'quality ' || quality::BIGINT || ' below 70' END, CASE WHEN hype > 45 THEN 'hype risk ' || hype::BIGINT || ' above 45' END) AS reasons FROM items"""),
)
def _(s, d):
    status, reasons = S.moderation(F.col("quality"), F.col("hype"))
    return X.items(s, d).select("item_id", status.alias("status"), reasons.alias("reasons"))


@query("b12_projection", sql("items", "SELECT item_id, title, summary, array_to_string(tags, ',') AS tags, coalesce(license, '') AS license, has_code FROM items"))
def _(s, d):
    return B.public_row(X.items(s, d), license="").select("item_id", "title", "summary", F.array_join("tags", ",").alias("tags"), "license", "has_code")


@query("b13_first_occurrence", sql("item_urls", "SELECT source_url, min(item_id) AS item_id FROM item_urls GROUP BY source_url"))
def _(s, d):
    return B.first_by_key(X.items(s, d, url=True), ["source_url"], ["item_id"]).select("source_url", "item_id")


@query("d1_index_stats", sql("items item_vectors", """SELECT count(*) AS n_items, (SELECT count(*) FROM item_vectors) AS n_vectors, max(published_at) AS newest,
    count(*) FILTER (published_at > TIMESTAMP '2024-02-01' - INTERVAL 30 DAY) AS recent, count(*) < 40 AS sparse FROM items"""))
def _(s, d):
    return D.index_stats(X.items(s, d, embedding=True), now(), days=30)


@query("d2_last_finish", sql("ledger", "SELECT source_type, max(finished_at) AS last_finish FROM ledger WHERE status = 'done' GROUP BY source_type"))
def _(s, d):
    return D.last_finish(X.run_ledger(s, d))


@query("d3_page_and_total", sql("items", "SELECT item_id, quality, (SELECT count(*) FROM items WHERE quality >= 10) AS total FROM items WHERE quality >= 10 ORDER BY quality DESC, item_id LIMIT 25 OFFSET 50"))
def _(s, d):
    return D.page(X.items(s, d).filter("quality >= 10").select("item_id", "quality"), [F.desc("quality"), F.asc("item_id")], 25, 50)


@query("d4_run_state", sql("ledger", """SELECT source_type, count(*) FILTER (status = 'running' AND finished_at > TIMESTAMP '2024-02-01' - INTERVAL 72 HOUR) > 0 AS running,
    CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(finished_at) FILTER (status = 'done'))) / 60000000) AS BIGINT) AS minutes_since FROM ledger GROUP BY source_type"""))
def _(s, d):
    return D.run_state(X.run_ledger(s, d), now(), hours=72)


@query("d5_theme_counts", sql("items", f"SELECT theme, count(*) AS n, min(ord)::INTEGER AS ord FROM (SELECT {D.theme_sql()} AS theme, {D.theme_sql(place=True)} AS ord FROM items) GROUP BY theme"))
def _(s, d):
    return D.theme_counts(X.items(s, d))


@query("d20_outcome_counters", sql("ledger", "SELECT source_type, status AS outcome, count(*) AS n, sum(found)::BIGINT AS found FROM ledger GROUP BY source_type, status"))
def _(s, d):
    return D.outcome_counters(X.run_ledger(s, d))


@query("d23_leaderboard", "SELECT c_name AS username, c_acctbal AS credibility FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20")
def _(s, d):
    return D.leaderboard(X.table(s, d, "customer").select(F.col("c_name").alias("username"), F.col("c_acctbal").alias("credibility")), 20)


@query("f2_listing", sql("items", "SELECT item_id, quality, published_at FROM items ORDER BY quality DESC, published_at DESC, item_id LIMIT 20 OFFSET 10"))
def _(s, d):
    return X.items(s, d).select("item_id", "quality", "published_at").orderBy(F.desc("quality"), F.desc("published_at"), "item_id").offset(10).limit(20)


@query("f3_global_top", sql("items", "SELECT item_id, remix FROM items ORDER BY remix DESC, item_id LIMIT 15"))
def _(s, d):
    return X.items(s, d).select("item_id", "remix").orderBy(F.desc("remix"), "item_id").limit(15)


FOLD = "translate({0}, '" + T.MARKED + "', '" + T.PLAIN + "')"


@query("h1_slugify", sql("items", f"""SELECT item_id, coalesce(nullif(substring(regexp_replace(regexp_replace(lower(regexp_replace({FOLD.format('title')}, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'artifact') AS slug FROM items"""))
def _(s, d):
    return X.items(s, d).select("item_id", T.slugify(F.col("title")).alias("slug"))


@query("h2_clean_text", "SELECT page_id, " + st(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(html, '```[a-zA-Z0-9]*\n', '', 'g'), '```', ''), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS cleaned FROM pages")
def _(s, d):
    return X.table(s, d, "pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


@query("h3_truncate", f"SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(substring(t, 1, 120), ' [^ ]*$', '') || '…' END AS short FROM (SELECT doc_id, {st('text')} AS t FROM documents)")
def _(s, d):
    return X.table(s, d, "documents").select("doc_id", T.truncate(F.col("text"), 120).alias("short"))


URL_SQL = r"""SELECT page_id, 'https://' || regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '')
 || regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical
FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|ref|fbclid|gclid)')), '&') AS q FROM pages)"""


@query("h4_canonical_url", URL_SQL)
def _(s, d):
    return X.table(s, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("h5_valid_url", "SELECT page_id, contains(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), '.') AS valid FROM pages")
def _(s, d):
    return X.table(s, d, "pages").select("page_id", T.valid_url(F.col("url")).alias("valid"))


@query("h6_distinct_keep_order", sql("items", """SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(list_transform(v, lambda x: lower(x)), lower(v[i])) = i), lambda i: v[i]), ',') AS kept
    FROM (SELECT item_id, list_filter(string_split(summary, ' '), lambda x: trim(x) <> '' AND NOT contains(x, chr(10))) AS v FROM items)"""))
def _(s, d):
    words = F.filter(F.split("summary", " "), lambda x: ~F.contains(x, F.lit("\n")))
    return X.items(s, d).select("item_id", F.array_join(T.distinct_keep_order(words), ",").alias("kept"))


@query("h7_strip_markdown", "SELECT conv_id, turn, " + st(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[`*_#>]+', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')") + " AS plain FROM conversations")
def _(s, d):
    return X.table(s, d, "conversations").select("conv_id", "turn", T.strip_markdown(F.col("text")).alias("plain"))


@query("h8_strip_html", "SELECT page_id, " + st(r"regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \t\n\r\f\v]+', ' ', 'g')") + " AS plain FROM pages")
def _(s, d):
    return X.table(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query("h9_parse_date", "SELECT event_id, ts AS parsed, CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS again FROM events")
def _(s, d):
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss Z")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return X.table(s, d, "events").select("event_id", ts.alias("parsed"), T.parse_date(raw).alias("again"))


REC = "(CASE WHEN published_at IS NULL THEN 0.3::DOUBLE WHEN age <= 0 THEN 1.0 WHEN age >= 180 THEN 0.0 ELSE 1.0::DOUBLE - age::DOUBLE / 180 END)"
AGED = "aged AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(published_at)) / 86400000000) AS BIGINT) AS age FROM items)"


@query("h10_recency", sql("items", f"SELECT item_id, round({REC}, 9) AS recency FROM aged", AGED))
def _(s, d):
    return X.items(s, d).select("item_id", F.round(S.recency(F.col("published_at"), now()), 9).alias("recency"))


@query("h11_normalize_score", sql("items", "SELECT item_id, greatest(0.0::DOUBLE, least(1.0, (quality * 2 - 50) / 100)) AS score FROM items"))
def _(s, d):
    return X.items(s, d).select("item_id", S.normalize_score(F.col("quality") * 2 - 50).alias("score"))


@query("h12_popularity", sql("items", "SELECT item_id, round_even(least(100.0::DOUBLE, 2 * sqrt(coalesce(stars, 0)) + least(quality, 500) / 50), 6) AS sqrt_score, round_even(least(100.0::DOUBLE, 10 * log10(coalesce(stars, 0) + 1)), 6) AS log_score, least(100.0::DOUBLE, coalesce(stars, 0)) AS linear_score FROM items"))
def _(s, d):
    stars = F.col("stars")
    return X.items(s, d).select("item_id", F.bround(S.popularity(stars, F.col("quality")), 6).alias("sqrt_score"), F.bround(S.popularity(stars, kind="log"), 6).alias("log_score"), S.popularity(stars, kind="linear").alias("linear_score"))


@query("h13_dedupe_key", sql("items item_urls", r"""SELECT i.item_id, coalesce('gh:' || nullif(regexp_extract(lower(u), 'github\.com/([^/?#]+/[^/?#]+)', 1), ''), 'arxiv:' || nullif(regexp_extract(lower(u), 'arxiv\.org/(?:abs|pdf)/([0-9]+\.[0-9]+)', 1), ''), 't:' || nullif(lower(title), ''), 'id:' || i.item_id) AS key
    FROM (SELECT i.*, CASE i.item_id % 3 WHEN 0 THEN 'https://github.com/A/b' || i.item_id || '/tree' WHEN 1 THEN 'https://arxiv.org/abs/2401.' || i.item_id ELSE source_url END AS u FROM items i JOIN item_urls USING (item_id)) i"""))
def _(s, d):
    i = F.col("item_id").cast("string")
    u = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("https://github.com/A/b"), i, F.lit("/tree"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/2401."), i)).otherwise(F.col("source_url"))
    return X.items(s, d, url=True).select("item_id", T.dedupe_key(u, F.col("title"), F.col("item_id")).alias("key"))


@query("h14_cosine", "SELECT vec_id, round_even(" + COS.format("embedding", "other") + ", 6) AS similarity FROM embeddings JOIN (SELECT vec_id - 1 AS vec_id, embedding AS other FROM embeddings) USING (vec_id)")
def _(s, d):
    v = X.table(s, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.bround(T.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


VOCABULARY = ["tion", "thing", "schaft", "ción", "eau", "go", "er"]


@query("h15_match_vocabulary", "SELECT doc_id, array_to_string(list_filter(['schaft', 'thing', 'ción', 'tion', 'eau', 'er', 'go'], lambda v: contains(lower(text), v)), ',') AS found FROM documents")
def _(s, d):
    return X.table(s, d, "documents").select("doc_id", F.array_join(T.match_vocabulary(F.col("text"), VOCABULARY), ",").alias("found"))


@query("h16_setup_commands")
def _(s, d):
    readme = F.concat(F.lit("# Use\n```bash\n$ pip install "), F.col("source"), F.lit("\nls\n```\n"), F.col("text"), F.lit("\n```sh\ndocker run "), F.col("lang"), F.lit("\n```\n"))
    return X.table(s, d, "documents").select("doc_id", F.array_join(T.setup_commands(readme), ";").alias("commands"))


@query("h17_steps", sql("", r"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) > 10), lambda x: regexp_replace(regexp_replace(x, '^[ \t\r\f\v]+', ''), '[ \t\r\f\v]+$', ''))[1:15], '|') AS steps FROM documents"""))
def _(s, d):
    listed = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")
    return X.table(s, d, "documents").select("doc_id", F.array_join(T.steps(listed), "|").alias("steps"))


TYPE_SQL = """CASE WHEN contains(t, 'arxiv') OR has_paper THEN 'paper' WHEN contains(t, 'mcp') THEN 'mcp_server' WHEN contains(t, 'model') THEN 'model' WHEN contains(t, 'tutor') THEN 'tutorial'
 WHEN has_demo THEN 'demo' WHEN has_code THEN 'repository' WHEN contains(t, 'the') THEN 'article' ELSE 'project' END"""


@query("h18_infer_type", sql("items", f"SELECT item_id, {TYPE_SQL} AS kind FROM (SELECT *, lower(title || ' ' || summary) AS t FROM items)"))
def _(s, d):
    return X.items(s, d).select("item_id", B.infer_type().alias("kind"))


@query("h19_significant_terms", sql("", "SELECT item_id, array_to_string(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i)[1:20].list_transform(lambda i: v[i]), ' ') AS terms FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9+.#-]*|[0-9]+[a-zA-Z]*'), lambda t: length(t) >= 3 AND NOT list_contains(string_split('" + " ".join(T.STOPWORDS) + "', ' '), t)) AS v FROM benchmark)"))
def _(s, d):
    return X.table(s, d, "benchmark").select("item_id", F.array_join(T.significant_terms(F.col("text")), " ").alias("terms"))


@query("h20_normalize_query", "SELECT item_id, " + st(r"regexp_replace('  ' || text, '[ \t\n\r\f\v]+', ' ', 'g')") + " AS q FROM benchmark")
def _(s, d):
    return X.table(s, d, "benchmark").select("item_id", T.normalize_query(F.concat(F.lit("  "), F.col("text"))).alias("q"))


@query("h21_text_blob", sql("items", "SELECT item_id, lower(concat_ws(' ', title, summary, use_case, core, array_to_string(tags, ' '), array_to_string(tools, ' '), coalesce(array_to_string(frameworks, ' '), ''), array_to_string(languages, ' '), artifact_type)) AS blob FROM items"))
def _(s, d):
    return X.items(s, d).select("item_id", B.text_blob().alias("blob"))


@query("h22_vector_text", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.6f}', x::DOUBLE)), ',') || ']' AS literal, len(embedding)::BIGINT AS size FROM embeddings")
def _(s, d):
    lit = T.format_vector(F.col("embedding"))
    return X.table(s, d, "embeddings").select("vec_id", lit.alias("literal"), F.size(T.parse_vector(lit)).cast("bigint").alias("size"))


@query("h23_unique_slug", sql("items item_urls", "SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN substring(slug, 1, 70) || '-' || substring(sha1(source_url), 1, 6) ELSE slug END AS slug FROM (SELECT item_id, lower(artifact_type) || '-' || item_id % 300 AS slug, source_url FROM items JOIN item_urls USING (item_id))"))
def _(s, d):
    rows = X.items(s, d, url=True).select("item_id", F.concat(F.lower("artifact_type"), F.lit("-"), (F.col("item_id") % 300).cast("string")).alias("slug"), "source_url")
    return B.with_unique_slugs(rows)


@query("h24_first_paragraph")
def _(s, d):
    readme = F.concat(F.lit("# Title\n\n![badge](x)\n\n"), F.col("text"))
    return X.table(s, d, "documents").select("doc_id", T.first_paragraph(readme).alias("paragraph"))


@query("h27_confidence_label", sql("items", "SELECT item_id, CASE WHEN quality / 100 >= 0.66 THEN 'strong' WHEN quality / 100 >= 0.4 THEN 'related' ELSE 'adjacent' END AS label FROM items"))
def _(s, d):
    return X.items(s, d).select("item_id", S.confidence_label(F.col("quality") / 100).alias("label"))


@query("h31_search_tokens", sql("", "SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i)[1:24], lambda i: v[i]), ' | ') AS q FROM (SELECT item_id, list_filter(list_transform(string_split(text, ' '), lambda t: regexp_replace(lower(t), '[^a-zA-Z0-9]', '', 'g')), lambda t: length(t) >= 3 AND NOT list_contains(string_split('" + " ".join(T.STOPWORDS) + "', ' '), t)) AS v FROM benchmark)"))
def _(s, d):
    return X.table(s, d, "benchmark").select("item_id", F.array_join(T.search_tokens(F.split("text", " ")), " | ").alias("q"))


@query("h32_relative_time", sql("ledger", "SELECT event_id, CASE WHEN s < 90 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago' ELSE floor(s / 86400)::BIGINT || 'd ago' END AS label FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(finished_at) // 1000000) AS s FROM ledger)"))
def _(s, d):
    seconds = F.unix_timestamp(now()) - F.unix_timestamp("finished_at")
    return X.run_ledger(s, d).select("event_id", T.relative_time(seconds).alias("label"))


@query("h34_normalize_topics", sql("items", "SELECT item_id, array_to_string(list_filter(list_transform(string_split(title, ','), lambda t: replace(lower(trim(t)), ' ', '-')), lambda t: t <> ''), ',') AS topics FROM items"))
def _(s, d):
    return X.items(s, d).select("item_id", F.array_join(T.normalize_topics(F.split("title", ",")), ",").alias("topics"))


@query("h36_flat_grade", sql("items query_terms", "SELECT q.query_id, i.item_id, count(*) AS grade FROM (SELECT item_id, lower(title || ' ' || summary) AS t FROM items) i JOIN query_terms q ON contains(t, q.term) GROUP BY q.query_id, i.item_id"))
def _(s, d):
    blob = F.lower(F.concat_ws(" ", "title", "summary"))
    return E.graded_terms(X.items(s, d), X.query_terms(s, d), {"blob": (blob, 1)})


@query("h38_token_set", sql("items", "SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(list_concat(list_concat(tags, tools), list_concat(frameworks, languages)), lambda x: lower(x)), list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 4)))), ' ') AS tokens FROM items"))
def _(s, d):
    return X.items(s, d).select("item_id", F.array_join(F.array_sort(T.token_set()), " ").alias("tokens"))


@query("g4_jaccard", sql("items", """SELECT a.item_id AS a, b.item_id AS b, round_even(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
    FROM (SELECT item_id, list_distinct(list_concat(list_concat(tags, tools), languages)) AS t FROM items) a JOIN (SELECT item_id, list_distinct(list_concat(list_concat(tags, tools), languages)) AS t FROM items) b ON b.item_id = a.item_id + 1"""))
def _(s, d):
    tokens = X.items(s, d).select("item_id", F.array_distinct(F.concat("tags", "tools", "languages")).alias("t"))
    other = tokens.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("t").alias("u"))
    return tokens.join(other, "item_id").select(F.col("item_id").alias("a"), "b", F.bround(T.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


LEN = lambda c, n: f"length({st(c)}) >= {n}"
PT = lambda n, c: f"CASE WHEN {c} THEN {n}.0::DOUBLE ELSE 0 END"
QUALITY = " + ".join(PT(n, c) for n, c in ((20, LEN("use_case", 40)), (20, "len(commands) > 0"), (15, "has_code OR has_demo OR has_paper"), (15, LEN("core", 40)), (10, LEN("use_case", 25)), (10, "published_at IS NOT NULL"), (10, "has_demo OR contains(lower(summary), 'example')")))
REMIX = " + ".join(PT(n, c) for n, c in ((20, "has_code"), (15, "has_docs"), (15, "len(commands) > 0"), (10, "lower(license) = 'mit'"), (10, LEN("core", 30)), (10, "has_demo"), (5, LEN("summary", 20))))
COMB = "(title || ' ' || summary || ' ' || use_case || ' ' || core)"
HYPE = " + ".join(PT(n, c) for n, c in ((20, " OR ".join(f"contains(lower{COMB}, '{p}')" for p in S.MARKETING)), (10, f"regexp_matches(lower{COMB}, '{S.AI_WORD}') AND length{COMB} < 120"), (20, "NOT (has_code OR has_demo OR has_paper)"), (15, "len(commands) = 0"), (15, f"NOT {LEN(COMB, 200)} AND length{COMB} > 20"), (10, f"NOT {LEN('core', 30)}"), (10, "len(list_filter(string_split(title, ' '), lambda w: w <> '')) <= 3 AND NOT has_code")))
APPL = " + ".join(PT(n, c) for n, c in ((25, LEN("use_case", 40)), (20, "has_code OR has_demo"), (20, "len(frameworks) > 0 OR len(tools) > 0"), (15, "len(commands) > 0"), (10, LEN("core", 25)), (10, LEN("summary", 30))))
UNDER = f"greatest(0.0, least(100.0, 100 * (0.35::DOUBLE * (CASE WHEN stars IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - least(stars, 2000)::DOUBLE / 2000) ELSE greatest(0.0::DOUBLE, 1 - popularity / 100) END) + 0.25::DOUBLE * {REC} + 0.25::DOUBLE * quality / 100 + 0.15::DOUBLE * 0.5)))"
SUBST = "least(1.0::DOUBLE, CASE WHEN has_code THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN len(commands) > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN length(summary || ' ' || use_case || ' ' || core) >= 120 THEN 0.3::DOUBLE ELSE 0 END)"

for _name, _expr, _sql in (("i1_quality", S.quality, QUALITY), ("i2_remixability", S.remixability, REMIX), ("i3_hype_risk", S.hype_risk, HYPE), ("i4_applicability", S.applicability, APPL)):

    @query(_name, sql("items", f"SELECT item_id, {_sql} AS score FROM items"))
    def _(s, d, e=_expr):
        return X.items(s, d).select("item_id", e().alias("score"))


@query("i5_underground", sql("items", f"SELECT item_id, round_even({UNDER}, 6) AS score FROM aged", AGED))
def _(s, d):
    return X.items(s, d).select("item_id", F.bround(S.underground(now(), F.col("quality"), F.col("stars")), 6).alias("score"))


@query("i6_score_all", sql("items", f"SELECT item_id, {QUALITY} AS quality, {REMIX} AS remix, {HYPE} AS hype, {APPL} AS applicability FROM items"))
def _(s, d):
    return B.score_all(X.items(s, d), now()).select("item_id", "quality", "remix", "hype", "applicability")


@query("i7_substance", sql("items", f"SELECT item_id, round_even({SUBST}, 6) AS score FROM items"))
def _(s, d):
    return X.items(s, d).select("item_id", F.bround(S.substance(), 6).alias("score"))


FINAL = f"greatest(0.0, least(1.0, 0.5::DOUBLE * remix / 100 + 0.2::DOUBLE * least(1.0, 45 * (1.0::DOUBLE / (60 + item_id % 50))) + 0.03::DOUBLE * remix / 100 + 0.07::DOUBLE * quality / 100 + 0.13::DOUBLE * {UNDER} / 100 + 0.02::DOUBLE * {REC} + 0.01::DOUBLE * popularity / 100 + 0.08::DOUBLE * {SUBST} - 0.2::DOUBLE * hype / 100))"


@query("i14_final_score", sql("items", f"SELECT item_id, round_even({FINAL}, 9) AS score FROM aged", AGED))
def _(s, d):
    fused = F.lit(1.0) / (60 + F.col("item_id") % 50)
    return X.items(s, d).select("item_id", F.bround(S.final_score(F.col("remix") / 100, fused, now()), 9).alias("score"))


@query("i10_project_type", sql("", """SELECT doc_id, CASE WHEN r AND b AND p THEN 'rag_browser_research' WHEN l THEN 'education_media' WHEN m THEN 'coding_agent_tooling' WHEN c THEN 'computer_vision'
    WHEN r AND p AND NOT b THEN 'rag_research' WHEN r AND b THEN 'rag_browser_research' WHEN b AND NOT r THEN 'browser_extension' ELSE 'general' END AS project_type
    FROM (SELECT doc_id, contains(t, 'rag') OR contains(t, 'retrieval') OR contains(t, 'vector') AS r, contains(t, 'chrome') OR contains(t, 'extension') AS b, contains(t, 'paper') OR contains(t, 'arxiv') OR contains(t, 'pdf') OR contains(t, 'research') AS p,
    contains(t, 'lecture') OR contains(t, 'quiz') OR contains(t, 'flashcard') OR contains(t, 'video summarizer') AS l, contains(t, 'mcp') OR contains(t, 'coding agent') OR contains(t, 'claude code') OR contains(t, 'cursor') AS m,
    contains(t, 'computer vision') OR contains(t, 'posture') OR contains(t, 'pose') OR contains(t, 'webcam') AS c FROM (SELECT doc_id, lower(text) || CASE doc_id % 5 WHEN 0 THEN ' rag paper' WHEN 1 THEN ' chrome' WHEN 2 THEN ' chrome rag' WHEN 3 THEN ' quiz' ELSE '' END AS t FROM documents))"""))
def _(s, d):
    tail = F.element_at(F.array(*map(F.lit, (" rag paper", " chrome", " chrome rag", " quiz", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return X.table(s, d, "documents").select("doc_id", B.project_type(F.concat("text", tail)).alias("project_type"))

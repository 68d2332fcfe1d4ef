"""Retrieval, fusion, ranking and evaluation for the table of queries."""

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
from millrace.operators import rank as R
from millrace.operators import retrieve as J
from millrace.operators import stats as D
from millrace.operators.posting_store import PostingStore
from millrace.operators.vector_index import VectorIndex
from millrace.plans.item_queries import AGED, COS, FINAL, REC, SUBST, UNDER, now
from millrace.plans.registry import query
from millrace.sources.tables import shared_folder

FIELDS = {"title": "A", "summary": "B", "use_case": "C", "core": "C"}
STOP = "string_split('" + " ".join(T.STOPWORDS) + "', ' ')"
#: SQL of the shared steps, as common table expressions.
POST_ROWS = """SELECT item_id, unnest(regexp_extract_all(lower(title), '[a-z][a-z0-9+.#-]*|[0-9]+[a-z]*')) AS term, 1.0::DOUBLE AS w FROM items UNION ALL
  SELECT item_id, unnest(regexp_extract_all(lower(summary), '[a-z][a-z0-9+.#-]*|[0-9]+[a-z]*')), 0.4::DOUBLE FROM items UNION ALL
  SELECT item_id, unnest(regexp_extract_all(lower(use_case), '[a-z][a-z0-9+.#-]*|[0-9]+[a-z]*')), 0.2::DOUBLE FROM items UNION ALL
  SELECT item_id, unnest(regexp_extract_all(lower(core), '[a-z][a-z0-9+.#-]*|[0-9]+[a-z]*')), 0.2::DOUBLE FROM items"""
_KEPT_ROWS = f"(SELECT * FROM ({POST_ROWS}) WHERE NOT list_contains({STOP}, term))"
POSTS = f"posts AS (SELECT term, item_id, sum(w) AS weight, count(*) AS n FROM {_KEPT_ROWS} GROUP BY term, item_id)"
#: The same with words and query terms without their suffixes.
STEM_POSTS = f"posts AS (SELECT term, item_id, sum(w) AS weight, count(*) AS n FROM {T.stemmed_sql(_KEPT_ROWS, 'term')} GROUP BY term, item_id)"
STEM_TERMS = f"stem_terms AS (SELECT DISTINCT query_id, term FROM {T.stemmed_sql('query_terms', 'term')})"
KW = """kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_rank DESC, item_id) AS rank FROM (
  SELECT query_id, item_id, round_even(sum(weight) / (sum(weight) + 1), 6) AS kw_rank FROM posts JOIN query_terms USING (term) GROUP BY query_id, item_id)) WHERE rank <= 100)"""
SIM = f"sims AS (SELECT query_id, item_id, round_even({COS.format('query_vector', 'embedding')}, 6) AS similarity FROM query_vectors, item_vectors)"
VEC = """vec AS (SELECT query_id, item_id, greatest(similarity, 0.0::DOUBLE) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM sims) WHERE rank <= 100 AND greatest(similarity, 0) >= 0.1)"""
INT = """intent AS (SELECT query_id, item_id, rank, 0.55::DOUBLE AS kw_rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, item_id) AS rank FROM (
  SELECT DISTINCT query_id, i.item_id, quality FROM items i, (SELECT query_id, term FROM leg_terms WHERE named) q WHERE contains(lower(title) || chr(10) || lower(summary), term) OR list_contains(list_transform(list_concat(list_concat(tags, tools), frameworks), lambda x: lower(x)), term))) WHERE rank <= 40)"""
RRF = """fused AS (SELECT query_id, item_id, round_even(sum(part), 9) AS fused FROM (
  SELECT query_id, item_id, 1.31::DOUBLE / (60 + rank) AS part FROM kw UNION ALL SELECT query_id, item_id, 0.60::DOUBLE / (60 + rank) FROM vec UNION ALL SELECT query_id, item_id, 0.28::DOUBLE / (60 + rank) FROM intent) GROUP BY query_id, item_id)"""
FUSE = """byitem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY leg0, rank0, item_id) AS arrival FROM (
  SELECT query_id, item_id, max(kw_rank) AS kw_rank, max(similarity) AS similarity, min(leg * 1000 + rank) // 1000 AS leg0, min(leg * 1000 + rank) % 1000 AS rank0 FROM (
  SELECT query_id, item_id, rank, 0 AS leg, kw_rank, NULL::DOUBLE AS similarity FROM kw UNION ALL SELECT query_id, item_id, rank, 1, NULL, similarity FROM vec UNION ALL SELECT query_id, item_id, rank, 2, kw_rank, NULL FROM intent) GROUP BY query_id, item_id))"""
NEED = "items queries query_terms query_vectors item_vectors"
SYNONYMS = ", ".join(f"('{t}', '{w}')" for t, ws in I.SYNONYMS.items() for w in ws)
BODY = "lower(concat_ws(' ', summary, use_case, core, array_to_string(tags, ' '), array_to_string(tools, ' '), coalesce(array_to_string(frameworks, ' '), ''), array_to_string(languages, ' ')))"
QRELS = f"""asked AS (SELECT query_id, term FROM query_terms UNION SELECT query_id, word FROM query_terms JOIN (VALUES {SYNONYMS}) v(term, word) USING (term)),
told AS MATERIALIZED (SELECT item_id, term, CASE WHEN contains(t, term) THEN 2 ELSE 1 END AS points FROM (SELECT item_id, lower(title) AS t, {BODY} AS b FROM items), (SELECT DISTINCT term FROM asked) WHERE contains(t, term) OR contains(b, term)),
qrels AS (SELECT query_id, item_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS rank FROM (
  SELECT query_id, item_id, sum(points)::BIGINT AS grade FROM told JOIN asked USING (term) GROUP BY query_id, item_id) WHERE grade >= 3) WHERE rank <= 80)"""
RUN = "run AS (SELECT query_id, item_id, rank FROM kw)"


def terms_of(s, d):
    return X.query_terms(s, d)


def posts_of(s, d):
    return J.postings(X.items(s, d), FIELDS)


def asked_posts(s, d, terms):
    """Postings of the terms of the queries only."""
    return J.postings(X.items(s, d), FIELDS, terms=terms)


def kw_leg(s, d, k=100):
    return J.keyword_or_texts(terms_of(s, d), X.items(s, d), FIELDS, k)


def vectors(s, d):
    return X.table(s, d, "documents").select(F.col("doc_id").alias("item_id")).join(X.table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")


def vec_leg(s, d):
    return J.vector_search(X.query_vectors(s, d), vectors(s, d), 100, 0.1)


def asked_queries(s, d):
    """The queries with the vectors of those ids that have one."""
    return X.queries(s, d).join(X.query_vectors(s, d), "query_id", "left")


def legs_and_intents(s, d, asked=None, facets=lambda items: items):
    """The legs of hybrid search and the intents they come from, over the items that the facets leave."""
    asked = written(s, asked if asked is not None else asked_queries(s, d))
    understood = written(s, I.enrich_intent(I.extract_intent(asked.select("query_id", "query"))))
    items = facets(X.items(s, d))
    # both probes and the feedback between them read the vectors
    held = written(s, vectors(s, d).join(items.select("item_id"), "item_id", "left_semi"))
    return J.retrieve_legs(asked, understood, items, held, FIELDS, lambda df: written(s, df), feedback=True), understood


def all_legs(s, d):
    return legs_and_intents(s, d)[0]


def qrels_of(s, d):
    return E.oracle_qrels(X.items(s, d), terms_of(s, d))


@query("c1_terms_postings", sql("items query_terms", "SELECT query_id, term, count(*) AS n FROM posts JOIN query_terms USING (term) GROUP BY query_id, term", POSTS))
def _(s, d):
    return asked_posts(s, d, terms_of(s, d)).join(terms_of(s, d), "term").groupBy("query_id", "term").agg(F.count("*").alias("n"))


@query("c2_nearest_all_pairs", sql("query_vectors item_vectors", "SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM sims) WHERE rank <= 10", SIM))
def _(s, d):
    return J.top_k(J.similarities(X.query_vectors(s, d), vectors(s, d), 10), 10, [F.desc("similarity"), "item_id"])


@query("j1_postings", sql("items", "SELECT term, item_id, round_even(weight, 6) AS weight, n FROM posts", POSTS))
def _(s, d):
    return posts_of(s, d).select("term", "item_id", F.bround("weight", 6).alias("weight"), "n")


J2_SQL = sql("items query_terms", "SELECT query_id, item_id, kw_rank, rank FROM kw", POSTS, KW)


@query("j2_keyword_or", J2_SQL)
def _(s, d):
    return kw_leg(s, d)


def stem_terms(s, d):
    return T.stemmed(terms_of(s, d), "term").distinct()


@query("j2c_keyword_or_stemmed", sql("items query_terms", "SELECT query_id, item_id, kw_rank, rank FROM kw", STEM_POSTS, STEM_TERMS, KW.replace("query_terms", "stem_terms")))
def _(s, d):
    terms = stem_terms(s, d)
    return J.keyword_or_leg(terms, J.postings(X.items(s, d), FIELDS, terms=terms, stem=True))


def stored(s, d):
    return PostingStore.build(X.items(s, d), FIELDS, shared_folder(s, "store"))


@query("j2b_keyword_or_stored", J2_SQL)
def _(s, d):
    return stored(s, d).keyword_or_leg(written(s, terms_of(s, d)))


@query("j1b_stored_postings", sql("items query_terms", "SELECT term, item_id, round_even(weight, 6) AS weight, n FROM posts WHERE term IN (SELECT term FROM query_terms)", POSTS))
def _(s, d):
    return stored(s, d).postings(terms_of(s, d)).select("term", "item_id", F.bround("weight", 6).alias("weight"), "n")


def two_terms(s, d):
    return J.top_k(terms_of(s, d), 2, ["term"], rank="t").drop("t")


TOKENS = r"[a-z][a-z0-9+.#-]*|[0-9]+[a-z]*"
PLACES = f"""toks AS (SELECT item_id, regexp_extract_all(lower(title), '{TOKENS}') AS a, regexp_extract_all(lower(summary), '{TOKENS}') AS b, regexp_extract_all(lower(use_case), '{TOKENS}') AS c, regexp_extract_all(lower(core), '{TOKENS}') AS d FROM items),
places AS (SELECT item_id, w[p + 1] AS term, p FROM (SELECT item_id, w, unnest(range(len(w))) AS p FROM (SELECT item_id, list_concat(list_concat(a, b), list_concat(c, d)) AS w FROM toks)) WHERE NOT list_contains({STOP}, w[p + 1]))"""
TWO = "two AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term) AS t FROM query_terms) WHERE t <= 2)"
AND_LEG = """needs AS (SELECT query_id, count(*) AS need FROM two GROUP BY query_id),
pairs2 AS (SELECT query_id, item_id, avg(weight) AS weight, any_value(need) AS need FROM posts JOIN two USING (term) JOIN needs USING (query_id) GROUP BY query_id, item_id HAVING count(*) = any_value(need)),
spots AS (SELECT query_id, item_id, term, p FROM pairs2 JOIN two USING (query_id) JOIN places USING (item_id, term)),
spans AS (SELECT query_id, item_id, min(span) AS span FROM (SELECT s.query_id, s.item_id, s.p, max(n.q) - s.p AS span, count(*) AS c FROM spots s JOIN LATERAL (SELECT term, min(p) AS q FROM spots x WHERE x.query_id = s.query_id AND x.item_id = s.item_id AND x.p >= s.p GROUP BY term) n ON true GROUP BY s.query_id, s.item_id, s.p) JOIN needs USING (query_id) WHERE c = need GROUP BY query_id, item_id),
andleg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_rank DESC, item_id) AS rank FROM (SELECT query_id, item_id, round_even(r / (r + 1), 6) AS kw_rank FROM (SELECT query_id, item_id, weight / (1 + greatest(0, span - need + 1)) AS r FROM spans JOIN pairs2 USING (query_id, item_id)))) WHERE rank <= 100)"""


@query("j3_keyword_and", sql("items query_terms", "SELECT query_id, item_id, kw_rank, rank FROM andleg", POSTS, PLACES, TWO, AND_LEG))
def _(s, d):
    return J.keyword_and_leg(two_terms(s, d), written(s, asked_posts(s, d, two_terms(s, d))), save=lambda df: written(s, df))


STEM_PLACES = PLACES.replace("places AS (", "raw_places AS (") + f",\nplaces AS (SELECT * FROM {T.stemmed_sql('raw_places', 'term')})"


@query("j3b_keyword_and_stemmed", sql("items query_terms", "SELECT query_id, item_id, kw_rank, rank FROM andleg", STEM_POSTS, STEM_PLACES, STEM_TERMS, TWO.replace("query_terms", "stem_terms"), AND_LEG))
def _(s, d):
    two = J.top_k(stem_terms(s, d), 2, ["term"], rank="t").drop("t")
    return J.keyword_and_leg(two, written(s, J.postings(X.items(s, d), FIELDS, terms=two, stem=True)), save=lambda df: written(s, df))


#: Choices set apart by `or`; all parts of a choice must be there and none with a minus.
WEB = f"""web_raw AS (SELECT query_id, query, regexp_extract_all(query, '-?"[^"]+"|[^ ]+') AS raws FROM web_queries),
web_at AS (SELECT query_id, raws[i] AS raw, len(list_filter(raws[1:i], lambda r: lower(r) = 'or')) AS choice FROM (SELECT *, unnest(range(1, len(raws) + 1)) AS i FROM web_raw)),
parts AS (SELECT DISTINCT query_id, choice, array_to_string(regexp_extract_all(lower(raw), '{TOKENS}'), ' ') AS part, starts_with(raw, '-') AS excluded FROM web_at WHERE lower(raw) <> 'or' AND len(regexp_extract_all(lower(raw), '{TOKENS}')) > 0),
wanted AS (SELECT * FROM (SELECT query_id, choice, part, excluded, unnest(string_split(part, ' ')) AS term, unnest(range(len(string_split(part, ' ')))) AS i FROM parts) WHERE NOT list_contains({STOP}, term)),
sizes AS (SELECT query_id, choice, part, excluded, count(DISTINCT i) AS size FROM wanted GROUP BY ALL),
runs AS (SELECT query_id, choice, part, excluded, item_id, p - i AS start, count(DISTINCT i) AS c, sum(weight) AS w FROM wanted JOIN places USING (term) JOIN posts USING (term, item_id) GROUP BY query_id, choice, part, excluded, item_id, p - i),
matched AS (SELECT query_id, choice, part, excluded, item_id, max(w) AS w FROM runs JOIN sizes USING (query_id, choice, part, excluded) WHERE c = size GROUP BY query_id, choice, part, excluded, item_id),
fitting AS (SELECT query_id, choice, item_id, count(*) AS found, sum(w) AS w FROM matched m WHERE NOT excluded AND NOT EXISTS (SELECT 1 FROM matched x WHERE x.excluded AND x.query_id = m.query_id AND x.choice = m.choice AND x.item_id = m.item_id) GROUP BY query_id, choice, item_id),
webleg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_rank DESC, item_id) AS rank FROM (SELECT query_id, item_id, round_even(sum(w) / (sum(w) + 1), 6) AS kw_rank FROM fitting JOIN (SELECT query_id, choice, count(*) AS n FROM sizes WHERE NOT excluded GROUP BY query_id, choice) USING (query_id, choice) WHERE found = n GROUP BY query_id, item_id)) WHERE rank <= 100)"""
WEB_QUERIES = """web_queries AS (SELECT query_id, '"' || w[1] || ' ' || w[2] || '" or ' || w[4] || ' ' || w[5] || ' or ' || w[7] || ' -' || w[6] AS query FROM (SELECT query_id, string_split(query, ' ') AS w FROM queries))"""


@query("j4_keyword_web", sql("items queries", "SELECT query_id, item_id, kw_rank, rank FROM webleg", POSTS, PLACES, WEB_QUERIES, WEB))
def _(s, d):
    return J.keyword_web_leg(web_queries(s, d), written(s, asked_posts(s, d, J.web_terms(web_queries(s, d)))), save=lambda df: written(s, df))


def web_queries(s, d):
    w = F.split("query", " ")
    return X.queries(s, d).select("query_id", F.concat(F.lit('"'), w[0], F.lit(" "), w[1], F.lit('" or '), w[3], F.lit(" "), w[4], F.lit(" or "), w[6], F.lit(" -"), w[5]).alias("query"))


#: The keyword leg of hybrid search: terms of the intents, and the query as typed.
INTENTS = I.intent_sql()
ANY = f"""any_terms AS (SELECT query_id, unnest(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i)[1:24], lambda i: v[i])) AS term FROM (
  SELECT query_id, list_filter(list_transform(search_terms, lambda t: regexp_replace(lower(t), '[^a-zA-Z0-9]', '', 'g')), lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t)) AS v FROM intents))"""
ALL = f"""all_terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(array_to_string(search_terms[1:12], ' ')), '{TOKENS}')) AS term FROM intents) WHERE NOT list_contains({STOP}, term))"""
KEYWORD = (POSTS, PLACES, INTENTS, ANY, ALL, KW.replace("kw AS", "kw_any AS").replace("query_terms", "any_terms"), AND_LEG.replace(" two ", " all_terms ").replace("JOIN two ", "JOIN all_terms "), "web_queries AS (SELECT query_id, query FROM queries)", WEB,
    """kw_all AS (SELECT query_id, item_id, kw_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_rank DESC, item_id) AS rank FROM (
  SELECT query_id, item_id, max(kw_rank) AS kw_rank FROM (SELECT query_id, item_id, kw_rank FROM kw_any UNION ALL SELECT query_id, item_id, kw_rank FROM andleg UNION ALL SELECT query_id, item_id, kw_rank FROM webleg) GROUP BY query_id, item_id)) WHERE rank <= 100)""")


@query("j5_keyword_search", sql("items queries", "SELECT query_id, item_id, kw_rank, rank FROM kw_all", *KEYWORD))
def _(s, d):
    understood = written(s, intents(s, d))
    terms, typed = J.leg_terms(understood), X.queries(s, d)
    return J.keyword_texts(terms["any"], terms["all"], typed, X.items(s, d), FIELDS, save=lambda df: written(s, df))


@query("j6_vector_search", sql("query_vectors item_vectors", "SELECT query_id, item_id, similarity, rank FROM vec", SIM, VEC))
def _(s, d):
    return vec_leg(s, d)


@query("j7_vector_search_lsh")
def _(s, d):
    return L.lsh_search(X.query_vectors(s, d), vectors(s, d), k=10)


@query("j7b_vector_search_cells")
def _(s, d):
    return VectorIndex.build(vectors(s, d), shared_folder(s, "index")).search(X.query_vectors(s, d), vectors(s, d), 10)


MOVED = """first5 AS (SELECT query_id, item_id FROM vec WHERE rank <= 5),
means AS (SELECT query_id, i, avg(embedding[i]::DOUBLE) AS m FROM first5 JOIN item_vectors USING (item_id) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY query_id, i),
moved AS (SELECT query_id, list(query_vector[i]::DOUBLE + 0.5::DOUBLE * m ORDER BY i) AS query_vector FROM means JOIN query_vectors USING (query_id) GROUP BY query_id),
sims2 AS (SELECT query_id, item_id, round_even(""" + COS.format("query_vector", "embedding") + """, 6) AS similarity FROM moved, item_vectors)"""


#: The first hits, then what the moved vectors find beyond them; a hit of both keeps the similarity to the vector as it was.
PRF = """probe AS (SELECT query_id, item_id, greatest(similarity, 0.0::DOUBLE) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM sims2) WHERE rank <= 100),
prf AS (SELECT query_id, item_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank) AS rank FROM (
  SELECT query_id, item_id, similarity, rank, 0 AS leg FROM vec UNION ALL SELECT query_id, item_id, similarity, rank, 1 FROM probe ANTI JOIN vec USING (query_id, item_id)))"""


@query("j8_prf_expand", sql("query_vectors item_vectors", "SELECT query_id, item_id, similarity, rank FROM prf", SIM, VEC, MOVED, PRF))
def _(s, d):
    return J.with_feedback(X.query_vectors(s, d), vectors(s, d), written(s, vec_leg(s, d)))


#: All legs of hybrid search under the names that fusion reads: the vector leg without a floor and with its second probe, the fallback for
#: queries that keywords and vectors leave open.
OPEN_VEC = VEC.replace("vec AS", "vec0 AS").replace(" AND greatest(similarity, 0) >= 0.1", "")
NAMED = """leg_terms AS (SELECT query_id, unnest(CASE WHEN len(v) > 0 THEN v ELSE list_distinct(list_filter(regexp_extract_all(lower(query), '[a-zA-Z0-9]+'), lambda t: length(t) > 2)[1:8]) END) AS term, len(v) > 0 AS named FROM (
  SELECT query_id, query, list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i)[1:12], lambda i: v[i]) AS v FROM (
  SELECT query_id, query, list_filter(list_transform(list_concat(list_concat(tags, tools), search_terms), lambda t: lower(t)), lambda t: length(t) >= 3) AS v FROM intents)))"""
BACK = """back AS (SELECT query_id, item_id, 0.25::DOUBLE AS kw_rank, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, item_id) AS rank FROM (
  SELECT DISTINCT query_id, i.item_id, quality FROM items i, leg_terms q WHERE query_id NOT IN (SELECT query_id FROM kw_all) AND query_id NOT IN (SELECT query_id FROM vec0)
  AND contains(lower(title) || chr(10) || lower(summary) || chr(10) || lower(use_case) || chr(10) || lower(array_to_string(tags, ' ')), term))) WHERE rank <= 50)"""
LEGS = (*KEYWORD, SIM, OPEN_VEC, MOVED.replace("FROM vec ", "FROM vec0 "), PRF.replace("FROM vec ", "FROM vec0 ").replace("JOIN vec ", "JOIN vec0 ").replace("prf AS", "vec AS"), NAMED, BACK,
    "kw AS (SELECT query_id, item_id, kw_rank, rank FROM kw_all UNION ALL SELECT * FROM back)", INT)


@query("d10_rocchio", sql("query_vectors item_vectors", "SELECT query_id, round_even(list_sum(list_transform(query_vector, lambda x: x / n)), 6) AS total FROM (SELECT query_id, query_vector, sqrt(list_sum(list_transform(query_vector, lambda x: x * x))) AS n FROM moved)", SIM, VEC, MOVED))
def _(s, d):
    moved = J.prf_expand(X.query_vectors(s, d), vectors(s, d), vec_leg(s, d))
    return moved.select("query_id", F.bround(F.aggregate("query_vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("c6_feedback_rows", sql("query_vectors item_vectors", "SELECT DISTINCT item_id, len(embedding)::BIGINT AS size FROM item_vectors WHERE item_id IN (SELECT item_id FROM vec WHERE rank <= 5)", SIM, VEC))
def _(s, d):
    top = vec_leg(s, d).filter("rank <= 5")
    return vectors(s, d).join(top, "item_id", "left_semi").select("item_id", F.size("embedding").cast("bigint").alias("size"))


@query("j9_intent_term_leg", sql("items queries", "SELECT query_id, item_id, rank, kw_rank FROM intent", INTENTS, NAMED, INT))
def _(s, d):
    return J.term_leg(J.leg_terms(written(s, intents(s, d)))["intent"], X.items(s, d), ["title", "summary"])


@query("j10_fallback", sql(NEED, """SELECT query_id, item_id, rank, 0.25::DOUBLE AS kw_rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, item_id) AS rank FROM (
  SELECT DISTINCT query_id, i.item_id, quality FROM items i, leg_terms q WHERE query_id NOT IN (SELECT query_id FROM vec)
  AND contains(lower(title) || chr(10) || lower(summary) || chr(10) || lower(use_case) || chr(10) || lower(array_to_string(tags, ' ')), term))) WHERE rank <= 50""", INTENTS, SIM, VEC, NAMED))
def _(s, d):
    terms = J.leg_terms(written(s, intents(s, d)))["fallback"]
    return J.fallback_leg(X.queries(s, d), [vec_leg(s, d)], terms, X.items(s, d), ["title", "summary", "use_case"], lists=("tags",))


@query("c4_fuse_legs", sql(NEED, "SELECT query_id, item_id, kw_rank, similarity, arrival FROM byitem", *LEGS, FUSE))
def _(s, d):
    return R.fuse_by_item(*all_legs(s, d).values())


@query("j11_retrieve_legs", sql(NEED, "SELECT query_id, item_id, 'keyword' AS leg, rank FROM kw UNION ALL SELECT query_id, item_id, 'vector', rank FROM vec UNION ALL SELECT query_id, item_id, 'intent', rank FROM intent", *LEGS))
def _(s, d):
    out = None
    for name, leg in all_legs(s, d).items():
        rows = leg.select("query_id", "item_id", F.lit(name).alias("leg"), "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("g1_merge_hits", sql(NEED, """SELECT query_id, item_id, kw_rank, similarity, row_number() OVER (PARTITION BY query_id ORDER BY s, item_id) AS arrival FROM (
  SELECT query_id, item_id, max(kw_rank) AS kw_rank, max(similarity) AS similarity, min(leg * 1000 + rank) AS s FROM (SELECT query_id, item_id, rank, 0 AS leg, kw_rank, NULL::DOUBLE AS similarity FROM kw UNION ALL SELECT query_id, item_id, rank, 1, NULL, similarity FROM vec) GROUP BY query_id, item_id)""", POSTS, KW, SIM, VEC))
def _(s, d):
    return J.merge_hits(kw_leg(s, d), vec_leg(s, d))


@query("e1_rrf", sql(NEED, "SELECT query_id, item_id, fused FROM fused", *LEGS, RRF))
def _(s, d):
    return J.rrf(all_legs(s, d))


@query("f1_top_k_per_query", sql("items query_terms", "SELECT query_id, item_id, rank FROM kw WHERE rank <= 7", POSTS, KW))
def _(s, d):
    return kw_leg(s, d, 7).select("query_id", "item_id", "rank")


BLOB = "lower(concat_ws(' ', title, summary, use_case, core, array_to_string(tags, ' '), array_to_string(tools, ' '), coalesce(array_to_string(frameworks, ' '), ''), array_to_string(languages, ' '), artifact_type))"
_WANTED = {"frameworks": ("tight", "replace(lower(v), ' ', '')"), "tools": ("blob", "lower(v)"), "tags": ("blob", "lower(v)"), "languages": ("blob", "lower(v)")}
_PROFILES = ", ".join(f"('{n}', [{', '.join(repr(w) for w in ws)}])" for n, ws in I.PROFILE_WORDS.items())
_PARTS = {n: f"CASE WHEN len(w_{n}) > 0 THEN least(1.0::DOUBLE, len(list_filter(w_{n}, lambda v: contains({where}, {form})))::DOUBLE / greatest(1, least(len(w_{n}), 4))) END" for n, (where, form) in _WANTED.items()} | {
    "terms": "CASE WHEN len(search_terms) > 0 THEN least(1.0::DOUBLE, len(list_filter(search_terms[1:20], lambda v: contains(blob, lower(v))))::DOUBLE / greatest(2, least(len(search_terms), 8))) END",
    "types": "CASE WHEN list_contains(types, artifact_type) THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END",
    "profile": "CASE WHEN words IS NOT NULL THEN least(1.0::DOUBLE, len(list_filter(words, lambda v: contains(blob, v)))::DOUBLE / greatest(2, len(words) // 2)) END",
    "keyword": "CASE WHEN kw_rank > 0 THEN least(1.0::DOUBLE, kw_rank * 8) END",
    "vector": "CASE WHEN similarity IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, similarity)) END",
}


def relevance_sql(name: str, hits: str) -> str:
    """`hits` (query_id, item_id, kw_rank, similarity, ...) with their relevance, over items and intents."""
    total = " + ".join(f"coalesce({w}::DOUBLE * p_{n}, 0)" for n, w in R.SHARES.items())
    weight = " + ".join(f"CASE WHEN p_{n} IS NULL THEN 0 ELSE {w}::DOUBLE END" for n, w in R.SHARES.items())
    return f"""{name} AS (SELECT * EXCLUDE ({', '.join('p_' + n for n in R.SHARES)}), round_even(least(1.0::DOUBLE, ({total}) / ({weight})), 6) AS relevance FROM (SELECT h.*, {', '.join(f'{_PARTS[n]} AS p_{n}' for n in R.SHARES)}
  FROM {hits} h JOIN (SELECT item_id, artifact_type, {BLOB} AS blob, replace({BLOB}, ' ', '') AS tight FROM items) USING (item_id)
  JOIN (SELECT query_id, project_type, search_terms, types, frameworks AS w_frameworks, tools AS w_tools, tags AS w_tags, languages AS w_languages FROM intents) USING (query_id) LEFT JOIN (VALUES {_PROFILES}) v(project_type, words) USING (project_type)))"""


FINAL_HIT = FINAL.replace('remix / 100 + 0.2', 'relevance + 0.2').replace('45 * (1.0::DOUBLE / (60 + item_id % 50))', '45 * fused')
REL = relevance_sql("rel", "(SELECT query_id, item_id, fused, kw_rank, similarity, arrival FROM fused JOIN byitem USING (query_id, item_id))")
HYBRID = f"""scored AS (SELECT *, round_even({FINAL_HIT}, 9) AS final FROM rel JOIN aged USING (item_id)),
gated AS (SELECT * FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) AS n_ok, row_number() OVER (PARTITION BY query_id ORDER BY arrival) AS turn FROM (
    SELECT *, final >= 0.19 AND (relevance >= 0.11 OR coalesce(kw_rank, 0) >= 0.08 OR coalesce(similarity, 0) >= 0.43) AS ok FROM scored)) WHERE CASE WHEN n_ok < 3 THEN turn <= 10 ELSE ok END),
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(title) ORDER BY final DESC, arrival) AS best FROM gated) WHERE best = 1),
ranked AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item_id) AS rank FROM single) WHERE rank <= 10)"""
HITS = (*LEGS, RRF, FUSE, REL)
SEARCH = (*HITS, AGED, HYBRID)


def intents(s, d):
    return I.enrich_intent(I.extract_intent(X.queries(s, d)))


def hits(s, d):
    return R.scored_hits(*legs_and_intents(s, d), X.items(s, d), now())


def search(s, d, limit: int = 10, facets=lambda items: items, asked=None, **options):
    return R.hybrid_search(*legs_and_intents(s, d, asked, facets), facets(X.items(s, d)), now(), limit, **options)


@query("j13_hybrid_search", sql(NEED, "SELECT query_id, rank, item_id, final, relevance, fused, total FROM ranked", *SEARCH))
def hybrid(s, d):
    return search(s, d)


#: The same over the items that some facets leave, which hold before any limit.
FACETED = ("all_" + X.SQL["items"], "items AS (SELECT * FROM all_items WHERE quality >= 20 AND hype <= 90 AND (list_contains(tags, 'en') OR list_contains(tags, 'de')))", "item_vectors AS (SELECT vec_id AS item_id, embedding FROM embeddings JOIN items ON vec_id = item_id)")


@query("j13c_hybrid_faceted", sql("queries query_terms query_vectors", "SELECT query_id, rank, item_id, final, relevance, fused, total FROM ranked", *FACETED, *SEARCH))
def _(s, d):
    return search(s, d, facets=lambda items: B.facets(B.ranges(items, min_quality=20, max_hype=90), {"tags": ["en", "de"]}))


@query("j13b_hybrid_reranked")
def _(s, d):
    rows = written(s, L.ltr_features(hits(s, d), now()))
    model = L.train_ranker(rows, written(s, qrels_of(s, d)))
    return search(s, d, rerankers=(R.learned_order(model, now()), R.pair_order(X.queries(s, d), L.overlap_logit)), diverse=True)


def written(s, df):
    """A table that several steps read, written once."""
    path = shared_folder(s, "step")
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)


@query("b10_result_gate", sql(NEED, "SELECT query_id, item_id FROM gated", *SEARCH))
def _(s, d):
    return B.result_gate(hits(s, d)).select("query_id", "item_id")


@query("i13_relevance", sql(NEED, "SELECT query_id, item_id, relevance FROM rel", *HITS))
def _(s, d):
    return hits(s, d).select("query_id", "item_id", "relevance")


@query("e2_dedupe_best", sql("items query_terms", """SELECT query_id, item_id, place FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id, key ORDER BY kw_rank DESC, rank) AS t, min(rank) OVER (PARTITION BY query_id, key) AS place FROM (SELECT *, item_id % 20 AS key FROM kw)) WHERE t = 1""", POSTS, KW))
def _(s, d):
    hits = kw_leg(s, d).select("query_id", "item_id", (F.col("item_id") % 20).alias("key"), F.col("kw_rank").alias("final"), F.col("rank").alias("arrival"))
    return R.dedupe(hits, "key").select("query_id", "item_id", "place")


@query("e3_top_rank", sql("items query_terms", "SELECT query_id, item_id, rank - 1 AS top_rank FROM kw", POSTS, KW))
def _(s, d):
    return kw_leg(s, d).select("query_id", "item_id", (F.col("rank") - 1).alias("top_rank"))


@query("e4_min_max", sql("items query_terms", "SELECT query_id, item_id, round_even((kw_rank - min(kw_rank) OVER w) / CASE WHEN max(kw_rank) OVER w = min(kw_rank) OVER w THEN 1 ELSE max(kw_rank) OVER w - min(kw_rank) OVER w END, 6) AS scaled FROM kw WINDOW w AS (PARTITION BY query_id)", POSTS, KW))
def _(s, d):
    return R.min_max(kw_leg(s, d), "kw_rank", "scaled").select("query_id", "item_id", F.bround("scaled", 6).alias("scaled"))


def results(s, d):
    cols = ("artifact_type", "title", "summary", "use_case", "core", "source_type", "tags", "tools", "frameworks", "languages", "commands", "has_code", "has_demo", "has_paper", "quality", "remix", "hype")
    items = X.items(s, d).select("item_id", *cols, F.bround(S.underground(now(), F.col("quality"), F.col("stars")), 6).alias("underground"), F.concat(F.lit("https://github.com/o/r"), F.col("item_id").cast("string")).alias("source_url"))
    # only the items found are joined, so that no text of another one is shuffled
    found = written(s, search(s, d))
    return found.join(J.of_items(items, found), "item_id")


NODES = f"""nodes AS (SELECT *, round_even(2.6::DOUBLE + (1 - greatest(0.05::DOUBLE, least(1.0::DOUBLE, relevance))) * 4.2::DOUBLE, 6) AS radius FROM (
  SELECT query_id, theme, item_id, relevance, row_number() OVER (PARTITION BY query_id, theme ORDER BY relevance DESC, item_id) AS turn, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item_id) <= 4 AS top
  FROM (SELECT *, {D.theme_sql()} AS theme FROM ranked)) WHERE turn <= 8)"""


@query("e5_graph_nodes", (sql(NEED, "SELECT query_id, theme, item_id, turn, radius, top FROM nodes", *SEARCH, NODES)))
def _(s, d):
    return R.graph_nodes(results(s, d)).drop("relevance")


@query("e6_graph_edges", (sql(NEED, """SELECT query_id, -1::BIGINT AS source, item_id AS target, round_even(0.06::DOUBLE + 0.16::DOUBLE * relevance, 6) AS weight FROM nodes
  UNION ALL SELECT * FROM (SELECT query_id, item_id, lead(item_id) OVER (PARTITION BY query_id, theme ORDER BY turn) AS target, 0.16::DOUBLE FROM nodes) WHERE target IS NOT NULL""", *SEARCH, NODES)))
def _(s, d):
    return R.graph_edges(R.graph_nodes(results(s, d)))


@query("d6_recommend_stack", (sql(NEED, """SELECT query_id, value, n, turn FROM (SELECT query_id, value, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank * 10 + pos)) AS turn FROM (
  SELECT query_id, rank, unnest([1, 2]) AS pos, unnest(tools) AS value FROM ranked) WHERE trim(value) <> '' GROUP BY query_id, value) WHERE turn <= 8""", *SEARCH)))
def _(s, d):
    return D.frequent_values(results(s, d), "tools")


SUMMARY = f"""summaries AS (SELECT query_id, n || ' results, mostly ' || array_to_string(themes[1:2], ' and ') || CASE WHEN strong > 0 THEN '; ' || strong || ' strong' ELSE '' END AS summary FROM (
  SELECT query_id, sum(n)::BIGINT AS n, sum(strong)::BIGINT AS strong, list(theme ORDER BY ord) AS themes FROM (SELECT query_id, {D.theme_sql()} AS theme, {D.theme_sql(place=True)} AS ord, count(*) AS n, count(*) FILTER (final >= 0.66) AS strong FROM ranked GROUP BY ALL) GROUP BY query_id))"""
CONFIDENCE = """confident AS (SELECT query_id, pct AS confidence, CASE WHEN best IS NULL THEN 'no matches' WHEN pct >= 70 THEN 'clear' WHEN pct >= 45 THEN 'add detail' ELSE 'too vague' END AS advice FROM (
  SELECT query_id, best, round_even(round_even(100 * (0.32::DOUBLE * greatest(0, least(1, (len(list_filter(regexp_extract_all(query, '[a-zA-Z0-9+.#-]+'), lambda w: length(w) > 2)) - 2)::DOUBLE / 7))
    + 0.30::DOUBLE * least(1, (len(frameworks) + len(tools) + len(tags) + CASE WHEN project_type <> 'general' THEN 1 ELSE 0 END)::DOUBLE / 5) + 0.38::DOUBLE * coalesce(best, 0)), 6), 0)::BIGINT AS pct
  FROM intents LEFT JOIN (SELECT query_id, avg(final) AS best FROM ranked WHERE rank <= 5 GROUP BY query_id) USING (query_id)))"""


@query("d22_landscape_summary", sql(NEED, "SELECT query_id, summary FROM summaries", *SEARCH, SUMMARY))
def _(s, d):
    return R.landscape_summary(results(s, d))


@query("i15_query_confidence", sql(NEED, "SELECT query_id, confidence, advice FROM confident", *SEARCH, CONFIDENCE))
def _(s, d):
    return R.query_confidence(search(s, d), intents(s, d))


@query("h28_why_relevant")
def _(s, d):
    return R.why_relevant(vec_leg(s, d).join(R.with_blob(X.items(s, d)), "item_id").join(R.asked(intents(s, d)), "query_id"))


@query("h29_rerank_blend", sql("items query_terms", "SELECT query_id, item_id, round_even(CASE WHEN rank <= 12 THEN 0.45::DOUBLE / (1 + exp(-(item_id % 7 - 3)::DOUBLE)) + (1 - 0.45::DOUBLE) * kw_rank ELSE kw_rank END, 6) AS blended FROM kw", POSTS, KW))
def _(s, d):
    rows = kw_leg(s, d).withColumn("logit", (F.col("item_id") % 7 - 3).cast("double"))
    return R.rerank_blend(rows, "logit", "kw_rank").select("query_id", "item_id", F.bround("blended", 6).alias("blended"))


@query("h26_presentation")
def _(s, d):
    items = X.items(s, d).withColumns({"underground": S.underground(now(), F.col("quality"), F.col("stars")), "source_url": F.concat(F.lit("https://github.com/o/r"), F.col("item_id").cast("string"))})
    return R.presentation(items)


@query("j12_mmr")
def _(s, d):
    return R.mmr(kw_leg(s, d).join(X.items(s, d).select("item_id", T.token_set().alias("tokens")), "item_id"))


def similar_queries(s, d):
    """Items whose id is divisible by 50 as descriptions of projects: (query_id, query, query_vector)."""
    rows = X.items(s, d, embedding=True).filter("item_id % 50 = 0")
    return rows.select(F.expr("item_id div 50").alias("query_id"), R.similar_text(F.col("title"), F.col("tools"), F.col("tags")).alias("query"), F.col("embedding").alias("query_vector"))


def similar(s, d):
    return search(s, d, asked=similar_queries(s, d))


_SIM_NEED = "items item_vectors"
SIMILAR = """queries AS (SELECT item_id // 50 AS query_id, concat_ws('. ', title, CASE WHEN len(list_filter(tools, lambda x: x IS NOT NULL)) > 0 THEN 'Stack: ' || array_to_string(tools, ', ') END, CASE WHEN len(list_filter(tags, lambda x: x IS NOT NULL)) > 0 THEN 'Features: ' || array_to_string(tags, ', ') END) AS query FROM items WHERE item_id % 50 = 0)"""
SIMILAR_VECTORS = "query_vectors AS (SELECT item_id // 50 AS query_id, embedding AS query_vector FROM item_vectors WHERE item_id % 50 = 0)"


@query("j14_find_similar", sql(_SIM_NEED, "SELECT query_id, rank, item_id, final, relevance, fused, total FROM ranked", SIMILAR, SIMILAR_VECTORS, *SEARCH))
def _(s, d):
    return similar(s, d)


@query("j15_landscape", sql(NEED, """SELECT query_id, coalesce(summary, '0 results') AS summary, confidence, advice, themes FROM confident LEFT JOIN summaries USING (query_id)
  LEFT JOIN (SELECT query_id, array_to_string(list(theme || ':' || n ORDER BY ord), ' ') AS themes FROM (SELECT query_id, """ + D.theme_sql() + " AS theme, " + D.theme_sql(place=True) + """ AS ord, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY query_id) USING (query_id)""", *SEARCH, SUMMARY, CONFIDENCE))
def _(s, d):
    found = written(s, results(s, d))
    return R.landscape(found, intents(s, d))[1].select("query_id", "summary", "confidence", "advice", F.array_join("themes", " ").alias("themes"))


@query("j15b_landscape_cards")
def _(s, d):
    return R.landscape(written(s, results(s, d)), intents(s, d))[0]


@query("k1_oracle_qrels", sql("items query_terms", "SELECT query_id, item_id, grade FROM qrels", QRELS))
def _(s, d):
    return qrels_of(s, d)


@query("c3_substring_grading", sql("items query_terms", "SELECT query_id, count(*) AS n, sum(grade)::BIGINT AS total FROM qrels GROUP BY query_id", QRELS))
def _(s, d):
    return qrels_of(s, d).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("grade").alias("total"))


@query("e7_relevant_set", sql("items query_terms", "SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS r FROM qrels) WHERE r <= 20", QRELS))
def _(s, d):
    return J.top_k(qrels_of(s, d), 20, [F.desc("grade"), "item_id"]).select("query_id", "item_id")


@query("c5_run_with_grades", sql("items query_terms", "SELECT run.query_id, run.item_id, rank, coalesce(grade, 0) AS grade FROM run LEFT JOIN qrels USING (query_id, item_id)", POSTS, KW, RUN, QRELS))
def _(s, d):
    return E.graded_run(kw_leg(s, d).select("query_id", "item_id", "rank"), qrels_of(s, d))


METRICS = """rated AS (SELECT run.*, coalesce(grade, 0) AS grade, count(*) FILTER (coalesce(grade, 0) > 0) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM run LEFT JOIN qrels USING (query_id, item_id)),
ideal AS (SELECT query_id, sum(grade / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS r FROM qrels) WHERE r <= 10 GROUP BY query_id),
relevant AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id),
metrics AS (SELECT query_id, round_even(coalesce(gain / ideal, 0), 6) AS ndcg, round_even(CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE coalesce(hits, 0)::DOUBLE / least(n, 10) END, 6) AS recall, round_even(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round_even(coalesce(prec / least(n, 10), 0), 6) AS map
  FROM queries LEFT JOIN (SELECT query_id, sum(grade / log2(rank + 1)) FILTER (rank <= 10) AS gain, count(*) FILTER (rank <= 10 AND grade > 0) AS hits, min(rank) FILTER (grade > 0) AS first, sum(so_far::DOUBLE / rank) FILTER (rank <= 10 AND grade > 0) AS prec FROM rated GROUP BY query_id) USING (query_id)
  LEFT JOIN ideal USING (query_id) LEFT JOIN relevant USING (query_id))"""
EVAL = ("items queries query_terms", POSTS, KW, RUN, QRELS, METRICS)


def metrics_of(s, d, run=None):
    return E.metrics(run if run is not None else kw_leg(s, d).select("query_id", "item_id", "rank"), qrels_of(s, d), X.queries(s, d))


for _name, _cols in (("d11_ndcg", "ndcg"), ("d12_recall", "recall"), ("d13_mrr_map", "mrr, map")):

    @query(_name, sql(EVAL[0], f"SELECT query_id, {_cols} FROM metrics", *EVAL[1:]))
    def _(s, d, c=tuple(_cols.split(", "))):
        return metrics_of(s, d).select("query_id", *c)


@query("d14_pool_diagnostics", sql(EVAL[0], "SELECT r.query_id, round_even(coalesce(p, 0)::DOUBLE / least(n, 20), 6) AS pool_recall, round_even(coalesce(t, 0)::DOUBLE / least(n, 10), 6) AS top_recall FROM relevant r LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 20) AS p, count(*) FILTER (rank <= 10) AS t FROM rated WHERE grade > 0 GROUP BY query_id) USING (query_id)", *EVAL[1:]))
def _(s, d):
    return E.pool_diagnostics(kw_leg(s, d).select("query_id", "item_id", "rank"), qrels_of(s, d))


@query("d15_gold_pass", sql(EVAL[0], """SELECT q.query_id, query_id % 3 = 0 OR coalesce(bool_or(contains(lower(title), 'the') OR contains(lower(title), 'ouer')), false) AS passed
  FROM queries q LEFT JOIN (SELECT query_id, title FROM run JOIN items USING (item_id) WHERE rank <= 5) USING (query_id) GROUP BY q.query_id""", *EVAL[1:]))
def _(s, d):
    hints = X.queries(s, d).select("query_id", F.when(F.col("query_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("the"), F.lit("Ouer"))).alias("hints"))
    return E.gold_pass(kw_leg(s, d), X.items(s, d).select("item_id", "title"), hints)


@query("d16_category_means", sql(EVAL[0], "SELECT query_id % 4 AS category, round_even(avg(ndcg), 5) AS ndcg, round_even(avg(recall), 5) AS recall FROM metrics GROUP BY 1", *EVAL[1:]))
def _(s, d):
    rows = metrics_of(s, d).groupBy((F.col("query_id") % 4).alias("category"))
    return rows.agg(F.bround(F.avg("ndcg"), 5).alias("ndcg"), F.bround(F.avg("recall"), 5).alias("recall"))


SHARE = lambda *p: "('0x' || substring(md5(" + " || ':' || ".join(p) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
DRAWN = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in E.DRAWS)


@query("d17_bootstrap_interval", sql(EVAL[0], f"""SELECT round_even((SELECT avg(ndcg) FROM metrics), 6) AS mean, round_even(o[51], 6) AS low, round_even(o[1950], 6) AS high FROM (SELECT list(m ORDER BY m) AS o FROM (
  SELECT i, round_even(sum(w * ndcg) / sum(w), 9) AS m FROM (SELECT *, {DRAWN} AS w FROM (SELECT i, ndcg, {SHARE("'13'", "i", "query_id")} AS u FROM metrics, range(2000) t(i))) GROUP BY i))""", *EVAL[1:]))
def _(s, d):
    return E.bootstrap_interval(metrics_of(s, d), "ndcg")


RUN2 = "run AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item_id) AS rank FROM fused)"


def fused_run(s, d, legs=None):
    return J.top_k(J.rrf(legs if legs is not None else all_legs(s, d)), 100, [F.desc("fused"), "item_id"]).select("query_id", "item_id", "rank")


def two_metrics(s, d):
    """The metrics of the keyword leg and of the fused run."""
    legs = all_legs(s, d)
    qrels = written(s, qrels_of(s, d))
    # written, as comparisons read them several times
    return tuple(written(s, E.metrics(run, qrels, X.queries(s, d))) for run in (legs["keyword"].select("query_id", "item_id", "rank"), fused_run(s, d, legs)))


#: The metrics of the keyword leg and of the fused run, side by side.
RUNS = (*LEGS, RRF, RUN, QRELS, METRICS, "run2 AS (SELECT * FROM (" + RUN2[8:-1] + ") WHERE rank <= 100)", *[m.replace("rated", "rated2").replace("FROM run ", "FROM run2 run ").replace("metrics AS", "metrics2 AS").replace("ideal AS (", "ideal2 AS (").replace("relevant AS (", "relevant2 AS (") for m in (METRICS,)])


@query("d18_paired_test", sql(NEED, f"""SELECT n, round_even(mean, 6) AS mean_diff, round_even(mean / (sd / sqrt(n)), 6) AS t, (SELECT avg(CASE WHEN abs(m) >= abs(mean) - 1e-12 THEN 1.0::DOUBLE ELSE 0 END) FROM (
  SELECT i, avg(CASE WHEN {SHARE("'17'", "i", "query_id")} < 0.5 THEN diff ELSE -diff END) AS m FROM diffs, range(1, 2001) t(i) GROUP BY i)) AS p_value FROM (SELECT count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd FROM diffs)""", *RUNS, "diffs AS (SELECT query_id, b.ndcg - a.ndcg AS diff FROM metrics a JOIN metrics2 b USING (query_id))"))
def _(s, d):
    return E.paired_test(*two_metrics(s, d), "ndcg")


@query("d19_regression_guard", sql(NEED, """SELECT 'ndcg fell' AS reason WHERE (SELECT round_even(avg(ndcg), 6) FROM metrics2) < (SELECT round_even(avg(ndcg), 6) FROM metrics)
  UNION ALL SELECT 'recall fell' WHERE (SELECT round_even(avg(recall), 6) FROM metrics2) < (SELECT round_even(avg(recall), 6) FROM metrics) - 0.02::DOUBLE
  UNION ALL SELECT 'query ' || query_id || ' fell' FROM metrics a JOIN metrics2 b USING (query_id) WHERE round_even(a.ndcg - b.ndcg, 6) > 0.15::DOUBLE""", *RUNS))
def _(s, d):
    return E.regression_guard(*two_metrics(s, d))


@query("k2_evaluate", sql(NEED, "SELECT 'fused' AS config, query_id, ndcg, recall, mrr, map FROM metrics", *LEGS, RRF, "run AS (SELECT * FROM (" + RUN2[8:-1] + ") WHERE rank <= 100)", QRELS, METRICS))
def _(s, d):
    return E.metrics(fused_run(s, d).withColumn("config", F.lit("fused")), qrels_of(s, d), X.queries(s, d), by=("config",))


PARAMS = E.param_sets()
_P = list(E.KNOBS)
SWEEP = f"""params AS (SELECT * FROM (VALUES {', '.join('(' + str(i) + '::BIGINT, ' + ', '.join(f'{v}::DOUBLE' for v in p) + ')' for i, p in enumerate(PARAMS))}) v(param, {', '.join('p_' + k for k in _P)})),
base AS (SELECT query_id, item_id, kw_rank, similarity, arrival, relevance, lower(title) AS key, remix / 100 AS remix, quality / 100 AS quality, {UNDER} / 100 AS underground, {REC} AS recency, popularity / 100 AS popularity, {SUBST} AS substance, hype / 100 AS hype FROM rel JOIN aged USING (item_id)),
legs AS (SELECT query_id, item_id, max(k) AS r_k, max(v) AS r_v, max(i) AS r_i FROM (SELECT query_id, item_id, rank AS k, NULL AS v, NULL AS i FROM kw UNION ALL SELECT query_id, item_id, NULL, rank, NULL FROM vec UNION ALL SELECT query_id, item_id, NULL, NULL, rank FROM intent) GROUP BY query_id, item_id),
tried AS (SELECT param, query_id, item_id, key, arrival, round_even(greatest(0.0, least(1.0, p_w_fused * least(1.0::DOUBLE, 45 * round_even(coalesce(p_keyword / (p_rrf_k + r_k), 0) + coalesce(p_vector / (p_rrf_k + r_v), 0) + coalesce(p_intent / (p_rrf_k + r_i), 0), 9))
    + p_w_relevance * relevance + p_w_remix * remix + p_w_quality * quality + p_w_underground * underground + p_w_recency * recency + p_w_popularity * popularity + p_w_substance * substance - p_w_hype * hype)), 9) AS final,
    relevance >= p_min_relevance OR coalesce(kw_rank, 0) >= 0.08 OR coalesce(similarity, 0) >= p_min_similarity AS evidence, p_min_final FROM base JOIN legs USING (query_id, item_id), params WHERE query_id IN (SELECT query_id FROM qrels)),
open AS (SELECT * FROM (SELECT *, final >= p_min_final AND evidence AS ok, count(*) FILTER (final >= p_min_final AND evidence) OVER (PARTITION BY param, query_id) AS n_ok, row_number() OVER (PARTITION BY param, query_id ORDER BY arrival) AS early FROM tried) WHERE CASE WHEN n_ok < 3 THEN early <= 20 ELSE ok END),
firsts AS (SELECT param, query_id, item_id, row_number() OVER (PARTITION BY param, query_id ORDER BY final DESC, item_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY param, query_id, key ORDER BY final DESC, arrival) AS best FROM open) WHERE best = 1),
sweep AS (SELECT p.param, q.query_id, round_even(coalesce(gain / ideal, 0), 6) AS ndcg FROM params p CROSS JOIN queries q LEFT JOIN ideal USING (query_id) LEFT JOIN (SELECT param, query_id, sum(grade / log2(rank + 1)) AS gain FROM firsts JOIN qrels USING (query_id, item_id) WHERE rank <= 10 GROUP BY param, query_id) g ON g.param = p.param AND g.query_id = q.query_id)"""
SWEPT = (*HITS, AGED, RUN, QRELS, METRICS, SWEEP)


def sweep(s, d):
    score = {c: S.normalize_score(F.col(c)) for c in ("remix", "quality", "popularity", "hype")}
    rows = hits(s, d).withColumns({"underground": S.underground(now(), F.col("quality"), F.col("stars")) / 100, "recency": S.recency(F.col("published_at"), now()), "substance": S.substance(), "key": T.normalize_query(F.lower("title"))}).withColumns(score)
    # hits and grades are read twice
    rows = written(s, rows.select("query_id", "item_id", "arrival", "key", "kw_rank", "similarity", "ranks", *E.SWEPT))
    return E.param_sweep(rows, PARAMS, written(s, qrels_of(s, d)), X.queries(s, d))


@query("k3_param_sweep", sql(NEED, "SELECT param, round_even(avg(ndcg), 4) AS ndcg FROM sweep GROUP BY param", *SWEPT))
def _(s, d):
    return sweep(s, d).groupBy("param").agg(F.bround(F.avg("ndcg"), 4).alias("ndcg"))


FOLDS = f"folds AS (SELECT query_id, floor({SHARE(chr(39) + '7' + chr(39), 'query_id')} * 5)::BIGINT AS fold FROM queries)"


@query("k4_nested_cv", sql(NEED, """SELECT fold, param, train, held_out, baseline FROM (SELECT *, max(CASE WHEN param = 0 THEN held_out END) OVER (PARTITION BY fold) AS baseline, row_number() OVER (PARTITION BY fold ORDER BY train DESC, param) AS turn FROM (
  SELECT param, fold, round_even((sum(s) OVER (PARTITION BY param) - s) / (sum(n) OVER (PARTITION BY param) - n), 6) AS train, round_even(s / n, 6) AS held_out FROM (SELECT param, fold, sum(ndcg) AS s, count(*) AS n FROM sweep JOIN folds USING (query_id) GROUP BY param, fold))) WHERE turn = 1""", *SWEPT, FOLDS))
def _(s, d):
    return E.nested_cv(sweep(s, d), E.folds(X.queries(s, d)))


@query("e8_folds", sql("queries", "SELECT query_id, fold FROM folds", FOLDS))
def _(s, d):
    return E.folds(X.queries(s, d))


@query("a13_qrels_snapshot", sql("items query_terms", "SELECT query_id, count(*) AS n_relevant, max(grade) AS best, (SELECT count(*) FROM items) AS n_items FROM qrels GROUP BY query_id", QRELS))
def _(s, d):
    return L.qrels_snapshot(qrels_of(s, d), X.items(s, d))


@query("d21_best_item", sql("items query_terms", "SELECT query_id, item_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS r FROM qrels) WHERE r = 1", QRELS))
def _(s, d):
    return L.best_items(qrels_of(s, d))


TRIPLETS = """triplets AS (SELECT query_id, pos, item_id AS neg, turn FROM (SELECT p.query_id, p.item_id AS pos, s.item_id, row_number() OVER (PARTITION BY p.query_id, p.item_id ORDER BY s.similarity DESC, s.item_id) AS turn
  FROM (SELECT query_id, item_id, similarity FROM vec WHERE rank <= 3) p JOIN sims s ON s.query_id = p.query_id AND s.similarity < 0.95::DOUBLE * p.similarity WHERE (s.query_id, s.item_id) NOT IN (SELECT (query_id, item_id) FROM vec WHERE rank <= 3)) WHERE turn <= 5)"""


@query("k10_mine_triplets", sql("query_vectors item_vectors", "SELECT query_id, pos, neg, turn FROM triplets", SIM, VEC, TRIPLETS))
def _(s, d):
    positives = written(s, vec_leg(s, d).filter("rank <= 3").select("query_id", "item_id", "similarity"))
    return L.mine_triplets(positives, X.query_vectors(s, d), vectors(s, d))


_FEATURES = {"relevance": "relevance", "fused_share": "least(1.0::DOUBLE, 45 * fused)", "kw_rank": "coalesce(kw_rank, 0)", "similarity": "coalesce(similarity, 0)", "remix": "remix / 100", "quality": "quality / 100", "underground": f"{UNDER} / 100", "recency": REC, "popularity": "popularity / 100", "substance": SUBST, "hype": "hype / 100", "has_code": "has_code::DOUBLE"}


@query("k5_ltr_features", sql(NEED, "SELECT query_id, item_id, " + ", ".join(f"round_even({v}, 6) AS {k}" for k, v in _FEATURES.items()) + " FROM rel JOIN aged USING (item_id)", *HITS, AGED))
def _(s, d):
    return L.ltr_features(hits(s, d), now()).select("query_id", "item_id", *[F.bround(c, 6).alias(c) for c in L.FEATURES])


@query("k7_apply_ranker")
def _(s, d):
    rows = written(s, L.ltr_features(hits(s, d), now()))
    model = L.train_ranker(rows, written(s, qrels_of(s, d)))
    return L.apply_ranker(rows, model).select("query_id", "item_id", "rank", F.bround("score", 4).alias("score"))


@query("k6_train_ranker")
def _(s, d):
    rows, qrels = written(s, L.ltr_features(hits(s, d), now())), written(s, qrels_of(s, d))
    return L.cross_validate(rows, qrels, X.queries(s, d))


@query("k6b_listwise_trees")
def _(s, d):
    rows, qrels = written(s, L.ltr_features(hits(s, d), now())), written(s, qrels_of(s, d))
    return L.cross_validate_trees(rows, qrels, written(s, X.queries(s, d)), lambda df: written(s, df))[0]


@query("u1_encode", """SELECT doc_id, n_tokens, slot, round_even((c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM (SELECT doc_id, slot, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS n_tokens FROM (
  SELECT doc_id, ('0x' || substring(md5(unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+.#-]*|[0-9]+[a-z]*'))), 1, 8))::BIGINT % 64 AS slot FROM documents) GROUP BY doc_id, slot)""")
def _(s, d):
    rows = L.hashed_vector(X.table(s, d, "documents").select("doc_id", "text"), "text", 64)
    parts = rows.select("doc_id", "n_tokens", F.posexplode("embedding").alias("slot", "value")).filter("value > 0")
    return parts.select("doc_id", "n_tokens", F.col("slot").cast("bigint").alias("slot"), F.bround(F.col("value").cast("double"), 5).alias("value"))


@query("k12_embed_items")
def _(s, d):
    return L.embed_missing(X.items(s, d, embedding=True).select("item_id", "summary", "embedding"), "summary").select("item_id", "filled", F.size("embedding").alias("size"))


@query("u2_rerank_pairs")
def _(s, d):
    rows = J.top_k(kw_leg(s, d), 12, ["rank"], rank="r2").join(X.queries(s, d), "query_id").join(X.items(s, d).select("item_id", "summary"), "item_id")
    return L.rerank_pairs(rows, L.overlap_logit)

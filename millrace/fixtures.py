"""Search tables derived from the given ones, as DataFrames and as the same rules in SQL.

The driver's tables have no catalogue of items, so documents, embeddings and pages are read as one, the
benchmark as queries, and events as usage. All of it is row-wise or one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
#: Every row whose id is divisible by this is a query vector.
VECTOR_STEP = 50
#: Endings that give the invented words of the queries something to ask for, by query_id.
PHRASES = (
    "", "rag chrome extension for research papers in typescript", "lecture summarizer with quiz", "mcp server for code review in python", "webcam posture with mediapipe",
    "saas billing with next.js and repos", "arxiv pdf retrieval with embeddings", "chrome extension architecture", "open source library for k8s", "go api",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The first words of nearly all texts are among so many characters; only of the others the whole is split.
HEAD = 400


def words(c, first: int | None = None):
    """The words of a text; with `first` so many at least, and the rest of a long text as one, or none of it."""
    c = F.col(c) if isinstance(c, str) else c
    split = lambda x: F.filter(F.split(x, "[ \t\n\r]+", first + 2 if first else -1), lambda x: x != "")
    if not first:
        return split(c)
    # a word that another one follows is whole
    head = split(F.substring(c, 1, HEAD))
    return F.when(F.size(head) > first, head).otherwise(split(c))


def items(spark: SparkSession, sf_dir: str, embedding: bool = False, url: bool = False) -> DataFrame:
    d = F.col("doc_id")
    w = words("text", 6)
    out = table(spark, sf_dir, "documents").select(
        d.alias("item_id"),
        F.array_join(F.slice(w, 1, 6), " ").alias("title"),
        F.substring("text", 1, 280).alias("summary"),
        F.array("lang", "source").alias("tags"),
        F.array("source", F.lower(F.try_element_at(w, F.lit(1)))).alias("tools"),
        F.array(F.lower(F.try_element_at(w, F.lit(2)))).alias("frameworks"),
        F.array("lang").alias("languages"),
        F.substring("text", 281, 50).alias("use_case"),
        F.expr("substring(text, 331)").alias("core"),
        (d % 3 == 0).alias("has_code"),
        (d % 5 == 0).alias("has_demo"),
        (d % 7 == 0).alias("has_paper"),
        (d % 2 == 0).alias("has_docs"),
        F.when(d % 4 == 0, "MIT").when(d % 4 == 1, "GPL").alias("license"),
        F.when(d % 6 == 0, F.array(F.lit("pip install x"))).otherwise(F.array().cast("array<string>")).alias("commands"),
        F.element_at(F.array(*map(F.lit, ("open_source_project", "research_paper", "model", "starter_template", "mcp_server"))), (d % 5 + 1).cast("int")).alias("artifact_type"),
        F.concat(F.lit("src"), (d % 5).cast("string")).alias("source_type"),
        F.when(d % 9 != 0, (d * 13) % 3000).alias("stars"),
        ((d * 37) % 101).cast("double").alias("popularity"),
        ((d * 53) % 101).cast("double").alias("quality"),
        ((d * 29) % 101).cast("double").alias("hype"),
        ((d * 41) % 101).cast("double").alias("remix"),
        F.dateadd(F.lit("2024-02-01").cast("date"), (-((d * 7) % 240)).cast("int")).cast("timestamp").alias("published_at"),
    )
    if embedding:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
        out = out.join(e, "item_id", "left")
    if url:
        pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url"))
        n = pages.agg(F.count("*").alias("n_pages"))
        keyed = out.join(F.broadcast(n)).withColumn("page_id", F.expr("item_id % n_pages"))
        out = keyed.join(pages, "page_id", "left").drop("page_id", "n_pages")
    return out


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("item_id") % len(PHRASES) + 1).cast("int"))
    asked = F.trim(F.concat_ws(" ", F.array_join(F.slice(words("text"), 1, 12), " "), ending))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("query"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9+.#-]*|[0-9]+[a-z]*)"), 1)
    out = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(token)).alias("term"))
    return out.filter(F.length("term") >= 5)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").filter(v % VECTOR_STEP == 0).select(F.expr(f"vec_id div {VECTOR_STEP}").alias("query_id"), F.col("embedding").alias("query_vector"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "purchase", "star")
    return (
        table(spark, sf_dir, "events")
        .join(F.broadcast(n))
        .select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            kind.alias("kind"),
            F.col("user_id").alias("query_id"),
            (F.get_json_object("props", "$.k").cast("bigint") % 20).alias("position"),
            ((F.col("event_id") * 31) % F.col("n_docs")).alias("item_id"),
        )
        .filter("kind IS NOT NULL")
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a search and shown position, 0 to 19."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    shown = usage(spark, sf_dir).filter("kind = 'search'").join(F.broadcast(n))
    return shown.select("event_id", "ts", "query_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("pos"), F.col("item_id").alias("first"), "n_docs").select(
        "event_id", "ts", "query_id", "pos", ((F.col("first") + 7 * F.col("pos")) % F.col("n_docs")).alias("item_id")
    )


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source_type"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "running").otherwise("done").alias("status"),
        F.col("ts").cast("timestamp").alias("finished_at"),
        (F.get_json_object("props", "$.k").cast("bigint") % 7).alias("found"),
        "event_id",
    )


#: name -> the same rule in SQL, as a common table expression.
SQL = {
    "items": r"""items AS (
  SELECT doc_id AS item_id, array_to_string(w[1:6], ' ') AS title, substring(text, 1, 280) AS summary, [lang, source] AS tags,
         [source, lower(w[1])] AS tools, [lower(w[2])] AS frameworks, [lang] AS languages, substring(text, 281, 50) AS use_case, substring(text, 331) AS core,
         doc_id % 3 = 0 AS has_code, doc_id % 5 = 0 AS has_demo, doc_id % 7 = 0 AS has_paper, doc_id % 2 = 0 AS has_docs,
         CASE WHEN doc_id % 4 = 0 THEN 'MIT' WHEN doc_id % 4 = 1 THEN 'GPL' END AS license,
         CASE WHEN doc_id % 6 = 0 THEN ['pip install x'] ELSE []::VARCHAR[] END AS commands,
         ['open_source_project', 'research_paper', 'model', 'starter_template', 'mcp_server'][doc_id % 5 + 1] AS artifact_type, 'src' || (doc_id % 5) AS source_type,
         CASE WHEN doc_id % 9 <> 0 THEN (doc_id * 13) % 3000 END AS stars,
         ((doc_id * 37) % 101)::DOUBLE AS popularity, ((doc_id * 53) % 101)::DOUBLE AS quality, ((doc_id * 29) % 101)::DOUBLE AS hype, ((doc_id * 41) % 101)::DOUBLE AS remix,
         (DATE '2024-02-01' - ((doc_id * 7) % 240)::INTEGER)::TIMESTAMP AS published_at
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents))""",
    "item_vectors": "item_vectors AS (SELECT vec_id AS item_id, embedding FROM embeddings JOIN documents ON vec_id = doc_id)",
    "item_urls": "item_urls AS (SELECT doc_id AS item_id, url AS source_url FROM documents LEFT JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages))",
    "queries": r"""queries AS (
  SELECT item_id AS query_id, trim(array_to_string((list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''))[1:12], ' ') || ' ' || (@phrases@)[item_id % @n@ + 1]) AS query FROM benchmark)""".replace("@phrases@", str(list(PHRASES))).replace("@n@", str(len(PHRASES))),
    "query_terms": r"""query_terms AS (
  SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+.#-]*|[0-9]+[a-z]*')) AS term FROM benchmark) WHERE length(term) >= 5)""",
    "query_vectors": f"query_vectors AS (SELECT vec_id // {VECTOR_STEP} AS query_id, embedding AS query_vector FROM embeddings WHERE vec_id % {VECTOR_STEP} = 0)",
    "usage": """usage AS (
  SELECT * FROM (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'star' END AS kind,
         user_id AS query_id, CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS position, (event_id * 31) % (SELECT count(*) FROM documents) AS item_id FROM events) WHERE kind IS NOT NULL)""",
    "impressions": """impressions AS (
  SELECT event_id, ts, query_id, pos, (item_id + 7 * pos) % (SELECT count(*) FROM documents) AS item_id FROM usage CROSS JOIN (SELECT unnest(range(20)) AS pos) WHERE kind = 'search')""",
    "ledger": """ledger AS (
  SELECT 'src' || (user_id % 5) AS source_type, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'done' END AS status, ts AS finished_at,
         CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS found, event_id FROM events)""",
}


def sql(needs: str, body: str, *more: str) -> str:
    """SQL over the named fixtures; `more` are further common table expressions."""
    parts = [SQL[n] for n in needs.split()] + list(more)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

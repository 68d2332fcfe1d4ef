"""Raw feeds to item rows: code repositories, forum posts, papers, articles and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scores as S
from millrace.functions import text as T

REPO = "full_name string, html_url string, description string, language string, pushed_at string, stargazers_count int, forks_count int, archived boolean, topics array<string>, license struct<spdx_id:string>, owner struct<login:string, html_url:string>, readme string"
POST = "objectID string, title string, url string, points int, created_at string, author string"
MODEL = "id string, downloads bigint, likes int, pipeline_tag string, tags array<string>, lastModified string"
ENTRY = "entry array<struct<id:string, title:string, summary:string, published:string>>"
RSS = "channel struct<item:array<struct<title:string, link:string, description:string, pubDate:string>>>"
ATOM = "entry array<struct<title:string, link:struct<_href:string>, summary:string, updated:string>>"

#: Most that can be remixed of a paper with and without code, and least hype.
CODE_CAP, PAPER_CAP, HYPE_FLOOR = 70.0, 45.0, 25.0
#: What a model's task helps to build.
TASKS = {
    "text-generation": "Generate text with a language model.",
    "text-classification": "Classify text into labels.",
    "summarization": "Summarise long text.",
    "translation": "Translate between languages.",
    "question-answering": "Answer questions from a text.",
    "feature-extraction": "Turn text into vectors for search.",
    "sentence-similarity": "Compare sentences by meaning.",
    "fill-mask": "Fill gaps in text.",
    "token-classification": "Tag words in text.",
    "image-classification": "Classify images.",
    "object-detection": "Find objects in images.",
    "image-segmentation": "Cut images into regions.",
    "text-to-image": "Make images from text.",
    "automatic-speech-recognition": "Turn speech into text.",
    "text-to-speech": "Turn text into speech.",
}


def _text(c: str, limit: int = 8000) -> Column:
    return T.truncate(T.clean_text(F.substring(F.col(c), 1, 3 * limit)), limit)


def map_code_repos(raw: DataFrame, column: str = "value") -> DataFrame:
    """Repository payloads with their README to items; archived ones go."""
    r = raw.select(F.from_json(column, REPO).alias("r")).select("r.*").filter("html_url IS NOT NULL AND NOT coalesce(archived, false)")
    readme = F.coalesce("readme", F.lit(""))
    return r.select(
        T.canonical_url(F.col("html_url")).alias("canonical_url"),
        F.col("full_name").alias("title"),
        F.coalesce(F.nullif("description", F.lit("")), T.first_paragraph(readme), F.lit("")).alias("summary"),
        F.slice(T.distinct_keep_order(T.normalize_topics(F.coalesce("topics", F.array().cast("array<string>")))), 1, 30).alias("tags"),
        F.filter(F.array("language"), lambda x: x.isNotNull()).alias("languages"),
        T.setup_commands(readme).alias("commands"),
        F.lit(True).alias("has_code"),
        (F.length(_text("readme")) > 400).alias("has_docs"),
        F.col("license.spdx_id").alias("license"),
        F.col("stargazers_count").alias("stars"),
        S.popularity(F.col("stargazers_count"), F.col("forks_count")).alias("popularity"),
        T.parse_date(F.col("pushed_at")).alias("published_at"),
        F.lit("code").alias("source_type"),
    )


def map_forum_posts(raw: DataFrame, column: str = "value", min_points: int = 3) -> DataFrame:
    r = raw.select(F.from_json(column, POST).alias("r")).select("r.*").filter((F.coalesce("points", F.lit(0)) >= min_points) & (F.coalesce("title", F.lit("")) != "") & F.col("url").isNotNull())
    return r.select(
        T.canonical_url(F.col("url")).alias("canonical_url"),
        "title",
        F.col("title").alias("summary"),
        F.contains("url", F.lit("github.com")).alias("has_code"),
        F.least(F.lit(100), F.coalesce("points", F.lit(0))).cast("double").alias("popularity"),
        T.parse_date(F.col("created_at")).alias("published_at"),
        F.lit("forum").alias("source_type"),
    )


def map_papers(raw: DataFrame, column: str = "value") -> DataFrame:
    """Atom entries of a paper feed to items with their scores; what can be remixed is capped, lower without code, and some hype is assumed."""
    e = raw.select(F.explode(F.from_xml(column, ENTRY)["entry"]).alias("e")).select("e.*")
    code = F.lower("summary").rlike("github\\.com|code is available|open-source")
    rows = e.filter("id IS NOT NULL").select(
        T.canonical_url(F.col("id")).alias("canonical_url"),
        T.normalize_query(F.col("title")).alias("title"),
        T.normalize_query(F.col("summary")).alias("summary"),
        code.alias("has_code"),
        F.lit(True).alias("has_paper"),
        T.parse_date(F.col("published")).alias("published_at"),
        F.lit("paper").alias("source_type"),
        F.lit("research_paper").alias("artifact_type"),
    )
    none = F.array().cast("array<string>")
    blank = {c: none for c in ("tags", "tools", "frameworks", "languages", "commands")} | {c: F.lit("") for c in ("use_case", "license")} | {c: F.lit(False) for c in ("has_demo", "has_docs")}
    full = rows.withColumns(blank | {"core": F.col("summary")})
    remix = F.least(S.remixability(), F.when(F.col("has_code"), F.lit(CODE_CAP)).otherwise(F.lit(PAPER_CAP)))
    return full.withColumns({"quality": S.quality(), "remix": remix, "hype": F.greatest(S.hype_risk(), F.lit(HYPE_FLOOR))})


def map_feed_articles(raw: DataFrame, column: str = "value") -> DataFrame:
    """RSS items and Atom entries to items; those without a link or a title go."""
    rss = raw.select(F.explode(F.from_xml(column, RSS)["channel"]["item"]).alias("e")).select("e.title", "e.link", F.col("e.description").alias("body"), F.col("e.pubDate").alias("date"))
    atom = raw.select(F.explode(F.from_xml(column, ATOM, {"attributePrefix": "_"})["entry"]).alias("e")).select("e.title", F.col("e.link._href").alias("link"), F.col("e.summary").alias("body"), F.col("e.updated").alias("date"))
    both = rss.unionByName(atom).filter("coalesce(title, '') <> '' AND coalesce(link, '') <> ''")
    return both.select(
        T.canonical_url(F.col("link")).alias("canonical_url"),
        T.strip_html(F.col("title")).alias("title"),
        T.truncate(T.strip_html(F.col("body")), 600).alias("summary"),
        T.parse_date(F.col("date")).alias("published_at"),
        F.lit("feed").alias("source_type"),
    )


def map_models(raw: DataFrame, column: str = "value") -> DataFrame:
    r = raw.select(F.from_json(column, MODEL).alias("r")).select("r.*").filter("id IS NOT NULL")
    helps = F.create_map(*[F.lit(x) for pair in TASKS.items() for x in pair])
    return r.select(
        T.canonical_url(F.concat(F.lit("https://models.example.org/"), F.col("id"))).alias("canonical_url"),
        F.col("id").alias("title"),
        F.coalesce(F.element_at(helps, F.col("pipeline_tag")), F.lit("Use a trained model.")).alias("summary"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        S.popularity(F.col("downloads"), kind="log").alias("popularity"),
        T.parse_date(F.col("lastModified")).alias("published_at"),
        F.lit("model").alias("source_type"),
    )

"""Filters, gates and projections over item tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scores as S
from millrace.functions import text as T
from millrace.operators import grid


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def facets(items: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows whose array columns hold any of the wanted values, in every facet; case counts."""
    for column, values in wanted.items():
        items = items.filter(F.arrays_overlap(column, F.array(*map(F.lit, values))))
    return items


def equals(items: DataFrame, **values) -> DataFrame:
    for column, value in values.items():
        items = items.filter(F.col(column) == F.lit(value))
    return items


def ranges(items: DataFrame, min_quality: float | None = None, max_hype: float | None = None) -> DataFrame:
    if min_quality is not None:
        items = items.filter(F.col("quality") >= min_quality)
    return items.filter(F.col("hype") <= max_hype) if max_hype is not None else items


def any_element(term: str, *columns: str) -> Column:
    return _any(F.exists(c, lambda x: F.lower(x) == term.lower()) for c in columns)


def any_substring(terms: list[str], *columns: str) -> Column:
    """Plain substrings: % and _ stand for themselves."""
    return _any(F.contains(F.lower(c), F.lit(t.lower())) for c in columns for t in terms)


def heuristic_gate(signal: tuple[str, ...], noise: tuple[str, ...] | None = None, least: int = 60) -> Column:
    """Enough text, no title of NOISE_TITLES (or of `noise`), and a stack, a tag or code."""
    text = F.trim(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in signal]))
    stack = _any(S.filled(c) for c in ("frameworks", "tools", "languages", "tags")) | F.coalesce("has_code", F.lit(False))
    quiet = F.coalesce(any_substring(list(NOISE_TITLES if noise is None else noise), "title"), F.lit(False))
    return (F.length(text) >= least) & ~quiet & stack


def semantic_gate(candidates: DataFrame, queries: DataFrame, least: float = 0.22) -> DataFrame:
    """Candidates (query_id, item_id, embedding) that are near enough to the query that found them, with their similarity.

    Where the candidate or its query has no vector, nothing can be said and the candidate passes with 0. One
    join on the query, and a cosine a row.
    """
    asked = queries.select("query_id", "query_vector")
    sim = F.bround(T.cosine(F.transform("query_vector", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double"))), 6)
    unknown = F.col("query_vector").isNull() | F.col("embedding").isNull() | (F.size("query_vector") == 0) | (F.size("embedding") == 0)
    judged = candidates.join(asked, "query_id", "left").withColumn("similarity", F.when(unknown, 0.0).otherwise(sim))
    return judged.filter(unknown | (F.col("similarity") >= least)).select("query_id", "item_id", "similarity")


def near_pairs(queries: DataFrame, items: DataFrame, least: float = 0.22) -> DataFrame:
    """(query_id, item_id, similarity): every query with every item that is near enough; rows without a vector have no pair.

    There are as many pairs as there are; tasks hold a block of each side and give their pairs on (`grid.meet`).
    """
    asked = queries.filter("query_vector IS NOT NULL").select("query_id", "query_vector")
    held = items.filter("embedding IS NOT NULL").select("item_id", "embedding")
    return grid.meet(asked, held, lambda: grid.Above(least), "query_id bigint, item_id bigint, similarity double")


#: Parts of titles that say a row is nothing to build on.
NOISE_TITLES = (
    "test", "demo-repo", "hello-world", "my-portfolio", "config", "dotfiles", "interview", "leetcode", "assignment", "homework", "tutorial-",
    "awesome-", "cheatsheet", "cheat-sheet", "roadmap", "course", "bootcamp", "interview-questions", "study-notes", "list of",
)


def prefilter(items: DataFrame, drop_flags: list[str], min_stars: int, min_summary: int) -> DataFrame:
    for flag in drop_flags:
        items = items.filter(~F.coalesce(F.col(flag), F.lit(False)))
    return items.filter(~((F.coalesce("stars", F.lit(0)) < min_stars) & (F.length("summary") < min_summary)))


def min_points(items: DataFrame, column: str, least: int, required: list[str]) -> DataFrame:
    for c in required:
        items = items.filter(F.col(c) != "")
    return items.filter(F.coalesce(column, F.lit(0)) >= least)


def result_gate(hits: DataFrame, limit: int = 10, final: float = 0.19, relevance: float = 0.11, keyword: float = 0.08, similarity: float = 0.43) -> DataFrame:
    """Hits (query_id, item_id, arrival, final, relevance, kw_rank, similarity) that pass; where fewer than
    min(3, limit) of a query do, its first max(limit, 3) by arrival instead."""
    evidence = (F.col("relevance") >= relevance) | (F.coalesce("kw_rank", F.lit(0.0)) >= keyword) | (F.coalesce("similarity", F.lit(0.0)) >= similarity)
    per_query = Window.partitionBy("query_id")
    marked = hits.withColumn("ok", (F.col("final") >= final) & evidence)
    marked = marked.withColumns({"n_ok": F.count_if("ok").over(per_query), "turn": F.row_number().over(per_query.orderBy("arrival"))})
    few = F.col("n_ok") < min(3, limit)
    return marked.filter(F.when(few, F.col("turn") <= max(limit, 3)).otherwise(F.col("ok"))).drop("ok", "n_ok", "turn")


def public_row(items: DataFrame, **defaults) -> DataFrame:
    """The item without its vector, nulls replaced by the given defaults."""
    return items.drop("embedding").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def first_by_key(rows: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*arrival))
    return rows.withColumn("turn", turn).filter("turn = 1").drop("turn")


def text_blob() -> Column:
    lists = [F.array_join(c, " ") for c in ("tags", "tools", "frameworks", "languages")]
    return F.lower(F.concat_ws(" ", "title", "summary", "use_case", "core", *lists, "artifact_type"))


def infer_type() -> Column:
    t = F.lower(F.concat_ws(" ", "title", "summary"))
    says = lambda w: F.contains(t, F.lit(w))
    return (
        F.when(says("arxiv") | F.col("has_paper"), "paper")
        .when(says("mcp"), "mcp_server")
        .when(says("model"), "model")
        .when(says("tutor"), "tutorial")
        .when(F.col("has_demo"), "demo")
        .when(F.col("has_code"), "repository")
        .when(says("the"), "article")
        .otherwise("project")
    )


#: Words that show what a project is about.
SIGNS = {
    "rag": ("rag", "retrieval", "vector"),
    "browser": ("chrome", "extension"),
    "paper": ("paper", "arxiv", "pdf", "research"),
    "lecture": ("lecture", "quiz", "flashcard", "video summarizer"),
    "agent": ("mcp", "coding agent", "claude code", "cursor"),
    "vision": ("computer vision", "posture", "pose", "webcam"),
}


def project_type(text: Column) -> Column:
    """The type with most points; equal ones in the order in which they are scored."""
    low = F.lower(text)
    has = {k: _any(F.contains(low, F.lit(w)) for w in words) for k, words in SIGNS.items()}
    return (
        F.when(has["rag"] & has["browser"] & has["paper"], "rag_browser_research")
        .when(has["lecture"], "education_media")
        .when(has["agent"], "coding_agent_tooling")
        .when(has["vision"], "computer_vision")
        .when(has["rag"] & has["paper"] & ~has["browser"], "rag_research")
        .when(has["rag"] & has["browser"], "rag_browser_research")
        .when(has["browser"] & ~has["rag"], "browser_extension")
        .otherwise("general")
    )


def with_unique_slugs(rows: DataFrame) -> DataFrame:
    taken = F.count("*").over(Window.partitionBy("slug")) > 1
    return rows.withColumn("taken", taken).select("item_id", T.unique_slug(F.col("slug"), F.col("source_url"), F.col("taken")).alias("slug"))


def score_all(items: DataFrame, as_of: Column) -> DataFrame:
    """All five scores, in the order in which they depend on each other."""
    scored = items.withColumns({"quality": S.quality(), "remix": S.remixability(), "hype": S.hype_risk(), "applicability": S.applicability()})
    return scored.withColumn("underground", S.underground(as_of, F.col("quality"), F.col("stars")))


def rotate(rows: DataFrame, offsets: DataFrame, size: int, by: str = "source_type", order: str = "item_id", span: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The next `size` rows of each list from its saved offset on, around its end, and the offsets for the next turn.

    `offsets` has (by, offset); a list without one starts at its first row. A row's place is its rank by `order`, a whole number that may
    have gaps: rows are ranked within spans of `order`, whose sizes are added up, so that a long list is never sorted in
    one task. Rows with a null `by` or `order` are in no list.
    """
    listed = rows.filter(F.col(by).isNotNull() & F.col(order).isNotNull()).withColumn("_span", F.floor(F.col(order) / span))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = listed.groupBy(by, "_span").agg(F.count("*").alias("_n"))
    spans = spans.select(by, "_span", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(by)).alias("_all"))
    start = spans.select(by, "_all").distinct().join(offsets.select(by, F.col("offset").alias("_offset")), by, "left").withColumn("_offset", F.pmod(F.coalesce("_offset", F.lit(0)), F.col("_all")))
    step = F.least(F.greatest(F.lit(1), F.lit(size)), F.col("_all"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy(by, "_span").orderBy(order)) - 1
    placed = listed.join(spans, [by, "_span"]).withColumn("_place", place).join(start.select(by, "_offset"), by)
    window = placed.filter(F.pmod(F.col("_place") - F.col("_offset"), F.col("_all")) < step).select(*[F.col(f"`{c}`") for c in rows.columns])
    return window, start.select(by, F.pmod(F.col("_offset") + step, F.col("_all")).alias("offset"))

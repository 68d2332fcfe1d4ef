"""Statistics over items, runs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Theme of each artifact type and the order of themes; other types are projects.
THEMES = {
    "starter_template": "templates", "open_source_project": "projects", "hackathon_project": "projects", "mcp_server": "agents", "coding_agent_workflow": "agents",
    "research_paper": "research", "technical_technique": "research", "architecture_pattern": "research", "deployment_recipe": "templates",
    "api_tool": "libraries", "model": "libraries", "dataset": "libraries",
}
THEME_ORDER = ("templates", "projects", "agents", "research", "libraries")
DEFAULT_THEME = "projects"


def index_stats(items: DataFrame, as_of: Column, days: int = 1, sparse: int = 40) -> DataFrame:
    recent = F.col("published_at") > as_of - F.make_interval(days=F.lit(days))
    return items.agg(
        F.count("*").alias("n_items"),
        F.count("embedding").alias("n_vectors"),
        F.max("published_at").alias("newest"),
        F.count_if(recent).alias("recent"),
        (F.count("*") < sparse).alias("sparse"),
    )


def last_finish(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'done'").groupBy("source_type").agg(F.max("finished_at").alias("last_finish"))


def page(rows: DataFrame, order: list[Column], size: int, offset: int) -> DataFrame:
    """One page with the total; only offset + size rows are ever sorted in one place."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))


def run_state(ledger: DataFrame, as_of: Column, hours: int = 3) -> DataFrame:
    running = (F.col("status") == "running") & (F.col("finished_at") > as_of - F.make_interval(hours=F.lit(hours)))
    last = F.max(F.when(F.col("status") == "done", F.col("finished_at")))
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(last)) / 60_000_000)
    return ledger.groupBy("source_type").agg((F.count_if(running) > 0).alias("running"), minutes.alias("minutes_since"))


def theme(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in THEMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(DEFAULT_THEME))


def theme_sql(kind: str = "artifact_type", place: bool = False) -> str:
    """The theme of a type, or its place in the order, as SQL."""
    value = lambda t: str(THEME_ORDER.index(t) + 1) if place else f"'{t}'"
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {value(t)}" for k, t in THEMES.items()) + f" ELSE {value(DEFAULT_THEME)} END"


def theme_counts(items: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, THEME_ORDER)), F.col("theme")).cast("int")
    return items.groupBy(theme(F.col("artifact_type")).alias("theme")).agg(F.count("*").alias("n")).withColumn("ord", order)


def outcome_counters(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("source_type", F.col("status").alias("outcome")).agg(F.count("*").alias("n"), F.sum("found").alias("found"))


def leaderboard(profiles: DataFrame, limit: int) -> DataFrame:
    return profiles.orderBy(F.desc("credibility"), "username").limit(limit)


def frequent_values(results: DataFrame, column: str, limit: int = 8, first: int = 25) -> DataFrame:
    """Per query the most frequent trimmed values of an array column in its first results; ties by first appearance."""
    top = results.filter(F.col("rank") <= first)
    values = top.select("query_id", "rank", F.posexplode(column).alias("pos", "value")).withColumn("value", F.trim("value")).filter("value <> ''")
    counted = values.groupBy("query_id", "value").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("seen"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "seen"))
    return counted.withColumn("turn", turn).filter(F.col("turn") <= limit).drop("seen")

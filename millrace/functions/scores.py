"""Score expressions over item columns. Column names follow the item table; scores are 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Phrases of marketing and frameworks that many projects share.
MARKETING = ("10x", "revolutionary", "game-changing", "disrupt", "paradigm", "next generation", "world-class", "best-in-class", "unprecedented")
#: Fixed value: a word of these letters alone. Letters of any script are part of a word, as in the surveyed rule; what `\\b` takes for
#: one hangs on the engine.
AI_WORD = r"(^|[^\p{L}\p{N}_])(ai|ml)([^\p{L}\p{N}_]|$)"
COMMON_FRAMEWORKS = ("Next.js", "React", "FastAPI", "Supabase", "Tailwind", "Python", "TypeScript")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def normalize_score(c: Column) -> Column:
    return clamp(F.coalesce(c, F.lit(0.0)) / 100, 0.0, 1.0)


def points(*rules: tuple[float, Column]) -> Column:
    total = F.lit(0.0)
    for n, rule in rules:
        total = total + F.when(F.coalesce(rule, F.lit(False)), F.lit(float(n))).otherwise(F.lit(0.0))
    return clamp(total)


def has_text(c: Column | str, least: int = 40) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.length(T.strip(F.coalesce(c, F.lit("")))) >= least


def filled(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def recency(published: Column, as_of: Column, window: int = 180) -> Column:
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(published)) / 86_400_000_000)
    return F.when(published.isNull(), F.lit(0.3)).when(days <= 0, F.lit(1.0)).when(days >= window, F.lit(0.0)).otherwise(1.0 - days / window)


def popularity(stars: Column, forks: Column | None = None, kind: str = "sqrt") -> Column:
    stars = F.coalesce(stars, F.lit(0))
    if kind == "log":
        return F.least(F.lit(100.0), 10 * F.log10(stars + 1))
    if kind == "linear":
        return F.least(F.lit(100.0), stars.cast("double"))
    return F.least(F.lit(100.0), 2 * F.sqrt(stars) + F.least(F.coalesce(forks, F.lit(0)), F.lit(500)) / 50)


def quality() -> Column:
    return points(
        (20, has_text("use_case")),
        (20, filled("commands")),
        (15, F.col("has_code") | F.col("has_demo") | F.col("has_paper")),
        (15, has_text("core")),
        (10, has_text("use_case", 25)),
        (10, F.col("published_at").isNotNull()),
        (10, F.col("has_demo") | F.contains(F.lower("summary"), F.lit("example"))),
    )


def remixability() -> Column:
    licensed = F.lower("license").rlike("mit|apache|bsd")
    return points(
        (20, F.col("has_code")),
        (15, F.col("has_docs")),
        (15, filled("commands")),
        (15, F.arrays_overlap("frameworks", F.array(*map(F.lit, COMMON_FRAMEWORKS)))),
        (10, licensed),
        (10, has_text("core", 30)),
        (10, F.col("has_demo")),
        (5, has_text("summary", 20)),
    )


def hype_risk(url: Column | None = None) -> Column:
    combined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary", "use_case", "core")])
    low = F.lower(combined)
    short = ~has_text(combined, 200) & (F.length(combined) > 20)
    return points(
        (20, F.exists(F.array(*map(F.lit, MARKETING)), lambda p: F.contains(low, p))),
        (10, low.rlike(AI_WORD) & (F.length(combined) < 120)),
        (20, ~(F.col("has_code") | F.col("has_demo") | F.col("has_paper"))),
        (15, ~filled("commands")),
        (15, short),
        (10, ~T.valid_url(url) if url is not None else F.lit(False)),
        (10, ~has_text("core", 30)),
        (10, (F.size(F.filter(F.split(F.lower("title"), f"{T.BLANK}+"), lambda w: w != "")) <= 3) & ~F.col("has_code")),
    )


def applicability() -> Column:
    return points(
        (25, has_text("use_case")),
        (20, F.col("has_code") | F.col("has_demo")),
        (20, filled("frameworks") | filled("tools")),
        (15, filled("commands")),
        (10, has_text("core", 25)),
        (10, has_text("summary", 30)),
    )


def underground(as_of: Column, quality_score: Column, stars: Column, niche: float = 0.5) -> Column:
    low = F.when(stars.isNotNull(), F.greatest(F.lit(0.0), 1 - F.least(stars, F.lit(2000)) / 2000)).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("popularity", F.lit(0.0)) / 100))
    return clamp(100 * (0.35 * low + 0.25 * recency(F.col("published_at"), as_of) + 0.25 * quality_score / 100 + 0.15 * niche))


def substance() -> Column:
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("summary", "use_case", "core")])
    part = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), part(F.col("has_code"), 0.4) + part(filled("commands"), 0.3) + part(F.length(text) >= 120, 0.3))


def final_score(relevance: Column, fused: Column, as_of: Column, weights: dict[str, float] | None = None) -> Column:
    """The blend of relevance, fused rank and item scores, clamped to 0..1."""
    w = {"relevance": 0.50, "fused": 0.20, "remix": 0.03, "quality": 0.07, "underground": 0.13, "recency": 0.02, "popularity": 0.01, "substance": 0.08, "hype": -0.20} | (weights or {})
    parts = {
        "relevance": relevance,
        "fused": F.least(F.lit(1.0), 45 * fused),
        "remix": normalize_score(F.col("remix")),
        "quality": normalize_score(F.col("quality")),
        "underground": normalize_score(underground(as_of, F.col("quality"), F.col("stars"))),
        "recency": recency(F.col("published_at"), as_of),
        "popularity": normalize_score(F.col("popularity")),
        "substance": substance(),
        "hype": normalize_score(F.col("hype")),
    }
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + F.lit(w[name]) * part
    return clamp(total, 0.0, 1.0)


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.66, "strong").when(c >= 0.4, "related").otherwise("adjacent")


def moderation(quality_score: Column, hype_score: Column) -> tuple[Column, Column]:
    """Approved or rejected, and the reasons."""
    approved = (quality_score >= 70) & (hype_score <= 45)
    reasons = F.concat_ws(
        "; ",
        F.when(quality_score < 70, F.format_string("quality %.0f below 70", quality_score)),
        F.when(hype_score > 45, F.format_string("hype risk %.0f above 45", hype_score)),
    )
    return F.when(approved, "approved").otherwise("rejected"), reasons


#: Own wording of who an item serves: words of its text, or its type, and the line shown.
USE_CASES = (
    (("hackathon",), None, "For a demo at a hackathon."),
    ((), "mcp_server", "For wiring tools into an agent."),
    ((), "starter_template", "For starting from a forkable template."),
    (("extension", "chrome"), None, "For browser extensions."),
    (("lecture", "video", "transcri", "whisper"), None, "For transcripts, summaries and study tools."),
    (("rag", "retrieval"), None, "For search and answers over documents."),
)


def use_case_line(text: Column, kind: Column) -> Column:
    """The first line whose words or type fit."""
    low, line = F.lower(text), F.lit("For a remixable starting point.")
    for words, only, says in reversed(USE_CASES):
        fits = kind == only if only else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        line = F.when(fits, says).otherwise(line)
    return line


def remix_line(commands: Column, readme: Column) -> Column:
    return F.when(F.size(commands) > 0, "Run the commands, then swap the parts.").when(readme.rlike("(?i)##\\s*usage"), "Follow the usage section.").otherwise("Copy the modules that you need.")

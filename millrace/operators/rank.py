"""Fusion, relevance, de-duplication and presentation of ranked hits."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scores as S
from millrace.functions import text as T
from millrace.operators import contains, filters, learn, stats
from millrace.operators.intent import PROFILE_WORDS, suggest_query
from millrace.operators.retrieve import FUSION, RRF_K, bounded, top_k


def fuse_by_item(*legs: DataFrame) -> DataFrame:
    """(query_id, item_id, kw_rank, similarity, arrival): the best keyword rank and the last leg's similarity."""
    union = None
    for no, leg in enumerate(legs):
        have = set(leg.columns)
        rows = leg.select("query_id", "item_id", "rank", F.lit(no).alias("leg"), *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in ("kw_rank", "similarity")])
        union = rows if union is None else union.unionByName(rows)
    fused = union.groupBy("query_id", "item_id").agg(
        F.max("kw_rank").alias("kw_rank"), F.max_by("similarity", F.when(F.col("similarity").isNotNull(), F.col("leg"))).alias("similarity"), F.min(F.struct("leg", "rank")).alias("seen")
    )
    arrival = F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "item_id"))
    return fused.withColumn("arrival", arrival).drop("seen")


def fused_hits(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, item_id, fused, kw_rank, similarity, arrival, ranks): rrf and fuse_by_item in one pass over the legs.

    `ranks` holds the rank in each leg, null where it has none.
    """
    weights = FUSION | (weights or {})
    union = None
    for no, (name, leg) in enumerate(legs.items()):
        have = set(leg.columns)
        rows = leg.select("query_id", "item_id", "rank", F.lit(no).alias("leg"), (F.lit(weights[name]) / (k + F.col("rank"))).alias("part"), *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in ("kw_rank", "similarity")])
        union = rows if union is None else union.unionByName(rows)
    fused = union.groupBy("query_id", "item_id").agg(
        F.bround(F.sum("part"), 9).alias("fused"),
        F.max("kw_rank").alias("kw_rank"),
        F.max_by("similarity", F.when(F.col("similarity").isNotNull(), F.col("leg"))).alias("similarity"),
        F.min(F.struct("leg", "rank")).alias("seen"),
        F.array(*[F.max(F.when(F.col("leg") == no, F.col("rank"))) for no in range(len(legs))]).alias("ranks"),
    )
    arrival = F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "item_id"))
    return fused.withColumn("arrival", arrival).drop("seen")


#: Shares of the parts of relevance.
SHARES = {"frameworks": 0.18, "tools": 0.18, "tags": 0.14, "languages": 0.08, "terms": 0.22, "types": 0.08, "profile": 0.12, "keyword": 0.12, "vector": 0.15}
#: So many ids go to all tasks, rather than the texts of the items through a shuffle.
MOST_IDS = 1_000_000
_ASKED = ("frameworks", "tools", "tags", "languages", "search_terms", "types", "project_type")


def asked(intents: DataFrame) -> DataFrame:
    """The intents as columns asked_*, to be joined to hits by query_id."""
    return intents.select("query_id", *[F.col(c).alias(f"asked_{c}") for c in _ASKED])


def with_blob(items: DataFrame) -> DataFrame:
    """Adds blob, the text that relevance looks in, and tight, the same without spaces."""
    return items.withColumn("blob", filters.text_blob()).withColumn("tight", F.replace("blob", F.lit(" "), F.lit("")))


def inside(where: str, value: Column) -> Column:
    """Whether an item's blob or tight contains a value."""
    return F.contains(F.col(where), value)


def held(where: str, value: Column) -> Column:
    """The same, of a value that `with_held` has looked for."""
    return F.array_contains(f"held_{where}", value)


def with_held(items: DataFrame, intents: DataFrame) -> tuple[DataFrame, Callable[[str, Column], Column]]:
    """Adds held_blob and held_tight, the values asked for by any query that the item's blob and tight contain, and gives what looks there.

    So a text is read once for all queries that have found it. Beyond a bounded number of values nothing is added, and each hit looks into the text.
    """
    lower = lambda c: F.transform(c, F.lower)
    wanted = {
        "blob": F.concat(*[F.coalesce(lower(c), F.array().cast("array<string>")) for c in ("tools", "tags", "languages", F.slice("search_terms", 1, 20))]),
        "tight": F.transform(lower("frameworks"), lambda v: F.replace(v, F.lit(" "), F.lit(""))),
    }
    for where, values in wanted.items():
        found = intents.select(F.explode(values).alias("v")).filter("v IS NOT NULL").distinct().limit(contains.BROADCAST_TERMS + 1).collect()
        if len(found) > contains.BROADCAST_TERMS:
            return items, inside
        known = {r["v"] for r in found} | ({w for words in PROFILE_WORDS.values() for w in words} if where == "blob" else set())
        items = items.withColumn(f"held_{where}", contains.holder(items.sparkSession, sorted(known))(F.col(where)))
    return items, held


def matches(name: str, says: Callable[[str, Column], Column] = inside) -> Column:
    """The wanted values of one list that the item's text or lists hold; spaces do not count in frameworks."""
    if name == "frameworks":
        return F.filter("asked_frameworks", lambda v: says("tight", F.replace(F.lower(v), F.lit(" "), F.lit(""))))
    return F.filter(f"asked_{name}", lambda v: says("blob", F.lower(v)))


def relevance(kw_rank: Column, similarity: Column, says: Callable[[str, Column], Column] = inside) -> Column:
    """Weighted mean of the parts whose input exists, 1 at most.

    Parts: overlap of each list, search terms in the text, type, words of the project's profile, keyword rank, similarity.
    Needs the columns of `asked` and of `with_blob`, and with `held` those of `with_held`.
    """
    n = lambda c: F.size(f"asked_{c}")
    share = lambda hits, low, most: F.least(F.lit(1.0), hits / F.greatest(F.lit(low), F.least(most, F.lit(4 if low == 1 else 8))))
    # parts look into the text, so whether one exists is asked of its input
    given = {name: n(c) > 0 for name, c in zip(("frameworks", "tools", "tags", "languages", "terms", "types"), ("frameworks", "tools", "tags", "languages", "search_terms", "types"))}
    given |= {"profile": F.col("asked_project_type").isin(list(PROFILE_WORDS)), "keyword": kw_rank > 0, "vector": similarity.isNotNull()}
    parts = {name: F.when(given[name], share(F.size(matches(name, says)), 1, n(name))) for name in ("frameworks", "tools", "tags", "languages")}
    first = F.filter(F.slice("asked_search_terms", 1, 20), lambda t: says("blob", F.lower(t)))
    parts["terms"] = F.when(given["terms"], share(F.size(first), 2, n("search_terms")))
    kind = F.lower(F.coalesce("artifact_type", F.lit("")))
    parts["types"] = F.when(given["types"], F.when(F.array_contains(F.transform("asked_types", F.lower), kind), 1.0).otherwise(0.2))
    profile = F.lit(None).cast("double")
    for name, words in PROFILE_WORDS.items():
        hits = sum((says("blob", F.lit(w)).cast("int") for w in words), F.lit(0))
        profile = F.when(F.col("asked_project_type") == name, F.least(F.lit(1.0), hits / F.lit(max(2, len(words) // 2)))).otherwise(profile)
    parts["profile"] = profile
    # least and greatest skip nulls, so a missing input is kept out by hand
    parts["keyword"] = F.when(given["keyword"], F.least(F.lit(1.0), kw_rank * 8))
    parts["vector"] = F.when(given["vector"], S.clamp(similarity, 0.0, 1.0))
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in SHARES.items():
        total = total + F.coalesce(F.lit(w) * parts[name], F.lit(0.0))
        weight = weight + F.when(given[name], F.lit(w)).otherwise(F.lit(0.0))
    return F.when(weight == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total / weight))


def dedupe(hits: DataFrame, key: str, score: str = "final") -> DataFrame:
    """The best hit of each key, at the place where the key first came."""
    per_key = Window.partitionBy("query_id", key)
    best = F.row_number().over(per_key.orderBy(F.desc(score), "arrival"))
    return hits.withColumns({"turn": best, "place": F.min("arrival").over(per_key)}).filter("turn = 1").drop("turn")


def min_max(hits: DataFrame, column: str, out: str) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, span = F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)
    return hits.withColumn(out, F.when(span == 0, (F.col(column) - low)).otherwise((F.col(column) - low) / span))


def rerank_blend(hits: DataFrame, logit: str, final: str = "final", depth: int = 12, share: float = 0.45) -> DataFrame:
    """On the first `depth` hits the sigmoid of a re-ranker's logit, blended with the final score."""
    sigmoid = 1 / (1 + F.exp(-F.col(logit)))
    blended = F.when(F.col("rank") <= depth, share * sigmoid + (1 - share) * F.col(final)).otherwise(F.col(final))
    return hits.withColumn("blended", blended)


def mmr(hits: DataFrame, limit: int = 10, share: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance in a pool of 2 * limit hits a query (query_id, item_id, rank, tokens).

    The pool is bounded, so each query is one small group.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf.sort_values(["rank", "item_id"])
        sets = [set(t) for t in pool["tokens"]]
        n, chosen, left = len(pool), [], list(range(len(pool)))
        while left and len(chosen) < limit:
            def value(i: int) -> float:
                like = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0 for j in chosen), default=0.0)
                return share * (1 - i / max(1, n)) - (1 - share) * like

            best = max(left, key=lambda i: (value(i), -i))
            chosen.append(best)
            left.remove(best)
        out = pool.iloc[chosen][["query_id", "item_id"]].copy()
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    pool = hits.filter(F.col("rank") <= 2 * limit).select("query_id", "item_id", "rank", "tokens")
    return pool.groupBy("query_id").applyInPandas(pick, "query_id bigint, item_id bigint, mmr_rank int")


def scored_hits(legs: dict[str, DataFrame], intents: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """All hits of the legs with the columns of their items, fused, relevance and final score.

    Wide item columns are joined for candidates only: items without a hit go before anything is shuffled, where the ids of the hits are
    few enough to be sent to all tasks. Legs are read twice. Scores are rounded before they order rows.
    """
    hit = functools.reduce(DataFrame.union, [leg.select("item_id") for leg in legs.values()]).distinct()
    found = items.join(bounded(hit, MOST_IDS), "item_id", "left_semi")
    found, says = with_held(with_blob(found), intents)
    rows = fused_hits(legs).join(found, "item_id").join(asked(intents), "query_id")
    rel = F.bround(relevance(F.col("kw_rank"), F.col("similarity"), says), 6)
    return rows.withColumn("relevance", rel).drop("held_blob", "held_tight").withColumn("final", F.bround(S.final_score(F.col("relevance"), F.col("fused"), as_of), 9))


def learned_order(model: dict[str, float], as_of: Column):
    """A re-ranker: the final score becomes the model's, min-max scaled per query; no change without a model."""

    def apply(hits: DataFrame) -> DataFrame:
        if not model:
            return hits
        values = dict(zip(learn.FEATURES, learn.features(as_of)))
        score = sum((F.lit(w) * values[name] for name, w in model.items()), F.lit(0.0))
        return min_max(hits.withColumn("learned", F.bround(score, 6)), "learned", "final").drop("learned")

    return apply


def pair_order(queries: DataFrame, scorer, depth: int = 12, share: float = 0.45):
    """A re-ranker: on the first `depth` hits the sigmoid of a pair scorer's logit, blended with the final score."""

    def apply(hits: DataFrame) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "item_id"))
        ranked = hits.withColumn("rank", turn)
        pairs = ranked.filter(F.col("rank") <= depth).select("query_id", "item_id", "summary").join(queries.select("query_id", "query"), "query_id")
        logits = learn.rerank_pairs(pairs, scorer)
        blended = rerank_blend(ranked.join(logits, ["query_id", "item_id"], "left"), "logit", "final", depth, share)
        return blended.withColumn("final", F.coalesce("blended", "final")).drop("blended", "logit", "rank")

    return apply


def hybrid_search(legs: dict[str, DataFrame], intents: DataFrame, items: DataFrame, as_of: Column, limit: int = 10, rerankers: tuple = (), diverse: bool = False) -> DataFrame:
    """Legs, fused, scored, gated, de-duplicated, re-ranked and cut: (query_id, rank, item_id, final, relevance, fused, total).

    `rerankers` change the final score of the gated hits in turn; a `diverse` result is picked from twice `limit` hits by
    marginal relevance. Ties go by id.
    """
    gated = filters.result_gate(scored_hits(legs, intents, items, as_of).withColumn("key", T.normalize_query(F.lower("title"))), limit)
    hits = dedupe(gated, "key").withColumn("total", F.count("*").over(Window.partitionBy("query_id")))
    for rerank in rerankers:
        hits = rerank(hits)
    ranked = top_k(hits, 2 * limit if diverse else limit, [F.desc("final"), "item_id"])
    if diverse:
        chosen = mmr(ranked.withColumn("tokens", T.token_set()), limit)
        ranked = ranked.drop("rank").join(chosen.withColumnRenamed("mmr_rank", "rank"), ["query_id", "item_id"])
    return ranked.select("query_id", "rank", "item_id", "final", "relevance", "fused", "total")


def graph_nodes(results: DataFrame, per_theme: int = 8) -> DataFrame:
    """(query_id, theme, item_id, turn, radius, size, top): the first hits of each theme, nearer the centre the more relevant."""
    turn = F.row_number().over(Window.partitionBy("query_id", "theme").orderBy(F.desc("relevance"), "item_id"))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "item_id")) <= 4
    r = S.clamp(F.col("relevance"), 0.05, 1.0)
    placed = results.withColumn("theme", stats.theme(F.col("artifact_type"))).withColumns({"turn": turn, "top": top}).filter(F.col("turn") <= per_theme)
    return placed.select("query_id", "theme", "item_id", "turn", F.bround(2.6 + (1 - r) * 4.2, 6).alias("radius"), "top", "relevance")


def graph_edges(nodes: DataFrame) -> DataFrame:
    """(query_id, source, target, weight): from the hub to each node, and between neighbours of a theme."""
    hub = nodes.select("query_id", F.lit(-1).cast("bigint").alias("source"), F.col("item_id").alias("target"), F.bround(0.06 + 0.16 * F.col("relevance"), 6).alias("weight"))
    after = F.lead("item_id").over(Window.partitionBy("query_id", "theme").orderBy("turn"))
    chain = nodes.select("query_id", F.col("item_id").alias("source"), after.alias("target"), F.lit(0.16).alias("weight")).filter("target IS NOT NULL")
    return hub.union(chain)


def query_confidence(results: DataFrame, intents: DataFrame) -> DataFrame:
    """(query_id, confidence, advice): how long the query is, how many signals it has and how good its first five hits are, in percent."""
    best = results.filter("rank <= 5").groupBy("query_id").agg(F.avg("final").alias("best"))
    words = F.size(F.filter(F.regexp_extract_all("query", F.lit("([a-zA-Z0-9+.#-]+)"), 1), lambda w: F.length(w) > 2))
    signals = F.size("frameworks") + F.size("tools") + F.size("tags") + (F.col("project_type") != "general").cast("int")
    rows = intents.join(best, "query_id", "left")
    value = 0.32 * S.clamp((words - 2) / 7, 0.0, 1.0) + 0.30 * S.clamp(signals / 5, 0.0, 1.0) + 0.38 * F.coalesce("best", F.lit(0.0))
    pct = F.bround(F.bround(100 * value, 6), 0).cast("bigint")
    advice = F.when(F.col("best").isNull(), "no matches").when(pct >= 70, "clear").when(pct >= 45, "add detail").otherwise("too vague")
    return rows.select("query_id", pct.alias("confidence"), advice.alias("advice"))


def landscape_summary(results: DataFrame) -> DataFrame:
    """(query_id, summary): how many results, the first two themes and how many are strong."""
    themed = results.withColumn("theme", stats.theme(F.col("artifact_type")))
    order = F.array_position(F.array(*map(F.lit, stats.THEME_ORDER)), F.col("theme"))
    counts = themed.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("final") >= 0.66).alias("strong"), F.transform(F.slice(F.array_sort(F.collect_set(F.struct(order.alias("o"), "theme"))), 1, 2), lambda t: t["theme"]).alias("themes")
    )
    strong = F.when(F.col("strong") > 0, F.concat(F.lit("; "), F.col("strong").cast("string"), F.lit(" strong"))).otherwise(F.lit(""))
    text = F.concat(F.col("n").cast("string"), F.lit(" results, mostly "), F.array_join("themes", " and "), strong)
    return counts.select("query_id", text.alias("summary"))


def clip(c: Column, limit: int) -> Column:
    """Plain text without links or marks, cut at a word."""
    return T.truncate(T.strip_markdown(F.regexp_replace(F.coalesce(c, F.lit("")), "https?://[^ \t\n]+", " ")), limit)


def presentation(items: DataFrame) -> DataFrame:
    """What a result card shows: headline, simple_implementation, start_steps, key_points, about, how_it_helps and stands_out.

    `items` has title, summary, use_case, core, source_type, source_url, artifact_type, the lists, the has_ flags and the scores.
    """
    given = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != ""))
    code = F.col("source_type") == "github"
    title = F.coalesce("title", F.lit("Untitled"))
    headline = F.when(code & F.contains(title, F.lit("/")), F.regexp_replace(title, "^[^/]*/", "")).otherwise(clip(title, 70))
    first = F.try_element_at("commands", F.lit(1))
    url = F.coalesce("source_url", F.lit(""))
    simple = F.coalesce(first, F.when(code, F.concat(F.lit("git clone "), url)), F.lit(""))
    clone = given(F.when(code & (url != ""), F.concat(F.lit("git clone "), url)), F.when(code & (url != ""), F.concat(F.lit("cd "), F.regexp_extract(url, "([^/]+)/*$", 1))))
    start = F.array_distinct(F.concat(clone, F.slice("commands", 1, 3)))
    papers = F.array(*map(F.lit, ("Read the abstract and the method", "Look for its code", "Carry the technique over")))
    others = F.array(*map(F.lit, ("Open the source", "Skim how it is used", "Copy the part you need")))
    start = F.when(F.size(start) > 0, start).when(F.col("source_type") == "arxiv", papers).otherwise(others)
    stack = F.slice(F.array_distinct(F.filter(F.concat("frameworks", "tools", "languages"), lambda x: x.isNotNull())), 1, 6)
    helps = clip(F.coalesce(F.nullif("use_case", F.lit("")), "summary"), 110)
    points = given(helps, F.when(F.size(stack) > 0, F.concat(F.lit("Stack: "), F.array_join(stack, ", "))), F.when(simple != "", F.concat(F.lit("Start: "), clip(simple, 80))))
    long = F.filter(F.array(*[clip(F.col(c), 260) for c in ("summary", "core", "use_case")]), lambda x: F.length(x) > 40)
    about = F.coalesce(F.get(long, F.lit(0)), clip(F.col("summary"), 260))
    use = clip(F.col("use_case"), 170)
    stands = given(
        F.when((F.col("underground") >= 68) & (F.col("hype") <= 38), "Little known, with much behind it"),
        F.when(F.col("remix") >= 74, "Easy to remix"),
        F.when(F.col("has_code") & (F.size("commands") > 0), "Code that runs, with its setup"),
        F.when(F.col("has_demo"), "A demo to try first"),
        F.when(F.col("has_paper") | (F.col("artifact_type") == "research_paper"), "Backed by research"),
        F.when(F.col("artifact_type") == "mcp_server", "Plugs into a coding agent"),
    )
    fallback = F.array(F.when(F.col("quality") >= 80, "High quality and well documented").otherwise("On topic for what was asked"))
    stands = F.when(F.size(stands) > 0, F.slice(stands, 1, 3)).otherwise(fallback)
    return items.select(
        "item_id",
        headline.alias("headline"),
        simple.alias("simple_implementation"),
        F.slice(start, 1, 4).alias("start_steps"),
        F.slice(points, 1, 3).alias("key_points"),
        about.alias("about"),
        F.when(use != "", use).otherwise("An example to learn from and adapt").alias("how_it_helps"),
        stands.alias("stands_out"),
    )


def why_relevant(hits: DataFrame) -> DataFrame:
    """(query_id, item_id, why): a sentence why a hit fits. Five common kinds of project have their own; else it names the stack.

    Needs the columns of `asked` and of `with_blob`.
    """
    says = lambda *words: F.rlike("blob", F.lit("|".join(words)))
    kind = F.col("asked_project_type")
    browser, rag, paper = says("extension", "chrome", "browser"), says("rag", "retrieval", "vector"), says("paper", "arxiv", "pdf", "research")
    media, agent, vision = says("lecture", "quiz", "video", "summarizer"), says("mcp"), says("vision", "posture", "pose", "webcam")
    some = lambda name, n=3: F.array_join(F.slice(matches(name), 1, n), ", ")
    named = F.filter(F.array(some("frameworks"), some("tools"), F.when(some("tags") != "", F.concat(F.lit("tags "), some("tags")))), lambda x: x.isNotNull() & (x != ""))
    more = F.filter(F.array(F.when(F.size("commands") > 0, "it has setup steps"), F.when(F.col("has_code"), "its code is open")), lambda x: x.isNotNull())
    stack = F.when(F.size(named) > 0, F.concat(F.lit("Fits as it uses "), F.array_join(named, "; "), F.when(F.size(more) > 0, F.concat(F.lit(" and "), F.array_join(more, ", "))).otherwise(F.lit("")), F.lit(".")))
    why = (
        F.when((kind == "rag_browser_research") | (browser & rag & paper), "Fits as it joins a browser extension with retrieval over papers.")
        .when(browser & rag, "Fits as it is a browser extension that answers by retrieval.")
        .when((kind == "education_media") | (media & rag), "Fits as it turns lectures or videos into summaries and study aids.")
        .when((kind == "coding_agent_tooling") | agent, F.concat(F.lit("Fits as it is tooling for coding agents"), F.when(some("tools", 2) != "", F.concat(F.lit(", with "), some("tools", 2))).otherwise(F.lit("")), F.lit(".")))
        .when((kind == "computer_vision") | vision, "Fits as it applies computer vision in an app to fork.")
        .otherwise(F.coalesce(stack, F.when(F.size(more) > 0, F.concat(F.lit("Fits as "), F.array_join(more, ", "), F.lit("."))), F.when(F.col("summary") != "", F.lit("Fits by its summary and stack.")), F.lit("Fits by meaning and words.")))
    )
    return hits.select("query_id", "item_id", why.alias("why"))


def landscape(results: DataFrame, intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cards of all results and one row a query.

    Cards: (query_id, item_id, rank, top_rank, relevance_pct, label, theme, and the columns of presentation). Queries:
    (query_id, summary, confidence, advice, suggestion, themes), themes with their counts in fixed order. `results` has the columns of items.
    """
    themed = results.withColumn("theme", stats.theme(F.col("artifact_type")))
    pct = F.bround(100 * F.col("final"), 0).cast("bigint")
    shown = themed.select("query_id", "item_id", "rank", (F.col("rank") - 1).alias("top_rank"), pct.alias("relevance_pct"), S.confidence_label(F.col("final")).alias("label"), "theme")
    cards = shown.join(presentation(results.dropDuplicates(["item_id"])), "item_id")
    place = F.array_position(F.array(*map(F.lit, stats.THEME_ORDER)), F.col("theme"))
    counts = themed.groupBy("query_id", "theme").agg(F.count("*").alias("n"))
    themes = counts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), "theme", "n"))).alias("t")).select("query_id", F.transform("t", lambda x: F.concat(x["theme"], F.lit(":"), x["n"].cast("string"))).alias("themes"))
    confidence = query_confidence(results, intents)
    rows = confidence.join(landscape_summary(results), "query_id", "left").join(suggest_query(results, intents, confidence), "query_id", "left").join(themes, "query_id", "left")
    return cards, rows.select("query_id", F.coalesce("summary", F.lit("0 results")).alias("summary"), "confidence", "advice", F.coalesce("suggestion", F.lit("")).alias("suggestion"), "themes")


def similar_text(title: Column, stack: Column, features: Column) -> Column:
    part = lambda label, c: F.when(F.size(F.filter(c, lambda x: x.isNotNull())) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return F.concat_ws(". ", title, part("Stack: ", stack), part("Features: ", features))

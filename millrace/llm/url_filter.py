"""URL filter: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models over a closed alphabet, one of accepted and one of
rejected URLs, are fitted on all different URLs that a rule decides. Orders 0 to 2 are interpolated by
Witten-Bell smoothing, so that each context falls back as far as its counts ask for, and the ratio of both is a table of
alphabet**3 numbers whatever the input. A URL's score is the mean of that table over its characters; the threshold is the
one with the least balanced error on URLs that were kept out of the fit. Everything is
DataFrame expressions; scoring needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch

#: (host, path prefix, verdict) of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbol numbers are positions here, from 1; digits fold into "0". 0 is any other character.
ALPHABET = LOWER + "0/.-_?=&#%:"
EDGE = len(ALPHABET) + 1
SYMBOLS = len(ALPHABET) + 2
BINS, BIN_WIDTH = 400, 0.01


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; empty without one."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def with_codes(urls: DataFrame, url: Column) -> DataFrame:
    """Adds `_codes`, the codes of all character trigrams of `^^url$`, each below SYMBOLS**3.

    Each symbol is looked up once; the trigrams are three shifted views of the symbols, added up.
    """
    folded = F.regexp_replace(lowered(url), "[0-9]", "0")
    inner = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))
    ids = F.concat(F.array(F.lit(EDGE), F.lit(EDGE)), inner, F.array(F.lit(EDGE)))
    shifted = lambda k: F.slice("_ids", k, F.greatest(F.size("_ids") - 2, F.lit(0)))
    pairs = F.zip_with(shifted(1), shifted(2), lambda x, y: x * SYMBOLS + y)
    codes = F.zip_with(pairs, shifted(3), lambda xy, z: xy * SYMBOLS + z)
    return urls.withColumn("_ids", ids).withColumn("_codes", codes).drop("_ids")


def fit(labelled: DataFrame) -> DataFrame:
    """`labelled` has verdict and `_codes`; the log-likelihood ratio of every trigram code.

    Counts are summed per class and code, of which there are 2 * SYMBOLS**3 at most, before
    the shuffle. The rest works on that bounded grid.
    """
    spark = SparkSession.active()
    counts = labelled.select("verdict", F.explode("_codes").alias("code")).groupBy("code").agg(
        F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")
    )
    grid = spark.range(0, SYMBOLS**3, 1, 4).select(F.col("id").cast("int").alias("code"))
    grid = grid.join(counts, "code", "left").select(
        "code",
        F.coalesce("allow", F.lit(0)).alias("allow"),
        F.coalesce("block", F.lit(0)).alias("block"),
        F.floor(F.col("code") / (SYMBOLS * SYMBOLS)).alias("a"),
        (F.floor(F.col("code") / SYMBOLS) % SYMBOLS).alias("b"),
        (F.col("code") % SYMBOLS).alias("c"),
    )
    ab, bc, b, c = (Window.partitionBy(*k) for k in (("a", "b"), ("b", "c"), ("b",), ("c",)))

    def model(n: str) -> tuple[dict, dict, Column]:
        """Windows of the counts, then of the kinds that follow, then the smoothed probability."""
        first = {
            f"{n}_ab": F.sum(n).over(ab),
            f"{n}_tab": F.count_if(F.col(n) > 0).over(ab),
            f"{n}_bc": F.sum(n).over(bc),
            f"{n}_c": F.sum(n).over(c),
            f"{n}_all": F.sum(n).over(Window.partitionBy(F.lit(0))),
        }
        second = {
            f"{n}_b": F.sum(n).over(b),
            f"{n}_tb": F.count_if((F.col(f"{n}_bc") > 0) & (F.col("a") == 0)).over(b),
        }
        p1 = (F.col(f"{n}_c") + 0.5) / (F.col(f"{n}_all") + 0.5 * SYMBOLS)
        p2 = (F.col(f"{n}_bc") + (F.col(f"{n}_tb") + 1) * p1) / (F.col(f"{n}_b") + F.col(f"{n}_tb") + 1)
        p3 = (F.col(n) + (F.col(f"{n}_tab") + 1) * p2) / (F.col(f"{n}_ab") + F.col(f"{n}_tab") + 1)
        return first, second, p3

    (f1, s1, pa), (f2, s2, pb) = model("allow"), model("block")
    return grid.withColumns(f1 | f2).withColumns(s1 | s2).select("code", (F.log(pa) - F.log(pb)).alias("weight"))


def weights(labelled: DataFrame) -> Column:
    """The fitted table as one array literal of SYMBOLS**3 numbers, a bound that no input moves."""
    table = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", F.round("weight", 5).alias("w")))), lambda x: x["w"].cast("string")), ",")
    text = fit(labelled).agg(table.alias("t")).first()["t"]
    return F.from_json(F.lit(f"[{text}]"), "array<double>")


def mean_score(url: Column, table: Column) -> Column:
    """The mean log-likelihood difference a character of `_codes`, accepted less rejected; null for a null or empty URL."""
    total = F.aggregate("_codes", F.lit(0.0), lambda acc, code: acc + F.element_at(table, code + 1))
    return F.when(F.length(url) > 0, total / F.size("_codes"))


def threshold(scored: DataFrame) -> float:
    """The score with the least balanced error; `scored` has lm_score and verdict.

    Scores are counted in 2 * BINS + 1 bins; without both classes it is 0.
    """
    bin_of = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("lm_score") / BIN_WIDTH)))
    bins = scored.filter(F.col("lm_score").isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(every))
    error = share("allow") + 1 - share("block")
    best = bins.select("bin", error.alias("error")).filter("error IS NOT NULL").orderBy("error", F.abs("bin"), "bin").first()
    return best["bin"] * BIN_WIDTH if best else 0.0


def learn(labelled: DataFrame, folds: int = 5) -> tuple[Column, float]:
    """The table of weights and the threshold from all different URLs of `labelled` (url, verdict), one fold kept out of the fit.

    Each URL counts once, however often it is there. Counts are summed in the tasks before they are shuffled, so only the URLs
    themselves are, once, to tell them apart.
    """
    single = labelled.filter("url IS NOT NULL").dropDuplicates(["url"])
    single = Scratch(labelled.sparkSession, "url-filter").save(single.withColumn("fold", F.crc32(F.col("url").cast("binary")) % folds), "urls")
    coded = with_codes(single, F.col("url"))
    table = weights(coded.filter("fold <> 0"))
    return table, threshold(coded.filter("fold = 0").withColumn("lm_score", mean_score(F.col("url"), table)))


ADDED = ("host", "path", "rule", "lm_score", "lm_threshold", "verdict")


def judge(pages: DataFrame, url: str = "url", rules=RULES, folds: int = 5) -> DataFrame:
    """All columns of `pages` plus host, path, rule, lm_score, lm_threshold and verdict.

    A URL without a rule is allowed if its score reaches the threshold. A null or empty URL
    has no evidence and is blocked. URLs are read whole. Repeated rows get equal verdicts; an empty table
    gives no rows. Columns of `pages` with one of the added names are replaced, all others come out as they are.
    """
    names = [c for c in pages.columns if c not in ADDED]
    # the caller's row is one column here, so that no name of it can meet a name of ours
    parts = pages.select(F.struct(*pages.columns).alias("row"), F.col(f"`{url}`").cast("string").alias("url"))
    parts = parts.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "verdict": verdict})
    table, cut = learn(ruled.filter("verdict IS NOT NULL").select("url", "verdict"), folds)
    scored = with_codes(ruled, F.col("url")).withColumn("lm_score", mean_score(F.col("url"), table)).withColumn("lm_threshold", F.lit(cut))
    own = F.when(F.col("lm_score") >= F.col("lm_threshold"), F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", F.coalesce("verdict", own)).select(*[F.col(f"row.`{c}`").alias(c) for c in names], *ADDED)


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("lm_score", 6).alias("lm_score"))

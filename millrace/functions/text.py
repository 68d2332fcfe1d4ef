"""Text, URL and list expressions: Column in, Column out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[ \t\n\r\f\x0b]"
#: Latin letters with marks and what is left of them; other characters outside ASCII are dropped.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Query parameters dropped by canonical_url, by prefix.
TRACKING = ("utm_", "ref", "fbclid", "gclid")
#: Words without search value.
STOPWORDS = (
    "a an the and or but in on at to for of with by from as is are was were be been being have has had do does did will would could should may might must can "
    "i im me my we our you your they them their it its this that these those what which who how when where why any both each few more most other some such no nor "
    "not only own same so than too very just also need needs want show find get use using build building into about over under between through during before after "
    "above below up down out off again further then once here there all"
).split()
#: Words with a letter first, or numbers with letters after them.
TOKEN = "([a-zA-Z][a-zA-Z0-9+.#-]*|[0-9]+[a-zA-Z]*)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def slugify(c: Column, limit: int = 80, default: str = "artifact") -> Column:
    ascii_ = F.regexp_replace(F.translate(c, MARKED, PLAIN), "[^\\x00-\\x7F]", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, limit), F.lit("")), F.lit(default))


def clean_text(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "```[a-zA-Z0-9]*\n", "")
    c = F.replace(c, F.lit("```"), F.lit(""))
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), ("<[^>]+>", " "), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def truncate(c: Column, limit: int) -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit), " [^ ]*$", ""), F.lit("…")))


def strip_markdown(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("[`*_#>]+", ""), (f"{BLANK}+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for entity, by in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(by))
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def normalize_query(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", " "))


def canonical_url(c: Column) -> Column:
    """https, lower-case host without www. and default port, no trailing slash, fragment or tracking parameter."""
    bare = strip(c)
    c = F.when(F.contains(bare, F.lit("://")), bare).otherwise(F.concat(F.lit("https://"), bare))
    part = lambda n: F.regexp_extract(c, r"^[^:]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", n)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), "^www\\.", ""), ":(80|443)$", "")
    tracked = lambda p: F.exists(F.array(*map(F.lit, TRACKING)), lambda t: F.startswith(F.lower(F.split(p, "=")[0]), t))
    query = F.array_join(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~tracked(p)), "&")
    url = F.concat(F.lit("https://"), host, F.regexp_replace(part(2), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.length(bare) > 0, url)


def valid_url(c: Column) -> Column:
    host = F.regexp_extract(F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("https://"), c)), r"^[^:]*://([^/?#]*)", 1)
    return F.coalesce(F.contains(host, F.lit(".")), F.lit(False))


def distinct_keep_order(values: Column) -> Column:
    """Trimmed, without blanks; of values equal but for case the first stays. Lists are short (one row's)."""
    kept = F.filter(F.transform(values, strip), lambda v: v != "")
    return F.filter(kept, lambda v, i: F.array_position(F.transform(kept, F.lower), F.lower(v)) == i + 1)


def significant_terms(c: Column, limit: int = 20) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 1)
    kept = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def search_tokens(terms: Column, limit: int = 24) -> Column:
    """Letters and digits only, three or more, without stop words."""
    bare = F.transform(terms, lambda t: F.regexp_replace(F.lower(t), "[^a-zA-Z0-9]", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))), 1, limit)


def normalize_topics(values: Column) -> Column:
    return F.filter(F.transform(values, lambda t: F.replace(F.lower(strip(t)), F.lit(" "), F.lit("-"))), lambda t: t != "")


def token_set(item: dict[str, str] | None = None) -> Column:
    lists = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("tags", "tools", "frameworks", "languages")])
    title = F.filter(F.split(F.lower("title"), f"{BLANK}+"), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.filter(F.concat(F.transform(lists, F.lower), title), lambda t: t.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dedupe_key(url: Column, title: Column, item_id: Column) -> Column:
    """The code repository, else the paper, else the title, else the id."""
    repo = F.regexp_extract(F.lower(url), r"github\.com/([^/?#]+/[^/?#]+)", 1)
    paper = F.regexp_extract(F.lower(url), r"arxiv\.org/(?:abs|pdf)/([0-9]+\.[0-9]+)", 1)
    named = normalize_query(F.lower(title))
    return F.coalesce(
        F.concat(F.lit("gh:"), F.nullif(repo, F.lit(""))),
        F.concat(F.lit("arxiv:"), F.nullif(paper, F.lit(""))),
        F.concat(F.lit("t:"), F.nullif(named, F.lit(""))),
        F.concat(F.lit("id:"), item_id.cast("string")),
    )


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for a missing or zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def format_vector(v: Column) -> Column:
    """The vector as text, six digits after the point, rounded from the exact binary values with ties to even; null elements are left out.

    Spark's format_string rounds the shortest decimal of a number and ties away from zero, so that 0.0703125 ends in 3.
    """

    @F.arrow_udf("string")
    def literal(vectors: pa.Array) -> pa.Array:
        kept = ([x for x in row if x is not None] if row is not None else None for row in vectors.to_pylist())
        return pa.array([None if row is None else "[" + ",".join(["%.6f"] * len(row)) % tuple(row) + "]" for row in kept], pa.string())

    return literal(v.cast("array<double>"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def match_vocabulary(text: Column, vocabulary: list[str]) -> Column:
    """Entries that the lower-cased text contains, longest first."""
    ordered = sorted(set(vocabulary), key=lambda v: (-len(v), v))
    return F.filter(F.array(*map(F.lit, ordered)), lambda v: F.contains(F.lower(text), F.lower(v)))


def setup_commands(text: Column, limit: int = 20) -> Column:
    """Lines of fenced shell blocks that start like a command."""
    fences = F.regexp_extract_all(text, F.lit("(?is)```(?:bash|sh|shell|console)?[ \t]*\n(.*?)```"), 1)
    lines = F.transform(F.flatten(F.transform(fences, lambda b: F.split(b, "\n"))), lambda x: F.regexp_replace(strip(x), "^[$>] *", ""))
    return F.slice(F.filter(lines, lambda x: x.rlike("^(pip|npm|yarn|pnpm|docker|git|python|python3|uv|cargo|go|make|brew|conda|npx|curl)( |$)")), 1, limit)


def steps(text: Column, limit: int = 15) -> Column:
    """Numbered or bulleted lines of more than ten characters, without their mark."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"^{BLANK}*([0-9]+[.)]|[-*]){BLANK}+"))
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, f"^{BLANK}*([0-9]+[.)]|[-*]){BLANK}+", "")))
    return F.slice(F.filter(bare, lambda x: F.length(x) > 10), 1, limit)


def first_paragraph(text: Column, least: int = 40, limit: int = 400) -> Column:
    """The first paragraph of prose: no heading, badge, list or code."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n[ \t]*\n"), strip)
    prose = F.filter(parts, lambda p: (F.length(p) > least) & ~p.rlike("^(#|!\\[|\\[!|<|[-*] |```|\\|)"))
    return F.substring(F.get(prose, F.lit(0)), 1, limit)


def parse_date(c: Column) -> Column:
    """RFC 822 or ISO 8601; null where neither fits."""
    bare = F.regexp_replace(strip(c), "^[A-Za-z]{3}, ", "")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def relative_time(seconds: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u))
    return F.when(seconds < 90, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def unique_slug(slug: Column, url: Column, taken: Column) -> Column:
    return F.when(taken, F.concat(F.substring(slug, 1, 70), F.lit("-"), F.substring(F.sha1(url), 1, 6))).otherwise(slug)


#: Steps of a suffix stripper for English (plurals, -ed, -ing, final y), as (condition, what replaces the match): the first that
#: fits counts. None leaves the word as it is. Patterns are without look-around, so that SQL engines read them alike.
_E = "<e>"
SUFFIX_STEPS = (
    (("sses$", "ss"), ("^..+(ied|ies)$", ("(ied|ies)$", "i")), ("(ied|ies)$", "ie"), ("(us|ss)$", None), ("[aeiouy].+s$", ("s$", ""))),
    (("(eedly|eed)$", "ee"), ("[aeiouy].*(ingly|edly|ing|ed)$", ("(ingly|edly|ing|ed)$", _E))),
    (("(at|bl|iz)" + _E + "$", (_E, "e")), ("(bb|dd|ff|gg|mm|nn|pp|rr|tt)" + _E + "$", ("." + _E, "")), ("^[^aeiouy]*[aeiouy][^aeiouywx]" + _E + "$", (_E, "e")), (_E + "$", "")),
    ((".[^aeiouy]y$", ("y$", "i")),),
)


def _change(rule) -> tuple[str, str, str] | None:
    """(condition, pattern, replacement) of a rule."""
    condition, put = rule
    return None if put is None else (condition, *put) if isinstance(put, tuple) else (condition, condition, put)


def _stripped(word: Column, step) -> Column:
    out = word
    for rule in reversed(step):
        change = _change(rule)
        out = F.when(F.rlike(word, F.lit(rule[0])), word if change is None else F.regexp_replace(word, change[1], change[2])).otherwise(out)
    return F.when(F.length(word) >= 3, out).otherwise(word)


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """Words of three letters or more without their suffixes. Each step binds its word once, as the element of a list of one."""
    word = F.array(column)
    for step in SUFFIX_STEPS:
        word = F.transform(word, lambda w: _stripped(w, step))  # noqa: B023  called at once
    return rows.withColumn(column, word[0])


def stemmed_sql(table: str, column: str) -> str:
    """The same as a nested query over `table`."""
    for step in SUFFIX_STEPS:
        cases = " ".join(f"WHEN regexp_matches({column}, '{rule[0]}') THEN {column if change is None else f"regexp_replace({column}, '{change[1]}', '{change[2]}')"}" for rule in step for change in [_change(rule)])
        table = f"(SELECT * REPLACE (CASE WHEN length({column}) < 3 THEN {column} {cases} ELSE {column} END AS {column}) FROM {table})"
    return table

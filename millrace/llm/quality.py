"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one integer whose bit i says that rule i fails. A policy is a versioned mask over
those bits, so another policy, or an ablation of one rule, is a bitwise expression
over the ledger and never reads the texts again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W

SYMBOLS = b"#*$%&|<>"
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_SPACES = b" \t\n\x0b\x0c\r"

#: name -> condition of failure over the measurements. The position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 15 * n_words",
    "shouting": "100 * n_upper_words > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "exclamations": "100 * n_exclamations > 30 * n_words",
    "few_letters": "100 * n_letters < 50 * word_chars",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
}
#: version -> rules that a document must pass.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "exclamations"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_exclamations", "n_letters")


def policy_mask(version: str) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[version])


def _repeat_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that the text holds twice or more."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    seen, twice = set(), set()
    for g in grams if len(set(grams)) < len(grams) else ():
        (twice if g in seen else seen).add(g)
    n = end = 0
    if twice:
        for i, g in enumerate(grams):
            if g in twice:
                n += i + 3 - max(i, end)
                end = i + 3
    return n


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text or "") - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        sum(map(bytes.isupper, words)),
        raw.count(b"!"),
        len((text or "")) - (len(raw) - len(raw.translate(None, _NOT_LETTERS))),
    )


def _measured(batches, n: int, at: int):
    """The first `n` columns and the measurements of the text, column `at`, some megabytes of text at a time."""
    for part in W.slices(batches, at):
        rows = [measure(x.as_py()) for x in part.column(at)]
        measured = [pa.array(c, pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([*part.columns[:n], *measured], names=[*part.schema.names[:n], *MEASURES])


def _judged(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(k0, k1, ... for the columns `keep`, the measurements, failures): names of the caller cannot meet ours.

    A text that is kept goes to Python once.
    """
    kept, n = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], len(keep)
    at = keep.index(text) if text in keep else n
    source = docs.select(*kept, *([F.col(f"`{text}`").alias("whole_text")] if at == n else []))
    names = source.columns[:n]
    schema = ", ".join([f"{c} {source.schema[c].dataType.simpleString()}" for c in names] + [f"{m} bigint" for m in MEASURES])
    measured = source.mapInArrow(lambda batches: _measured(batches, n, at), schema)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures.cast("int"))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, the measurements and `failures`, the bitmask of failed rules.

    A null text counts as an empty one; texts are measured whole, however long. Every input row gives one
    row, repeated rows included, an empty table none. Columns not in `keep` are not read; `keep` must not
    name a measurement or `failures`, which is an error at once.
    """
    if clash := {*keep} & {*MEASURES, "failures"}:
        raise ValueError(f"columns to keep have names of the ledger: {sorted(clash)}")
    return _judged(docs, text, keep).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, "failures")


def passes(failures: Column, version: str) -> Column:
    return failures.bitwiseAND(F.lit(policy_mask(version))) == 0


def ablation(led: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    One pass over the ledger; each task sends one row of partial counts.
    """
    failed = F.col("failures").bitwiseAND(F.lit(policy_mask(version)))
    names = [(i, name) for i, name in enumerate(RULES) if name in POLICIES[version]]
    counts = led.agg(
        *[F.count_if(failed.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}") for i, _ in names],
        *[F.count_if(failed == (1 << i)).alias(f"o{i}") for i, _ in names],
    )
    stacked = ", ".join(f"'{name}', f{i}, o{i}" for i, name in names)
    return counts.selectExpr(f"stack({len(names)}, {stacked}) AS (rule, n_failed, n_only)")


def judge(docs: DataFrame, version: str = "v2") -> DataFrame:
    """One row per document: the measurements, `failures`, `base_failed` and `kept`."""
    base = ~passes(F.col("failures"), "base")
    return ledger(docs).withColumns({"base_failed": base, "kept": ~base & passes(F.col("failures"), version)})


def keep(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The rows of `docs` that the policy keeps, with all columns as they are, whatever their names.

    Null and empty texts fail. The text passes through once, without a shuffle.
    """
    columns = docs.columns
    judged = _judged(docs, "text", tuple(columns))
    kept = judged.filter(passes(F.col("failures"), "base") & passes(F.col("failures"), version))
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])


def op9_quality(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
         length(t) - length(replace(t, '!', '')) AS n_exclamations, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), f AS (
  SELECT *, (@rules@)::INTEGER AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
""".replace("@rules@", " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values())))

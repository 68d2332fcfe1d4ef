"""Phrase collocation mining over a prefix-free parse of the corpus.

Texts are parsed into chunks whose ends the content triggers: a run of `max_words - 1` words whose hash is divisible by
`period` ends one chunk and begins the next, so that neighbours overlap in that run and equal passages are parsed
alike wherever they stand. The distinct chunks are the dictionary, their numbers the parse frequencies. Phrases are
counted inside distinct chunks, weighted by the frequency: a chunk that ends in a trigger leaves the phrases
that start in the overlap to its successor, which its own content shows, so each occurrence counts once.

Two passes over the dictionary keep rare phrases out of the shuffle of texts. The first adds up word pairs by a 64-bit
hash; pairs below the least count, which no candidate can hold, are left out by a bitmap of fixed size. Its
false positives only cost work: the second pass counts the phrases themselves, exactly.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import Scratch

#: Breaks become line feeds, tabs spaces, A-Z a-z; all of them are single bytes of UTF-8.
PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + string.ascii_uppercase.encode(), b"\n" * 9 + b" " + string.ascii_lowercase.encode())
#: Text that a task looks at together.
TOGETHER_BYTES = 4 << 20
#: The bitmap of frequent pairs has 2**27 bits (16 MB) in segments of 2**17.
BITMAP_BITS, SEGMENT_BITS = 27, 17


def plain(texts: pa.Array) -> pa.Array:
    """Lower-case texts whose pieces are lines and whose words are set apart by spaces; nulls are empty."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(PLAIN) if data is not None else b""
    return pa.Array.from_buffers(pa.large_string(), len(filled), [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(raw)])


def gather(words: pa.Array, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words of each run, joined by one space."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lengths)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.take(pa.array(at))), pa.scalar(" ", words.type))


def triggers(hashes: np.ndarray, offsets: np.ndarray, width: int, period: int) -> np.ndarray:
    """Whether a run of `width` words that triggers a cut starts at each word."""
    out = np.zeros(len(hashes), bool)
    runs = W.windows(hashes, width)
    out[: len(runs)] = (runs % np.uint64(period) == 0) & W.within(offsets, width)
    return out


def parse(docs: DataFrame, max_words: int, period: int) -> DataFrame:
    """(lang, chunk, n): the dictionary of the parse and its frequencies."""
    width = max_words - 1

    def run(batches):
        for part in W.slices(batches):
            lines = pc.split_pattern(plain(part.column(0)), "\n")
            row = np.repeat(np.arange(part.num_rows), np.diff(lines.offsets.to_numpy()))
            offsets, words = W.split(lines.flatten())
            if not len(words):
                continue
            cut = triggers(W.word_hashes(words), offsets, width, period)
            sizes = np.diff(offsets)
            cut[offsets[:-1][sizes > 0]] = True
            starts = np.flatnonzero(cut)
            piece = np.repeat(np.arange(len(sizes)), sizes)[starts]
            follows = np.concatenate([piece[1:] == piece[:-1], [False]])
            ends = np.where(follows, np.concatenate([starts[1:], [0]]) + width, offsets[piece + 1])
            chunks = gather(words, starts, ends - starts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(row[piece])), chunks], names=["lang", "chunk"])

    found = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, "lang string, chunk string")
    return found.groupBy("lang", "chunk").agg(F.count("*").alias("n"))


class Inside:
    """The words of a few chunks with, at each word, what phrases that start there count."""

    def __init__(self, table: pa.Table, max_words: int, period: int):
        langs, chunks, n = (table.column(c).combine_chunks() for c in ("lang", "chunk", "n"))
        self.offsets, self.words = W.split(chunks)
        self.size = np.diff(self.offsets)
        self.chunk = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.words)) - self.offsets[self.chunk]
        self.weight = n.to_numpy()[self.chunk]
        self.langs, lang = langs, langs.dictionary_encode()
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[self.chunk]
        seeds = W.word_hashes(lang.dictionary, 1)
        self.hashes = W.word_hashes(self.words)
        width = max_words - 1
        cut = triggers(self.hashes, self.offsets, width, period)
        tail = self.offsets[1:] - width
        over = (self.size > width) & cut[np.maximum(tail, 0)]
        self.owned = self.place < (self.size - np.where(over, width, 0))[self.chunk]
        # a pair that starts at the last word of a chunk is none; its hash is never looked at
        following = np.concatenate([self.hashes[1:], np.zeros(min(1, len(self.hashes)), np.uint64)])
        self.pairs = W.mix(W.mix(self.hashes ^ seeds[self.lang]) * np.uint64(3) + following) if len(self.words) else self.hashes

    def room(self, length: int) -> np.ndarray:
        """Whether `length` words from here lie in the chunk."""
        return self.place + length <= self.size[self.chunk]


def sums(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each key and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order[start], np.add.reduceat(weight[order], start) if len(k) else weight[:0]


def _together(batches):
    """Tables of about TOGETHER_BYTES of chunks."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TOGETHER_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held and size:
        yield pa.Table.from_batches(held)


def frequent_pairs(dictionary: DataFrame, max_words: int, period: int, least: int) -> np.ndarray:
    """A bitmap of 16 MB, whatever the corpus: bits of the hashes of all pairs that occur `least` times or more."""

    def count(batches):
        for table in _together(batches):
            inside = Inside(table, max_words, period)
            at = np.flatnonzero(inside.owned & inside.room(2))
            first, total = sums(inside.pairs[at], inside.weight[at])
            yield pa.RecordBatch.from_arrays([pa.array(inside.pairs[at][first].view(np.int64)), pa.array(total)], names=["hash", "c"])

    def segment(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SEGMENT_BITS, bool)
        bits[table.column("bit").to_numpy() & ((1 << SEGMENT_BITS) - 1)] = True
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    enough = dictionary.mapInArrow(count, "hash bigint, c bigint").groupBy("hash").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    bit = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1).alias("bit")
    bits = enough.select(bit).distinct().withColumn("segment", F.shiftright("bit", SEGMENT_BITS).cast("int"))
    out = np.zeros((1 << (BITMAP_BITS - SEGMENT_BITS), (1 << SEGMENT_BITS) // 8), np.uint8)
    for row in bits.groupBy("segment").applyInArrow(segment, "segment int, bits binary").collect():
        out[row["segment"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.reshape(-1)


def counts(dictionary: DataFrame, bitmap: np.ndarray, max_words: int, period: int, least: int) -> DataFrame:
    """(lang, phrase, f): phrases of 1 to `max_words` words with f >= `least`; the empty phrase has the number of words."""
    shared = dictionary.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        marks = shared.value
        for table in _together(batches):
            inside = Inside(table, max_words, period)
            if not len(inside.words):
                continue
            code, known = W.distinct(inside.words)
            bit = (inside.pairs & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
            frequent = (marks[bit >> 3] >> (7 - (bit & 7))) & 1 > 0
            at = np.flatnonzero(inside.owned)
            first, total = sums(inside.lang[at], inside.weight[at])
            yield out(inside, at[first], 0, total)
            group = inside.lang[at].astype(np.int64)
            for length in range(1, max_words + 1):
                if length > 1:
                    stay = inside.room(length)[at] & frequent[np.minimum(at + length - 2, len(frequent) - 1)]
                    at, group = at[stay], group[stay]
                # phrases of the same words up to the last have the same group, so equal keys are equal phrases
                _, group = np.unique(group * len(known) + code[at + length - 1], return_inverse=True)
                first, total = sums(group, inside.weight[at])
                yield out(inside, at[first], length, total)

    def out(inside: Inside, at: np.ndarray, length: int, total: np.ndarray) -> pa.RecordBatch:
        phrases = gather(inside.words, at, np.full(len(at), length)).cast(pa.string())
        return pa.RecordBatch.from_arrays([inside.langs.take(pa.array(inside.chunk[at])), phrases, pa.array(total)], names=["lang", "phrase", "c"])

    found = dictionary.mapInArrow(run, "lang string, phrase string, c bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def cohesion(known: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two or more words in `known` (lang, phrase, f), by their weakest cut.

    Products are decimals of 38 digits: exact below 3 * 10**15 occurrences, an error beyond.
    """
    word = F.split("phrase", " ")
    phrases = known.filter(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), word.alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.lit(max_words)), " ").alias("right"))
    left, right = (known.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])) for side in ("left", "right"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumns({"top": big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)"), "down": big("l") * big("r")})
    cut = F.struct(F.expr("top div down").alias("score"), "k", "l", "r")
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(cut).alias("cut"))
    return weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_inside(scored: DataFrame, max_words: int, share: int) -> DataFrame:
    """Drops phrases whose words lie inside a longer phrase that has `share` percent of their occurrences."""
    word = F.split("phrase", " ")
    longer = scored.select("lang", F.col("a").alias("f"), word.alias("w")).filter(F.size("w") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    parts = longer.select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    joined = scored.join(parts, ["lang", "phrase"], "left")
    return joined.filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * share)).drop("within")


def phrases(docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, share: int = 50, period: int = 32) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `max_words` words.

    `docs` has text and lang; other columns are left alone. Texts are lower-cased (A-Z), cut into pieces at
    `[.,;:!?\\x0A-\\x0D]` and those into words at spaces and tabs; whole texts count, however long, and repeated rows count
    each. A null text has no words, a null language is `und`. a, l and r are the numbers of occurrences of a phrase and
    of the two parts of its weakest cut, n of all words. Ties by score go to the larger a, then to the smaller phrase by
    bytes. An empty table, or one whose phrases all stay below `least`, gives no rows. `period` sets the mean length of
    chunks and changes no result.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    dictionary = scratch.save(parse(docs, max_words, period), "dictionary")
    bitmap = frequent_pairs(dictionary, max_words, period, least)
    known = scratch.save(counts(dictionary, bitmap, max_words, period, least), "counts")
    scratch.drop(dictionary)
    scored = scratch.save(cohesion(known, max_words), "scored")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within 64 parts of a language, so that a language's last task gets 64 * top rows at most, however large the corpus
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    parts = not_inside(scored, max_words, share).withColumn("part", part)
    near = parts.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("turn") <= top)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    words = known.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    out = first.join(words, "lang")
    return out.select("lang", *[F.col(c).cast("bigint") if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM pieces, range(1, 4) t(m))
  GROUP BY lang, m, phrase
), cuts AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, x.f AS l, y.f AS r, ((c.f::HUGEINT * c.f * 1000000) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m >= 2 AND f >= 10) c
  JOIN f x ON x.lang = c.lang AND x.m = k AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = array_to_string(w[k + 1:], ' ')
), scored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS t FROM cuts) WHERE t = 1
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM scored x WHERE x.m > s.m AND x.lang = s.lang AND 100 * x.a >= 50 * s.a
    AND list_contains([array_to_string(string_split(x.phrase, ' ')[1:2], ' '), array_to_string(string_split(x.phrase, ' ')[2:3], ' ')], s.phrase))
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""

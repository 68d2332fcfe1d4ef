"""Which of many terms a text contains, as plain substrings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.grid import first_of_each

#: Up to so many different terms one automaton of them goes to every task; beyond it candidates are joined.
BROADCAST_TERMS = 200_000
GRAM = 3
#: A task lets its hits go beyond so many.
FOUND_ROWS = 1 << 15


def contained_terms(items: DataFrame, terms: DataFrame, fields: dict[str, Column], carry: str | None = None) -> DataFrame:
    """(item_id, term, and a boolean a field): the terms that a field's text contains. Blank terms and null texts have none.

    `carry` names a column of numbers of the items that comes out after them, as double.

    Each text is read once against all different terms: by one automaton of them in every task, or, beyond
    BROADCAST_TERMS, by the ids of the texts that hold a term's rarest gram.
    """
    rows = items.select("item_id", *[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()], *([F.col(carry).cast("double").alias(carry)] if carry else []))
    wanted = terms.select("term").filter("term <> ''").distinct()
    known = [r["term"] for r in wanted.limit(BROADCAST_TERMS + 1).collect()]
    if not known:
        rows = rows.filter(F.lit(False))  # nothing to look for, so nothing is read
    return find(rows, known, carry) if len(known) <= BROADCAST_TERMS else by_grams(rows, wanted, carry)


def find(rows: DataFrame, known: list[str], carry: str | None = None) -> DataFrame:
    """The terms of a list, by an automaton. `rows` is item_id and text columns without nulls, and last the column `carry`."""
    names = [n for n in rows.columns[1:] if n != carry]
    more = [carry] if carry else []
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def hits(out):
        columns = list(zip(*out)) or [[]] * (2 + len(names) + len(more))
        types = [pa.int64(), pa.string(), *[pa.bool_()] * len(names), *[pa.float64()] * len(more)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "term", *names, *more])

    def run(batches):
        found = ahocorasick.Automaton()
        for i, term in enumerate(shared.value):
            found.add_word(term, i)
        found.make_automaton()
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                own = [{i for _, i in found.iter(c[row].as_py())} if shared.value else set() for c in batch.columns[1 : 1 + len(names)]]
                item, last = batch.column(0)[row].as_py(), [batch.column(-1)[row].as_py()] if more else []
                out += [(item, shared.value[i], *(i in o for o in own), *last) for i in set().union(*own)]
                if len(out) >= FOUND_ROWS:
                    yield hits(out)
                    out = []
            yield hits(out)

    return rows.mapInArrow(run, "item_id bigint, term string, " + ", ".join([f"`{n}` boolean" for n in names] + [f"`{n}` double" for n in more]))


def best_holders(rows: DataFrame, known: list[str], k: int) -> DataFrame:
    """(item_id, quality, term): items with a term of the list inside the text or as an element; a task gives the k best of each term, ties by id.

    `rows` is item_id, a text without nulls, an array of elements and quality, a double; one row an item.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def cut(item, quality, term):
        # places in the order of Spark: null is the least and NaN the most
        null = np.array([q is None for q in quality], bool)
        values, place = np.unique(np.array([np.inf if q is None else q for q in quality], float), return_inverse=True)
        at = first_of_each([np.array(term, np.int64)], np.where(null, -1, place), np.array(item, np.int64), k)
        return [[c[i] for i in at] for c in (item, quality, term)]

    def run(batches):
        place, automaton = {t: i for i, t in enumerate(shared.value)}, ahocorasick.Automaton()
        for term, i in place.items():
            if term:
                automaton.add_word(term, i)
        automaton.make_automaton()
        held: list[list] = [[], [], []]
        most = FOUND_ROWS
        for batch in batches:
            for item, text, elements, quality in zip(*(c.to_pylist() for c in batch.columns)):
                own = {i for _, i in automaton.iter(text)} if len(automaton) else set()
                own.update(place[e] for e in elements or () if e in place)
                for column, values in zip(held, ([item] * len(own), [quality] * len(own), own)):
                    column.extend(values)
                if len(held[0]) > most:
                    held = cut(*held)
                    most = max(FOUND_ROWS, 2 * len(held[0]))
        item, quality, term = cut(*held)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(quality, pa.float64()), pa.array([shared.value[i] for i in term], pa.string())], names=["item_id", "quality", "term"])

    return rows.mapInArrow(run, "item_id bigint, quality double, term string")


def holder(spark: SparkSession, known: list[str]) -> Callable[[Column], Column]:
    """A function from a text to the values of the list that it contains; null for null. An empty value is in every text."""
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values, automaton = shared.value, ahocorasick.Automaton()
        for i, value in enumerate(values):
            if value:
                automaton.add_word(value, i)
        automaton.make_automaton()
        always = {i for i, value in enumerate(values) if not value}
        for texts in batches:
            found = ((i for _, i in automaton.iter(t)) if t and len(automaton) else () for t in texts)
            yield pd.Series([None if t is None else [values[i] for i in always.union(own)] for t, own in zip(texts, found)], dtype=object)

    return held


def grams(rows: DataFrame) -> DataFrame:
    """(item_id, gram): the different runs of one to GRAM characters of each row's texts; only ids leave the texts."""
    names = rows.columns[1:]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]]
            for i, item in enumerate(ids):
                own = {t[j : j + n] for t in (c[i] for c in texts) for n in range(1, GRAM + 1) for j in range(len(t) - n + 1)}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(list(own), pa.string())], names=["item_id", "gram"])

    return rows.select("item_id", *names).mapInArrow(run, "item_id bigint, gram string")


def by_grams(rows: DataFrame, terms: DataFrame, carry: str | None = None) -> DataFrame:
    """Any number of terms: each is looked up by the one of its grams that the fewest texts hold, and each text that holds such a gram
    is then read once for all its terms. No row before that holds a text."""
    names, more = [n for n in rows.columns[1:] if n != carry], [carry] if carry else []
    index = grams(rows.select("item_id", *names))
    sizes = index.groupBy("gram").agg(F.count("*").alias("texts"))
    width = F.least(F.length("term"), F.lit(GRAM))
    own = terms.select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - width + 1), lambda i: F.substr("term", i, width)))).alias("gram"))
    rarest = own.join(sizes, "gram").groupBy("term").agg(F.min(F.struct("texts", "gram"))["gram"].alias("gram"))
    near = index.join(rarest, "gram").groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    marks = lambda t: F.struct(t.alias("term"), *[F.contains(F.col(n), t).alias(n) for n in names])
    seen = rows.join(near, "item_id").select("item_id", *more, F.filter(F.transform("terms", marks), lambda m: F.greatest(*[m[n] for n in names]) if len(names) > 1 else m[names[0]]).alias("m"))
    return seen.select("item_id", *more, F.explode("m").alias("m")).select("item_id", "m.term", *[F.col(f"m.`{n}`").alias(n) for n in names], *more)

"""Groups of terms scored where the texts are read.

A text is in one task, so what a query gets from its words is complete there: each task sums the weights of a group's terms in an item
and keeps the k best items of a group, and only those are shuffled. The groups are sent to all tasks in parts of at most some
`contains.BROADCAST_TERMS` rows, and the texts are read once for each of at most PARTS parts; there may be any number of texts.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import contains
from millrace.operators.grid import first_of_each

#: Bytes of texts that a task looks through at a time; it sums the terms when it has found so many, and lets its best rows go beyond so many.
SLICE_BYTES = 2 << 20
FOUND_TERMS = 1 << 16
HELD_ROWS = 1 << 20
#: Rows that a task cuts to its best at a time, at least.
CUT_ROWS = 1 << 18
#: Rows times groups up to which all sums are counted in place.
DENSE_CELLS = 1 << 20
#: Parts of the groups, each of which takes a reading of all texts.
PARTS = 16
#: Ranks are rounded to six digits, so values this near may be equal.
NEAR = 2e-6

#: Row, term and weight of what texts hold, ordered by row.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Makes, from the list of all terms, a function from columns of texts to the weights of the terms in each row, by their place in the list.
Matcher = Callable[[list[str]], Callable[[list[pa.Array]], Found]]

#: Bytes that words are made of: 1 a letter, 2 others.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[[*b"0123456789+.#-"]] = 2
WORD_BYTES[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1


def word_places(column: pa.Array, known: pa.Array, odd: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in `known` of each known word of lower-cased texts, in no certain order.

    Runs of WORD_BYTES that begin with a letter are words as they are, and are looked up at once; `odd` finds the words of the other runs.
    """
    # no run goes on into the next text
    ended = pc.binary_join_element_wise(column.cast(pa.large_string()), *(pa.scalar(c, pa.large_string()) for c in ("", "\n")))
    _, offsets, data = ended.buffers()
    offsets = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = WORD_BYTES[data]
    edges = np.flatnonzero(np.diff((kind > 0).view(np.int8), prepend=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    plain = kind[start] == 1
    others = np.flatnonzero(~plain & (end - start > 1) | (kind[start] == 2) & (data[start] >= 48) & (data[start] <= 57))
    row_of = lambda places: np.searchsorted(offsets, places, "right") - 1
    start, end, odd_start, odd_end = start[plain], end[plain], start[others], end[others]
    marks = np.zeros(len(data) + 1, np.int8)
    marks[start], marks[end] = 1, -1
    sizes = np.concatenate([[0], np.cumsum(end - start)])
    letters = data[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    words_ = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(sizes), pa.py_buffer(letters)])
    found = lambda w: pc.fill_null(pc.index_in(w, known), -1).to_numpy()
    at = found(words_)
    hit = np.flatnonzero(at >= 0)
    rest = [(i, w) for i, j, k in zip(row_of(odd_start).tolist(), odd_start.tolist(), odd_end.tolist()) for w in odd.findall(data[j:k].tobytes().decode())]
    more = found(pa.array([w for _, w in rest], pa.large_string()))
    rows = np.concatenate([row_of(start[hit]), np.array([i for i, _ in rest], np.int64)[more >= 0]])
    return rows, np.concatenate([at[hit], more[more >= 0]]).astype(np.int64)


def words(weights: list[float], token: str, stopwords) -> Matcher:
    """Terms as whole words: each place of a word counts the weight of its text; stop words have none.

    `token` takes a run of WORD_BYTES whole if it begins with a letter.
    """

    def make(terms):
        odd, place = re.compile(token), np.array([i for i, t in enumerate(terms) if t not in stopwords], np.int64)
        known = pa.array([terms[i] for i in place], pa.large_string())

        def match(texts):
            if not len(known):
                return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            found = [(*word_places(c, known, odd), w) for c, w in zip(texts, weights)]
            key, of = np.unique(np.concatenate([r * len(known) + t for r, t, _ in found]), return_inverse=True)
            # bincount adds place by place, as postings do
            total = np.bincount(of, np.concatenate([np.full(len(r), w) for r, _, w in found]), len(key))
            return key // len(known), place[key % len(known)], total

        return match

    return make


def substrings(points: list[float]) -> Matcher:
    """Terms as plain substrings: the points of the first text that contains one. Blank terms are nowhere."""

    def make(terms):
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            if term:
                automaton.add_word(term, i)
        automaton.make_automaton()

        def match(texts):
            found: list[dict[int, float]] = []
            for row in zip(*(c.to_pylist() for c in texts)):
                own: dict[int, float] = {}
                for text, n in zip(row, points):
                    if len(automaton):
                        for i in {i for _, i in automaton.iter(text)}:
                            own.setdefault(i, n)
                found.append(own)
            row = np.repeat(np.arange(len(found)), [len(o) for o in found])
            return row, np.array([i for o in found for i in o], np.int64), np.array([n for o in found for n in o.values()], float)

        return match

    return make


def slices(batch: pa.RecordBatch):
    """Parts of a batch, of some SLICE_BYTES each but for single long texts."""
    size = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.get_total_buffer_size()))
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def whole_rows(row: np.ndarray):
    """Slices of ordered rows, of some FOUND_TERMS each, that part no row."""
    start = 0
    while start < len(row):
        end = int(np.searchsorted(row, row[min(start + FOUND_TERMS, len(row)) - 1], "right"))
        yield slice(start, end)
        start = end


def leaders(group: np.ndarray, item: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """Positions of all rows that may be among a group's k best by r / (r + 1), rounded to six digits, with ties by id."""
    if not len(group):
        return np.zeros(0, np.int64)
    x = r / (r + 1)
    # of equal values the first k ids are enough
    at = first_of_each([group, -x], x, item, k)
    own = group[at]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.concatenate([start, [len(at)]]))
    x = x[at]
    kth = np.repeat(x[start + np.minimum(size, k) - 1], size)
    # where no other value is near the k-th, rounding makes none equal to it
    near = np.maximum.reduceat((np.abs(x - kth) <= NEAR) & (x != kth), start)
    place = np.arange(len(at)) - np.repeat(start, size)
    return at[(place < k) | np.repeat(near, size) & (x >= kth - NEAR)]


class Groups:
    """Groups (leg, query_id, choice) and their terms. An item fits a group of leg 0 with any of its terms, one of another leg with all."""

    def __init__(self, rows: list[tuple[int, int, int, str]]):
        self.terms = sorted({r[3] for r in rows})
        self.keys = np.array(sorted({r[:3] for r in rows}), np.int64).reshape(-1, 3)
        place, term = {tuple(g): i for i, g in enumerate(self.keys.tolist())}, {t: i for i, t in enumerate(self.terms)}
        of = np.array(sorted((term[t], place[leg, query, choice]) for leg, query, choice, t in set(rows)), np.int64).reshape(-1, 2)
        self.any = int((self.keys[:, 0] == 0).sum())  # leg 0 comes first
        some = of[of[:, 1] < self.any]
        self.group, self.start = some[:, 1], self.starts(some[:, 0], len(self.terms))
        whole = of[of[:, 1] >= self.any]
        spread = np.bincount(whole[:, 0], minlength=len(self.terms))
        # the terms of each other group, and the one of them that the fewest groups ask for, by which it is looked up
        whole = whole[np.lexsort((whole[:, 0], whole[:, 1]))]
        self.held, self.first = whole[:, 0], self.starts(whole[:, 1], len(self.keys))
        whole = whole[np.lexsort((whole[:, 0], spread[whole[:, 0]], whole[:, 1]))]
        rarest = whole[self.first[self.any : -1]]
        rarest = rarest[np.argsort(rarest[:, 0], kind="stable")]
        self.asking, self.asked = rarest[:, 1], self.starts(rarest[:, 0], len(self.terms))

    @staticmethod
    def starts(places: np.ndarray, n: int) -> np.ndarray:
        return np.searchsorted(places, np.arange(n + 1))

    @staticmethod
    def spread(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the lists that begin at `start[at]`: which of `at` each element belongs to, and its place."""
        n = start[at + 1] - start[at]
        of = np.repeat(np.arange(len(at)), n)
        return of, np.arange(len(of)) + np.repeat(start[at] - np.cumsum(n) + n, n)

    def sums(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, group and sum of weights, which are above 0, for each group that a row fits; of leg 0 the sums of `least` and more."""
        parts = self.some(row, term, weight, np.zeros(self.any) if least is None else least), self.whole(row, term, weight)
        return tuple(np.concatenate(c) for c in zip(*parts))

    def some(self, row, term, weight, least):
        at, place = self.spread(self.start, term)
        group, width = self.group[place], max(1, self.any)
        key, cells = row[at] * width + group, (int(row.max()) + 1 if len(row) else 0) * width
        if cells <= max(DENSE_CELLS, 4 * len(key)):
            total = np.bincount(key, weight[at], cells)
            key = np.flatnonzero((total.reshape(-1, width) >= least[: max(1, len(least))]) & (total.reshape(-1, width) > 0)) if self.any else np.zeros(0, np.int64)
            return key // width, key % width, total[key]
        key, of = np.unique(key, return_inverse=True)
        total = np.bincount(of, weight[at], len(key))
        fits = total >= least[key % width]
        return key[fits] // width, key[fits] % width, total[fits]

    def whole(self, row, term, weight):
        at, place = self.spread(self.asked, term)
        row_, group = row[at], self.asking[place]
        of, place = self.spread(self.first, group)
        order = np.lexsort((term, row))
        known, wanted = (row * len(self.terms) + term)[order], row_[of] * len(self.terms) + self.held[place]
        found = np.searchsorted(known, wanted)
        there = known[np.minimum(found, len(known) - 1)] == wanted if len(known) else np.zeros(0, bool)
        fits = np.bincount(of[~there], minlength=len(group)) == 0
        # added in the order of the terms
        total = np.bincount(of[there], weight[order][found[there]], len(group))
        return row_[fits], group[fits], total[fits]


def scored(rows: DataFrame, wanted: list[tuple[int, int, int, str]], matcher: Matcher, k: int) -> DataFrame:
    """(leg, query_id, choice, item_id, r): the items that fit a group, with the sum of the weights of its terms.

    Of leg 0 each task gives the rows that may be among a group's k best only, of other legs all. `rows` is item_id and lower-cased texts without nulls, one row
    an item; `wanted` is (leg, query_id, choice, term).
    """
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches) -> Iterator[pa.RecordBatch]:
        groups = Groups(shared.value)
        match = matcher(groups.terms)
        held: list[list[np.ndarray]] = []
        best = rows_ = 0
        least = np.zeros(groups.any)  # no smaller sum is among a group's k best

        def out(group, item, r):
            keys = groups.keys[group]
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1]), pa.array(keys[:, 2]), pa.array(item), pa.array(r)], names=["leg", "query_id", "choice", "item_id", "r"])

        def cut():
            group, item, r = (np.concatenate(c) for c in zip(*held))
            at = leaders(group, item, r, k)
            group, item, r = group[at], item[at], r[at]
            size = np.bincount(group, minlength=groups.any)
            full = size >= k
            kth = r[(np.cumsum(size) - size + k - 1)[full]]
            kth = kth / (kth + 1) - 2 * NEAR
            least[full] = np.maximum(least[full], kth / (1 - kth))
            return [[group, item, r]], len(group), len(group)

        for batch in batches:
            for part in slices(batch):
                found = match(part.columns[1:])
                for at in whole_rows(found[0]):
                    row, term, weight = (c[at] for c in found)
                    items_ = part.column(0).to_numpy()[row[0] :]
                    row, group, r = groups.sums(row - row[0], term, weight, least)
                    item, first = items_[row], group < groups.any
                    held.append([group[first], item[first], r[first]])
                    rows_ += int(first.sum())
                    # rows are cut when they have doubled, so each is sorted a few times only
                    if rows_ > max(CUT_ROWS, 2 * best):
                        held, best, rows_ = cut()
                    yield out(group[~first], item[~first], r[~first])
            if rows_ > HELD_ROWS and held:
                held, best, rows_ = cut()
                if best > HELD_ROWS:
                    yield out(*held[0])
                    held, best, rows_ = [], 0, 0
        if held:
            held, best, rows_ = cut()
            yield out(*held[0])

    return rows.mapInArrow(run, "leg int, query_id bigint, choice bigint, item_id bigint, r double")


def few(wanted: DataFrame) -> list[list[tuple[int, int, int, str]]] | None:
    """The rows (leg, query_id, choice, term) in parts that are small enough for all tasks, each of whole queries, or None if there would be too many.

    Null queries and terms have no hits.
    """
    most = contains.BROADCAST_TERMS
    rows = wanted.filter("query_id IS NOT NULL AND term IS NOT NULL").distinct()
    got = rows.limit(most + 1).collect()
    if len(got) <= most:
        return [[tuple(r) for r in got]]
    parts = math.ceil(1.25 * rows.count() / most)
    if parts > PARTS:
        return None
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    if max(sizes.values()) > 2 * most:
        return None
    return [[tuple(r) for r in rows.filter(part == i).collect()] for i in sorted(sizes)]


def scored_parts(rows: DataFrame, parts: list[list[tuple[int, int, int, str]]], matcher: Matcher, k: int) -> DataFrame:
    """`scored` for each part of `few`."""
    return functools.reduce(DataFrame.union, [scored(rows, part, matcher, k) for part in parts])

"""Benchmark decontamination by template canonicalisation.

Words are lowered and trimmed of marks; numbers, units and names (words with a capital inside a
sentence) become typed placeholders. Windows of five such tokens of the
documents are joined by hash with those of the benchmark. A document holds an item if
consistent matches cover 80 % of the item's windows: a slot value of the item must stand for
one value of the document throughout and the other way round. So a verbatim copy and one with
other numbers or names are both found, while chance matches of the bare template are not.

A window of placeholders alone says nothing of a template, so it counts only in items that have no other, and then
by its values; items of fewer than five tokens are one window of all of them, by their values too.

Who covers 80 % of the windows of an item covers one of any 20 % and one more: only these, the rarest of the
benchmark, are looked up, so that phrases that many items share bring no candidates. Candidates are then verified
on all windows. Items with one text are one shape. The shapes go to every task up to a bound on their windows; beyond
it window hashes are shuffled to find the candidates, and texts of candidates alone to verify them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import Scratch

WINDOW, PERCENT = 5, 80
#: Shapes with up to this many windows go to every task; a window takes some 100 bytes there.
BROADCAST_WINDOWS = 1_000_000
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec min h hr hrs day days week weeks month months year years mph kmh km/h hz khz mhz ghz w kw v kb mb gb tb usd eur gbp dollars euros cents percent % degrees".split()
)
_EDGES = ".,;:!?\"'()[]{}<>*#|-"
_NUMBER = re.compile(r"([$€£]?)[+-]?[0-9][0-9.,:/]*(.*)", re.S)
_STOPS = ".!?:"


_PLAIN, _NUM, _UNIT, _NAME = range(4)


class Words(dict):
    """What a word is by itself, worked out once a word: plain form, its hash, the slot it may be, whether it ends a sentence, and whether it is capitalised."""

    def __missing__(self, word: bytes) -> tuple[str, int, int, bool, bool]:
        text = word.decode("utf-8", "surrogatepass")
        plain = text.strip(_EDGES)
        low = plain.lower()
        capital = plain[:1].isupper() and plain[1:].islower()
        m = _NUMBER.fullmatch(plain) if plain and (plain[0].isdigit() or plain[0] in "$€£+-") else None
        if m and (not m[2] or m[2].lower() in UNITS):
            kind = _NUM
        elif low in UNITS:
            kind = _UNIT
        else:
            kind = _NAME if capital else _PLAIN
        found = self[word] = low, xxhash.xxh64_intdigest(low), kind, text[-1:] in _STOPS, capital
        return found


_SLOT_HASH = {t: xxhash.xxh64_intdigest(t) for t in (NUM, UNIT, NAME)}


def scan(text: str | None, words: Words | None = None) -> tuple[list[int], list[tuple[int, str, str]]]:
    """Hashes of the tokens, and the slots: place, placeholder and value.

    A number is a slot, a unit one behind a number, and a capitalised word one that does not open a sentence or line.
    """
    words = Words() if words is None else words
    hashes: list[int] = []
    slots: list[tuple[int, str, str]] = []
    add = hashes.append
    after_number = False
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        opening = True
        for word in line.split():
            low, h, kind, stops, capital = words[word]
            if kind == _PLAIN or not (kind == _NUM or kind == _UNIT and after_number or capital and not opening):
                after_number = False
                if low:
                    add(h)
            else:
                token = NUM if kind == _NUM else UNIT if kind == _UNIT and after_number else NAME
                after_number = token is NUM
                slots.append((len(hashes), token, low))
                add(_SLOT_HASH[token])
            opening = stops
    return hashes, slots


def window_hashes(hashes: np.ndarray, slots: list[tuple[int, str, str]], length: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of all windows of `length` tokens, and which of them are placeholders alone, None if none is.

    Short windows and those of placeholders alone are hashed with their values.
    """
    one = W.windows(hashes, length)
    bare = None
    if len(slots) >= length or length < WINDOW:
        slot = np.zeros(len(hashes) + 1, np.int64)
        slot[[i + 1 for i, _, _ in slots]] = 1
        so_far = np.cumsum(slot)
        bare = so_far[length:] - so_far[:-length] == length if len(hashes) >= length else np.zeros(0, bool)
        if length < WINDOW or bare.any():
            valued = hashes.copy()
            for i, token, value in slots:
                valued[i] = xxhash.xxh64_intdigest(f"{token}\x00{value}")
            one = np.where(bare | (length < WINDOW), W.mix(W.windows(valued, length) + np.uint64(length)), one)
    return one, bare


def slot_values(n: int, slots: list[tuple[int, str, str]]) -> list[str]:
    values = [""] * n
    for i, _, value in slots:
        values[i] = value
    return values


def shape_of(text: str) -> tuple[int, np.ndarray, np.ndarray, list[str]] | None:
    """Length of the windows, starts and hashes of those that count, and the values of all tokens."""
    found, slots = scan(text)
    if not found:
        return None
    length = min(WINDOW, len(found))
    hashes, bare = window_hashes(np.array(found, np.uint64), slots, length)
    use = np.arange(len(hashes)) if bare is None or bare.all() else np.flatnonzero(~bare)
    return length, use, hashes[use], slot_values(len(found), slots)


def rarest(hashes: np.ndarray, items: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Rows to look up: of each item, so many of its rarest windows that nobody covers `percent` without one of them."""
    _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.lexsort((counts[back], items))
    start = np.flatnonzero(np.concatenate([[True], np.diff(items[order]) != 0])) if len(order) else np.zeros(0, int)
    size = np.diff(np.append(start, len(order)))
    turn = np.arange(len(order)) - np.repeat(start, size)
    return np.sort(order[turn < np.repeat(size - _needed(size, percent) + 1, size)])


def _needed(n, percent: int):
    return np.maximum(1, -(-percent * n // 100))


def judge(places: np.ndarray, positions: np.ndarray, ours: list[str], theirs: list[str], length: int, n: int, percent: int = PERCENT) -> tuple[float, bool] | None:
    """Containment and whether it is verbatim, for windows at `places` of the item met at `positions` of the document.

    Matches are taken along diagonals (position less place), the longest first, each only if its
    slots agree with what has been taken.
    """
    order = np.lexsort((places, positions - places))
    places, positions = places[order], positions[order]
    diagonal = positions - places
    start = np.flatnonzero(np.concatenate([[True], np.diff(diagonal) != 0])) if len(places) else np.zeros(0, int)
    size = np.diff(np.append(start, len(places)))
    forth: dict[str, str] = {}
    back: dict[str, str] = {}
    covered: set[int] = set()
    for k in np.lexsort((places[start], -size)):
        line = slice(start[k], start[k] + size[k])
        for place, pos in zip(places[line].tolist(), positions[line].tolist()):
            if place in covered:
                continue
            pairs = [(a, b) for a, b in zip(ours[place : place + length], theirs[pos : pos + length]) if a or b]
            new_f, new_b = {}, {}
            if all(forth.get(a, new_f.setdefault(a, b)) == b and back.get(b, new_b.setdefault(b, a)) == a for a, b in pairs):
                forth |= new_f
                back |= new_b
                covered.add(place)
        if len(covered) == n:
            break
    if len(covered) < _needed(n, percent):
        return None
    return len(covered) / n, all(a == b for a, b in forth.items())


class _Document:
    """The tokens of one text and its windows of every length, sorted by hash when first asked for."""

    def __init__(self, text: str | None, words: Words):
        found, self.slots = scan(text, words)
        self.tokens = np.array(found, np.uint64)
        self.by_length: dict[int, list] = {}

    def hashes(self, length: int) -> np.ndarray:
        if length not in self.by_length:
            self.by_length[length] = [window_hashes(self.tokens, self.slots, length)[0], None, None]
        return self.by_length[length][0]

    def holds(self, length: int, places: np.ndarray, hashes: np.ndarray, values: list[str], percent: int) -> tuple[float, bool] | None:
        own = self.hashes(length)
        entry = self.by_length[length]
        if entry[1] is None:
            entry[1] = np.argsort(own, kind="stable")
            entry[2] = own[entry[1]]
        lo, hi = np.searchsorted(entry[2], hashes, "left"), np.searchsorted(entry[2], hashes, "right")
        times = hi - lo
        if np.count_nonzero(times) < _needed(len(hashes), percent):
            return None
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        positions = entry[1][np.repeat(lo, times) + within]
        return judge(np.repeat(places, times), positions, values, slot_values(len(self.tokens), self.slots), length, len(hashes), percent)


_SHAPE = "shape bigint, length int, places array<int>, hashes array<bigint>, slots array<string>"


def shapes_of(texts: DataFrame) -> DataFrame:
    """`texts` (shape, text) -> the shape of every text that has a token."""

    def run(batches):
        for batch in batches:
            rows = [(i, *found) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (found := shape_of(t))]
            i, length, places, hashes, values = zip(*rows) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()))
            columns = (i, length, [p.tolist() for p in places], [h.view(np.int64).tolist() for h in hashes], values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shape", "length", "places", "hashes", "slots"])

    return texts.mapInArrow(run, _SHAPE)


_LOW = np.uint64(0xFFFFF)
_OUT = "doc_id bigint, text_hash bigint, shape bigint, containment double, verbatim boolean"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text_hash", "shape", "containment", "verbatim"])


def _by_broadcast(docs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    rows = [(r["shape"], r["length"], np.array(r["places"], np.int64), np.array(r["hashes"], np.int64).view(np.uint64), r["slots"]) for r in shapes.orderBy("shape").toLocalIterator()]
    hashes = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    use = rarest(hashes, owner, percent)
    use = use[np.argsort(hashes[use], kind="stable")]
    shared = docs.sparkSession.sparkContext.broadcast((rows, hashes[use], owner[use], sorted({r[1] for r in rows})))

    def run(batches):
        rows, probe, owner, lengths = shared.value
        hint = np.zeros(int(_LOW) + 1, bool)  # most windows are told apart from all that are looked up by their last bits
        hint[(probe & _LOW).astype(np.int64)] = True
        for part in W.slices(batches):
            out, words = [], Words()
            for doc, mark, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                own = _Document(text, words)
                near: set[int] = set()
                for length in lengths:
                    h = own.hashes(length)
                    h = np.unique(h[hint[(h & _LOW).astype(np.int64)]])
                    lo, hi = np.searchsorted(probe, h, "left"), np.searchsorted(probe, h, "right")
                    for k in np.flatnonzero(hi > lo):
                        near.update(owner[lo[k] : hi[k]].tolist())
                for i in sorted(near):
                    verdict = own.holds(*rows[i][1:], percent)
                    if verdict:
                        out.append((doc, mark, rows[i][0], *verdict))
            yield _result(out)

    return docs.mapInArrow(run, _OUT)


def _by_join(docs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    lengths = [r["length"] for r in shapes.select("length").distinct().collect()]  # five at most

    def emit(batches):
        for part in W.slices(batches):
            words = Words()
            for doc, mark, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                own = _Document(text, words)
                for length in lengths:
                    h = np.unique(own.hashes(length)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(h), pa.int64()), pa.array([mark] * len(h), pa.int64()), pa.array(h)], names=["doc_id", "text_hash", "hash"])

    def verify(batches):
        for part in W.slices(batches, limit=1 << 20):
            out, words = [], Words()
            for r in part.to_pylist():
                verdict = _Document(r["text"], words).holds(r["length"], np.array(r["places"]), np.array(r["hashes"], np.int64).view(np.uint64), r["slots"], percent)
                if verdict:
                    out.append((r["doc_id"], r["text_hash"], r["shape"], *verdict))
            yield _result(out)

    windows = shapes.select("shape", F.size("hashes").alias("n"), F.posexplode("hashes").alias("place", "hash"))
    often = windows.groupBy("hash").agg(F.count("*").alias("often"))
    turn = F.row_number().over(Window.partitionBy("shape").orderBy("often", "place"))
    needed = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100))
    probe = windows.join(often, "hash").withColumn("turn", turn).filter(F.col("turn") <= F.col("n") - needed + 1).select("hash", "shape")
    pairs = docs.mapInArrow(emit, "doc_id bigint, text_hash bigint, hash bigint").join(probe, "hash").select("doc_id", "text_hash", "shape").distinct()
    p = pairs.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "shape")
    texts = docs.join(p, docs["doc_id"].eqNullSafe(p["p_id"]) & (docs["text_hash"] == p["p_hash"])).select("doc_id", "text_hash", "text", "shape")
    return texts.join(shapes, "shape").mapInArrow(verify, _OUT)


def _found(docs: DataFrame, benchmark: DataFrame, percent: int, broadcast_windows: int) -> DataFrame:
    """(doc_id, text_hash, item_id, containment, verbatim) for every text that holds an item; rows without an id have a null one."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text").filter("text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    # items with one text are one shape
    texts = scratch.save(items.select("text").distinct().withColumn("shape", F.monotonically_increasing_id()), "texts")
    shapes = scratch.save(shapes_of(texts.select("shape", "text")), "shapes")
    size = shapes.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first()["n"]
    found = (_by_broadcast if size <= broadcast_windows else _by_join)(docs, shapes, percent)
    ids = items.join(texts, "text").select("item_id", "shape")
    return found.join(ids, "shape").select("doc_id", "text_hash", "item_id", "containment", "verbatim")


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, containment, verbatim) for every item that a document holds.

    Null and empty texts, on either side, match nothing. Repeated rows give one
    pair; items with one text are all reported; of several texts under one id the best match counts. Rows without
    an id are not reported. Texts are read whole. Other columns are not read and do not come out. Empty tables give no rows.
    """
    found = _found(docs, benchmark, percent, broadcast_windows).filter("doc_id IS NOT NULL")
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"), F.bool_or("verbatim").alias("verbatim"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_ids: int = 2_000_000) -> DataFrame:
    """The rows of `docs`, with all columns as they are, that hold no item.

    A row goes only for its own text, so another text under its id stays; rows without an id are judged too.
    """
    out = _found(docs, benchmark, percent, broadcast_windows).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    drop = Scratch(docs.sparkSession, "decontaminate-drop").save(out, "drop")
    few = drop.count() <= broadcast_ids
    # qualified by the caller's frame, so that columns of any name pass
    same = docs["doc_id"].cast("bigint").eqNullSafe(drop["gone_id"]) & (F.xxhash64(docs["text"]) == drop["gone_text"])
    return docs.join(F.broadcast(drop) if few else drop, same, "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark)

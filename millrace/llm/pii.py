"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. Every word with a digit or an @ outside them is a further
site of a random field over the labels none, email, ip, card and phone. Sites that follow
each other share a chain potential; distant sites whose text is equal or similar (same digits, same
last seven digits, same mailbox) share a skip potential with one hub a key: the first base span
that has it, or else a node without a weight of its own. So edges grow with the sites and no
site is more than two hops from another. Loopy sum-product messages make their labels agree, so
a number that is written once with its marks and many times without is found each time. Base spans
are observed and act as weights of their neighbours; sites that the field labels become further spans.

All weights are fitted by pseudo-likelihood, on base spans as they stand and on base spans whose marks
are masked at learning, beside a marked twin and alone. So the strength of the skip potential is what
tells a bare number that is written with its marks elsewhere from any other.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.learning import bounded_sample, fit_in_one_task

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: The fit sees at most this many texts.
SAMPLE = 6000
NEAR = 200
#: Rounds, besides one a node, after which the messages move by half as much.
DAMP = 200

_ACTIVE = re.compile("[0-9@]")
_MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before the start cannot help a match, so runs of digits are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NUMERIC = re.compile(r"[0-9().+/-]+")
_OPEN, _CLOSE = "([{<\"'", ".,;:!?)]}>\"'"


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in code points, by start, then kind."""
    if not _ACTIVE.search(text):
        return []
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _MAILBOX:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def sites(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sites (start, end, label) by start: base spans with their label, other active words with -1."""
    out, at, cover = [(s, e, k + 1) for s, e, k in base], 0, sorted((s, e) for s, e, _ in base)
    for m in _WORD.finditer(text):
        word = m.group()
        if not _ACTIVE.search(word):
            continue
        start, end = m.start() + len(word) - len(word.lstrip(_OPEN)), m.end() - (len(word) - len(word.rstrip(_CLOSE)))
        while at < len(cover) and cover[at][1] <= start:
            at += 1
        if start >= end or any(s < end for s, e in cover[at : at + 2] if e > start):
            continue
        if out and out[-1][2] < 0 and start - out[-1][1] <= 2 and _NUMERIC.fullmatch(text[start:end]) and _NUMERIC.fullmatch(text[out[-1][0] : out[-1][1]].replace(" ", "")):
            out[-1] = (out[-1][0], end, -1)  # groups of digits are one number
        else:
            out.append((start, end, -1))
    return sorted(out)


def keys(surface: str) -> list[str]:
    """What distant sites share when they are equal or similar."""
    digits = "".join(c for c in surface if c.isdigit() and c.isascii())
    low = surface.lower()
    out = ["=" + low]
    if not any(c.isalpha() for c in surface):
        if len(digits) >= 7:
            out += ["#" + digits, "7" + digits[-7:]]
    elif "@" in low:
        out.append("@" + low.split("@")[0])
    else:
        out.append("@" + low)
    return out


_SIZES = np.array([1, 4, 7, 10, 13, 16, 20])
N_FEATURES = 22


def site_features(s: str, before: str) -> np.ndarray:
    """Features of a surface and of the two characters before it."""
    digits = sum(map(str.isdigit, s))
    before = before.strip()
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[1 + int(np.searchsorted(_SIZES, digits, side="right"))] = 1
    f[9:] = [
        "@" in s, s.count(".") == 3, "." in s, s.startswith("+"), "-" in s, "(" in s, " " in s,
        any(map(str.isalpha, s)), "=" in s or before.endswith("="), "/" in s, "%" in s or "$" in s, len(s) > 24, ":" in s,
    ]
    return f


def _edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Chain and skip edges, and how many nodes they have: key nodes are numbered after the sites.

    Sites of one key are linked to the first observed one of them, or else to a key node.
    """
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= NEAR]
    members: dict[str, list[int]] = {}
    for i, (s, e, _) in enumerate(found):
        for k in keys(text[s:e]):
            members.setdefault(k, []).append(i)
    skip, nodes = set(), len(found)
    for group in sorted({tuple(g) for g in members.values() if len(g) > 1}):  # keys with the same sites are one
        hub = next((i for i in group if found[i][2] > 0), nodes)
        nodes += hub == nodes
        skip.update((hub, i) for i in group if i != hub)
    return chain, sorted(skip), nodes


def _features_at(text: str, start: int, end: int) -> np.ndarray:
    return site_features(text[start:end], text[max(0, start - 2) : start])


def masked(surface: str, kind: int) -> str:
    """A mention without the marks by which its pattern finds it: bare digits, or a mailbox without its domain."""
    return surface.split("@")[0] + "@" if kind == 0 else "".join(c for c in surface if c.isdigit())


def _fit(table: pa.Table, steps: int = 300, rate: float = 0.5, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """All potentials by pseudo-likelihood: of each site given its neighbours on the chain and its hub.

    The hub of a site is the label that the other sites of its key have. The skip potential learns
    from sites that share a key, as they are, and from masked spans: each base span is masked
    and seen twice, beside its marked twin, where it has its kind, and alone, where it is none.
    """
    x, before, after, hub, y = [], [], [], [], []

    def example(features: np.ndarray, left: int, right: int, shared: int, label: int) -> None:
        for column, value in zip((x, before, after, hub, y), (features, left, right, shared, label)):
            column.append(value)

    for text in table.sort_by([("doc_id", "ascending"), ("text", "ascending")])["text"].to_pylist():
        found = sites(text, base_spans(text))
        chain, skip, _ = _edges(text, found)
        label = [max(0, k) for _, _, k in found]
        shared: dict[int, int] = {}
        to_find = set()
        for i, j in skip:
            if i < len(found):  # the hub is a base span
                shared[j] = label[i]
                to_find |= {j} if found[j][2] < 0 else set()
            else:
                shared.setdefault(j, 0)
        left, right = {j: i for i, j in chain}, dict(chain)
        for i, (s, e, k) in enumerate(found):
            if i in to_find:  # these are what the field has to find; they teach nothing
                continue
            sides = label[left[i]] if i in left else -1, label[right[i]] if i in right else -1
            example(_features_at(text, s, e), *sides, shared.get(i, -1), label[i])
            if k > 0 and (bare := masked(text[s:e], k - 1)) != text[s:e]:
                features = site_features(bare, text[max(0, s - 2) : s])
                example(features, -1, -1, k, k)
                example(features, -1, -1, -1, 0)
    n = len(LABELS)
    unary, trans, strength = np.zeros((N_FEATURES, n)), np.zeros((n, n)), 0.0
    if y:
        x, y, before, after, hub = map(np.array, (x, y, before, after, hub))
        want = np.eye(n)[y]
        one_b, one_a, one_h = (np.eye(n + 1)[v][:, :-1] for v in (before, after, hub))
        for _ in range(steps):
            z = x @ unary + one_b @ trans + one_a @ trans.T + strength * one_h
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - want) / len(y)
            unary -= rate * (x.T @ g * 10 + l2 * unary)
            trans -= rate * (one_b.T @ g + g.T @ one_a + l2 * trans)
            strength -= rate * (float((g * one_h).sum()) * 10 + l2 * strength)
    return {"unary": unary, "chain": trans, "skip": np.eye(n) * strength}


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fit on at most `sample` different texts that hold a digit or an @, the first by hash of the text."""
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    chosen = bounded_sample(rows.select(F.lit("").alias("doc_id"), "text"), sample, F.xxhash64("text"))
    return fit_in_one_task(chosen, _fit)


def _belief(score: np.ndarray, edges: list[tuple[int, int, np.ndarray]], tolerance: float = 1e-4) -> np.ndarray:
    """Marginals by damped loopy sum-product until no message moves by more than `tolerance`; log domain.

    Every DAMP rounds the steps get shorter, so messages that swing come to rest too.
    """
    if edges:
        a, b = (np.array([e[k] for e in edges]) for k in (0, 1))
        pot = np.stack([e[2] for e in edges])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), score.shape[1]))
        rounds, moved = 0, np.inf
        while moved > tolerance:
            total = score.copy()
            np.add.at(total, dst, msg)
            out = (total[src] - msg[back])[:, :, None] + pot
            new = np.logaddexp.reduce(out, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            step = 0.5 ** (1 + rounds // (DAMP + len(score)))
            moved, rounds = step * np.abs(new - msg).max(), rounds + 1
            msg = msg + step * (new - msg)
        score = score.copy()
        np.add.at(score, dst, msg)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, model: dict[str, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added spans, by start, then kind."""
    base = base_spans(text)
    if not model or not _ACTIVE.search(text):
        return base, base
    found = sites(text, base)
    open_at = [i for i, s in enumerate(found) if s[2] < 0]
    if not open_at:
        return base, base
    chain, skip, nodes = _edges(text, found)
    score = np.zeros((nodes, len(LABELS)))
    score[open_at] = np.array([_features_at(text, *found[i][:2]) for i in open_at]) @ model["unary"]
    observed, edges = [max(0, s[2]) for s in found] + [0] * (nodes - len(found)), []
    for pairs, pot in ((chain, model["chain"]), (skip, model["skip"])):
        for i, j in pairs:
            if not observed[i] and not observed[j]:
                edges.append((i, j, pot))
            elif not observed[j]:
                score[j] += pot[observed[i]]
            elif not observed[i]:
                score[i] += pot[:, observed[j]]
    p = _belief(score, edges)
    added = [(found[i][0], found[i][1], int(p[i].argmax()) - 1) for i in open_at if p[i].argmax() > 0 and p[i].max() >= 0.5]
    return base, sorted(base + added, key=lambda s: (s[0], s[2]))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans for every row of `docs`.

    A null or empty text has no spans, nor has any text in an empty table. Repeated rows get equal answers; spans with
    one start are ordered by kind. Texts are read whole, some megabytes of them at a time. Other columns are not read
    and do not come out. No shuffle; the model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS]

    def run(batches):
        for part in W.slices(batches):
            counts, sha, joined = [], [], []
            for t in part.column(1):
                base, spans = all_spans(t.as_py() or "", shared.value)
                counts.append([sum(s[2] == k for s in base) for k in range(len(KINDS))])
                sha.append(hashlib.sha256(digest(base).encode()).hexdigest())
                joined.append(digest(spans))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(sha), pa.array(joined)], names=["doc_id", *names, "base_sha256", "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """All rows and columns of `docs`, with spans in `text` replaced; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for part in W.slices(batches):
            texts = [None if t is None else redacted(t, all_spans(t, shared.value)[1]) for t in part.column(at).to_pylist()]
            yield part.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, train(docs))

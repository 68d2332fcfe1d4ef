"""Main text of web pages by equivalence-class template deduction.

Tokens are element paths and blocks of text at a path. Tokens of one host that occur equally often in
each page, that is with one occurrence vector over the host's pages, form an equivalence class.
Vectors are compared by a sum of hashes over (page, count), so they build up in
partial aggregates and no host meets in one task. Pages with equal main text count as one, so copies
of a page do not make its text constant. A class is valid if enough different pages support it and
it holds elements. Classes are nested by path: text is a constant of the template if its class holds
an element that encloses it, under an article as elsewhere. What remains are the template's slots.
Tags only rank them: slots under an article come first, others join them if they hold as many words;
slots of menus, adverts, forms, comments and the like are left out, and outside of articles those that
hold links rather than prose.

Work and memory grow with the length of a page: elements nested deeper than DEPTH have no path of their own, as
in browsers, whose trees end at some depth too; their text is text of the deepest one that has.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import Scratch
from millrace.llm.url_filter import host_of

#: Different pages that must support a class.
SUPPORT = 3
#: Templates with up to this many tokens go to every task; a token takes some 100 bytes there.
BROADCAST_TOKENS = 500_000
DEPTH = 100
SALTS = 32

#: A quote opens a value after = only, and only if white space, / or > follows where it closes; any other quote is a character.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+)*+)>|[!?][^>]*>)""", re.S)
_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "svg", "math", "object", "select")}
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP_ELEMENTS = frozenset("nav footer aside button dialog menu fieldset datalist input label audio video canvas head".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs footer comment comments reply replies discussion disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager search tags hidden skip print".split()
)
#: Parts of compound names that say where or what a part of a page is; a name with any other part is a name of its own.
NEUTRAL_NAMES = frozenset(
    "area bar block body bottom box btn button buttons card cards col column container content count entry feed form global group head header icon icons inner item items layout left link links list main module outer page panel post posts primary right row secondary section site slot small text title top unit wrap wrapper".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN_NAMES = frozenset("article post entry story content articlebody main".split())
_CLOSES_P = BLOCK - {"html", "body", "head"}
#: A closing tag reaches through these only if it is one of the others.
_WALLS, _THROUGH = frozenset("td th article main".split()), frozenset("table body html article main section div".split())
_ROOT = xxhash.xxh64("p\x00")


def _names(attributes: str) -> tuple[set[str], bool, bool, str, bool]:
    """Names of an element and their parts, whether one is to be left out, whether only compound ones are, role, hidden."""
    names, drop, single, role, hidden = set(), False, False, "", False
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            role = value
        elif key == "hidden" or key == "aria-hidden":
            hidden |= key == "hidden" or value == "true"
        else:
            for name in value.split():
                parts = {x for x in re.split(r"[-_]+", name) if x}
                names.add(name)
                names |= parts
                if parts & DROP_NAMES and parts <= DROP_NAMES | NEUTRAL_NAMES:
                    drop, single = True, single or len(parts) == 1
    return names, drop, drop and not single, role, hidden


class _Open:
    """The open elements of a page, with counts by name, so that closing tags without a partner cost nothing."""

    def __init__(self):
        self.stack: list[tuple] = []  # name, dropped, rank, whether it has a path, the elements around that names leave out
        self.blocks: list[int] = []
        self.total: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]
        self.walls: list[str] = []
        self.hashes, self.path = [_ROOT], (_token(_ROOT),)

    def push(self, name: str, label: str, dropped: bool, rank: int, named: tuple[int, ...]) -> int | None:
        """The token of the element's path, if it has one."""
        pathed = name in BLOCK and len(self.hashes) <= DEPTH
        if pathed:
            here = self.hashes[-1].copy()
            here.update(label + "\x00")
            self.hashes.append(here)
            self.path = (*self.path, _token(here))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, dropped, rank, pathed, named))
        for counts in (self.total, self.scopes[-1]):
            counts[name] = counts.get(name, 0) + 1
        if name in _WALLS:
            self.walls.append(name)
            self.scopes.append({})
        return self.path[-1] if pathed else None

    def pop_to(self, k: int) -> None:
        gone = 0
        for name, _, _, pathed, _ in reversed(self.stack[k:]):
            if name in _WALLS:
                self.walls.pop()
                self.scopes.pop()
            self.total[name] -= 1
            self.scopes[-1][name] -= 1
            if name in BLOCK:
                self.blocks.pop()
            gone += pathed
        del self.stack[k:]
        if gone:
            del self.hashes[-gone:]
            self.path = self.path[:-gone]

    def find(self, name: str) -> int | None:
        """Where the element stands that a closing tag closes."""
        near = self.scopes[-1].get(name) or (self.walls and self.walls[-1] == name)
        if not (self.total.get(name) if name in _THROUGH else near):
            return None
        return next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == name)


def _token(h) -> int:
    return h.intdigest() - (1 << 63)


def blocks(html: str | None, seen: dict[int, int] | None = None) -> list[tuple[tuple[int, ...], str, int, bool, int]]:
    """(path, text, words in links, dropped, rank of the main container) for every block with text.

    A path is the tokens of the page and of the block elements around, from the outermost on. The
    rank is 2 inside an article or main element, 1 inside an element named like one, else 0.
    `seen` gets how often each path of elements occurs. Elements that names leave out, and forms, are judged by what they hold, at
    the end of the page; see _wrappers. Names say nothing of an element within a line, and text that is left out within a line
    leaves its block whole.
    """
    out, parts, linked = [], [], 0
    named_at: list[tuple[int, bool]] = []  # rank around, whether all its names are compound
    tree = _Open()
    stack = tree.stack
    at = end = 0
    html = html or ""
    last = html.rfind(">")

    def flush() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            _, dropped, rank, _, named = stack[tree.blocks[-1]] if tree.blocks else ("", False, 0, False, ())
            out.append((tree.path, text, linked, dropped, rank, named))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][1] and not (tree.blocks and stack[tree.blocks[-1]][1]):
            parts.append(" ")  # left out within a line
            return
        parts.append(text)
        if any(s[0] == "a" for s in stack[-4:]):
            linked += len(text.split())

    def pop_to(k: int) -> None:
        if any(s[0] in BLOCK for s in stack[k:]):
            flush()
        tree.pop_to(k)

    while at <= last:
        m = _TAG.search(html, at)
        if not m:
            break
        if m.start() > end:
            add(html[end : m.start()])
        at = end = m.end()
        closing, name, attributes = m.groups()
        if not name:
            continue
        name = name.lower()
        if closing:
            k = tree.find(name)
            if k is not None:
                pop_to(k)
            continue
        if name in _RAW:
            close = _RAW[name].search(html, end)
            at = end = close.end() if close else len(html)
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr", "img"):
                parts.append(" " if name == "br" else "")
            continue
        names, drop_name, compound, role, hidden = _names(attributes) if attributes else (set(), False, False, "", False)
        if name in _CLOSES_P:
            if tree.blocks and stack[tree.blocks[-1]][0] == "p":
                pop_to(tree.blocks[-1])
            flush()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            pop_to(len(stack) - 1)
        dropped, rank, named = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, 0, ())
        # beyond DEPTH of them an element goes or stays with those around it
        if len(named) < DEPTH and (name == "form" or drop_name and name in BLOCK and name not in ("html", "body", "article", "main")):
            named = (*named, len(named_at))
            named_at.append((rank, compound or name == "form" and not drop_name))
        if name in ("article", "main") or role in ("article", "main"):
            rank = 2
        elif names & MAIN_NAMES and name in BLOCK and name != "body":
            rank = max(rank, 1)
        drop = hidden or name in DROP_ELEMENTS or role in DROP_ROLES or (name == "header" and rank < 2)
        label = ".".join([name, *sorted(names)]).replace(">", "") if names else name
        if attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        token = tree.push(name, label, dropped or drop, rank, named)
        if token is not None and seen is not None:
            seen[token] = seen.get(token, 0) + 1
    if len(html) > end:
        add(html[end:])
    flush()
    kept = _wrappers(out, named_at) if named_at else frozenset()
    return [(path, text, links, dropped or not kept.issuperset(named), rank) for path, text, links, dropped, rank, named in out]


def _wrappers(found: list[tuple], named_at: list[tuple[int, bool]]) -> frozenset[int]:
    """Which of the elements that names leave out wrap the page's main slot, so that they stay.

    Where all text of articles and main elements lies in such elements, the one with the most of it stays; where there is no such text
    and most prose lies in one whose names are compound, that one does. Then the same holds inside of it.
    """
    inside = [(named, rank, max(0, len(text.split()) - links)) for _, text, links, dropped, rank, named in found if not dropped]
    articles = [x for x in inside if x[1] == 2]
    all_prose = sum(n for _, _, n in inside)
    kept: list[int] = []
    slots = articles or inside
    while slots and (not articles or all(len(named) > len(kept) for named, _, _ in slots)):
        prose: dict[int, int] = {}
        for named, _, n in slots:
            if len(named) > len(kept):
                prose[named[len(kept)]] = prose.get(named[len(kept)], 0) + n
        if not prose:
            break
        best = max(prose, key=lambda e: (prose[e], -e))
        rank, compound = named_at[best]
        if rank == 2 or not articles and not (compound and 2 * prose[best] > all_prose):
            break
        kept.append(best)
        slots = [x for x in slots if x[0][: len(kept)] == tuple(kept)]
    return frozenset(kept)


def _page_only() -> dict[int, int]:
    return {_token(_ROOT): 1}


def _text_token(path: tuple[int, ...], text: str) -> int:
    return xxhash.xxh64_intdigest(f"t\x00{path[-1]}\x00{text}") - (1 << 63)


def tokens(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, page, n, words, linked, above): one row a different page and token.

    `page` is a hash of the text in the best container; `above` are the enclosing elements that occur as often as the text.
    """

    def run(batches):
        for part in W.slices(batches, "html"):
            rows = []
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen = _page_only()
                found = blocks(html, seen)
                page = xxhash.xxh64_intdigest(main_text(found, frozenset())) - (1 << 63)
                texts: dict[int, list] = {}
                held: dict[int, list[int]] = {}
                for path, text, linked, dropped, _ in found:
                    n = len(text.split())
                    c = held.setdefault(path[-1], [0, 0])
                    held[path[-1]] = [c[0] + n, c[1] + linked]
                    if not dropped:  # dropped text needs no template
                        c = texts.setdefault(_text_token(path, text), [0, 0, 0, path])
                        c[:3] = c[0] + 1, c[1] + n, c[2] + linked
                for token, n in seen.items():
                    rows.append((host, token, False, page, n, *held.get(token, (0, 0)), None))
                for token, (n, words, linked, path) in texts.items():
                    rows.append((host, token, True, page, n, words, linked, [t for t in path if seen[t] == n]))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "token", "is_text", "page", "n", "words", "linked", "above"])

    found = pages.select("host", "html").mapInArrow(run, "host string, token bigint, is_text boolean, page bigint, n bigint, words bigint, linked bigint, above array<bigint>")
    most = [F.max(c).alias(c) for c in ("n", "words", "linked", "above")]
    return found.groupBy("host", "token", "is_text", "page").agg(*most)


def template(pages: DataFrame, scratch: Scratch, support: int = SUPPORT) -> DataFrame:
    """(host, token): constants of the hosts' templates and paths that hold links rather than prose.

    The sum of hashes of (page, count) stands for a token's occurrence vector. An element of the same class
    that encloses a text has its count on each page, so it is in `above` on each of them.
    """
    vectors = tokens(pages).groupBy("host", "token", "is_text").agg(
        F.count("*").alias("pages"),
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"),
        F.sum("words").alias("words"),
        F.sum("linked").alias("linked"),
        F.max("above").alias("above"),
    )
    links = ~F.col("is_text") & (2 * F.col("linked") > F.col("words"))
    known = scratch.save(vectors.filter(links | (F.col("pages") >= support)), "vectors")
    often = known.filter(F.col("pages") >= support)
    texts = often.filter("is_text").select("host", "token", "pages", "vector", F.explode("above").alias("path"))
    elements = often.filter("NOT is_text").select("host", F.col("token").alias("path"), "pages", "vector")
    constants = texts.join(elements, ["host", "path", "pages", "vector"], "left_semi").select("host", "token").distinct()
    return constants.union(known.filter(links).select("host", "token"))


def main_text(found: list[tuple[tuple[int, ...], str, int, bool, int]], known: frozenset[int] | set[int]) -> str:
    slots = []
    for path, text, _, dropped, rank in found:
        if dropped or known and (_text_token(path, text) in known or rank < 2 and path[-1] in known):
            continue
        slots.append((rank, text))
    words = [sum(len(t.split()) for r, t in slots if r == rank) for rank in range(3)]
    least = max((r for r, _ in slots), default=0)
    for rank in range(least - 1, -1, -1):
        if words[rank] and words[rank] >= sum(words[rank + 1 :]):
            least = rank
    return "\n".join(t for r, t in slots if r >= least)


def extract(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS, support: int = SUPPORT) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages` (page_id, url, html).

    A null or empty html gives an empty text, a null url the host "". Repeated rows get equal texts, an empty table no
    rows; of slots with equally many words the better ranked ones are taken. Pages are read whole, however long. Other
    columns are not read and do not come out. The templates go to every task up to `broadcast_tokens`
    tokens; beyond it they are joined by host, each host in SALTS parts.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    scratch = Scratch(pages.sparkSession, "html")
    rows = scratch.save(template(pages, scratch, support), "template")
    small = rows.count() <= broadcast_tokens
    by_host: dict[str, set[int]] = {}
    if small:
        for r in rows.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["token"])
        source = pages
    else:
        lists = rows.groupBy(F.col("host").alias("t_host")).agg(F.collect_list("token").alias("known"))
        lists = lists.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        source = salted.join(lists, (salted["host"] == lists["t_host"]) & (salted["salt"] == lists["t_salt"]), "left").select(*pages.columns, "known")
    shared = pages.sparkSession.sparkContext.broadcast(by_host)

    def run(batches):
        for part in W.slices(batches, "html"):
            texts = []
            for i, (html, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                known = shared.value.get(host, frozenset()) if small else set(part.column(4)[i].as_py() or ())
                texts.append(main_text(blocks(html), known))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

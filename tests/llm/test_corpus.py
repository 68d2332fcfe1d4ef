"""Corpus operators against brute force, and their defined results in odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, html_text, language_id, mixing, near_dup, pii, quality, substring_dedup, toxicity, url_filter
from millrace.llm.learning import fold

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, **more):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), "x", "y", "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    draw = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    base = [draw.choice(words) + chr(97 + draw.randrange(26)) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, " ".join(base)), (7, " ".join(base)), (None, " ".join(base)), (8, " ".join(base[:100] + ["x"] + base[100:]))]
    rows += [(9, " ".join(base[30:70])), (10, "y " * 5000), (11, " ".join(base[50:] + base[:80])), (6, " ".join(base)), (12, "é" * 30000), (13, "a b c d\x1ce")]
    rows += [(20 + k, " ".join(w if draw.random() > 0.02 else f"q{draw.randrange(9)}" for w in base)) for k in range(30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_rows()).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dup_brute_force(docs, empty):
    rows = {i: shingles(t) for i, t in odd_rows() if i is not None}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 85 * len(rows[a] | rows[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_dup.groups(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(rows[r["doc_id"]]), find(r["doc_id"]), r["doc_id"] == find(r["doc_id"]))
    assert near_dup.groups(empty).count() == 0
    assert near_dup.keep_one(docs).columns == docs.columns


def test_superminhash_estimates_jaccard():
    draw = np.random.default_rng(2)
    shared, own = draw.integers(0, 2**63, 170, dtype=np.uint64), draw.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = np.concatenate([shared, own[:30]]), np.concatenate([shared, own[30:]])
    s = near_dup.superminhash(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
    assert abs((s[0] == s[1]).mean() - 170 / 230) < 0.2
    single = near_dup.superminhash(np.array([0, 1]), a[:1])
    assert np.isfinite(single).all() and sorted(np.floor(single[0])) == list(range(near_dup.SLOTS))


def test_substring_brute_force(docs, empty):
    rows = sorted({(i if i is not None else 2**63 - 1, t) for i, t in odd_rows()}, key=lambda r: (r[0], r[1] or ""))
    seen, want = set(), {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone.update(range(k, k + 20))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = substring_dedup.deduplicate(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        key = r["doc_id"] if r["doc_id"] is not None else 2**63 - 1
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) == want[key]
    assert substring_dedup.deduplicate(empty).count() == 0


def test_difference_cover():
    for shift in range(substring_dedup.PERIOD):
        assert any((c + shift) % substring_dedup.PERIOD in substring_dedup.COVER for c in substring_dedup.COVER)


def test_substring_ids_with_two_texts(spark):
    long = " ".join(f"a{i}" for i in range(30))
    out = substring_dedup.deduplicate(frame(spark, [(1, long), (1, "short text"), (2, long)])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in out) == [(1, 2, 0), (1, 30, 0), (2, 30, 30)]


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert (got[1]["n_words"], got[1]["kept"]) == (0, False)
    assert got[10]["n_repeat_words"] == 5000 and got[10]["base_failed"]
    assert got[13]["n_words"] == 3 and got[13]["word_chars"] == 7
    assert got[6]["kept"]
    assert quality.judge(docs).count() == len(odd_rows()) and quality.judge(empty).count() == 0
    assert quality.keep(docs).columns == docs.columns
    led = quality.ledger(docs)
    ablation = {r["rule"]: r for r in quality.ablation(led).collect()}
    assert ablation["few_words"]["n_failed"] == sum(len(WORD.findall(t or "")) < 50 for _, t in odd_rows())


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(odd_rows())
    total = sum(r["size"] for r in mixing.mix(docs).select(F.regexp_count("text", F.lit(mixing.WORD)).alias("size")).collect() if r["size"])
    targets = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert sum(t for t, _ in targets.values()) == pytest.approx(min(1.5 * total, sum(2 * s for _, s in targets.values())))
    assert all(t <= 2 * s + 1e-6 for t, s in targets.values())
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken")
    assert again.exceptAll(mixing.mix(docs).select("doc_id", "taken")).count() == 0
    salted = mixing.mix(docs, broadcast_sources=-1).select("doc_id", "taken")
    assert salted.exceptAll(again).count() == 0
    assert mixing.mix(empty).count() == 0
    none = frame(spark, [(1, "a b c")]).withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(none).first()["source_size"] == 3


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0
    assert got["b"] + got["c"] == pytest.approx(2010 * 1.5 - 20) and got["b"] / got["c"] == pytest.approx(2)


def test_pii(spark, docs, empty):
    text = "Mail a.b@mail.example.com, call +1 (243) 555-7962 or 12435557962 from 10.0.0.1; card 4111 1111 1111 1111. Again 12435557962"
    base = pii.base_spans(text)
    assert [(text[s:e], pii.KINDS[k]) for s, e, k in base] == [("a.b@mail.example.com", "email"), ("+1 (243) 555-7962", "phone"), ("10.0.0.1", "ip"), ("4111 1111 1111 1111", "card")]
    learn = frame(spark, [(i, f"word token x{i} and v2.{i} 4.0 then +1 (24{i % 10}) 555-79{i:02d} in 2024 at a{i}@b.example.org") for i in range(60)])
    model = pii.train(learn)
    _, spans = pii.all_spans(text, model)
    assert sum(text[s:e] == "12435557962" and pii.KINDS[k] == "phone" for s, e, k in spans) == 2
    assert set(base) <= set(spans)
    assert "555-7962" not in pii.redacted(text, spans) and "[EMAIL]" in pii.redacted(text, spans)
    out = pii.find(docs, model)
    assert out.count() == len(odd_rows()) and pii.find(empty, {}).count() == 0
    assert pii.redact(docs, model).columns == docs.columns and pii.redact(docs, model).filter("text IS NULL").count() == 1
    assert pii.train(empty) == {} or pii.all_spans("a", pii.train(empty)) == ([], [])
    long = "1" * 100_000 + " " + "a@" * 20_000
    assert pii.base_spans(long) == []


def test_pii_many_repeats():
    unary = np.zeros((pii.N_FEATURES, len(pii.LABELS)))
    unary[0, 0] = 2.0  # every open site is rather none
    model = {"unary": unary, "chain": np.zeros((len(pii.LABELS),) * 2), "skip": np.eye(len(pii.LABELS)) * 8}
    for n in (1, 2, 5, 13, 30, 300):
        text = "call +1 (243) 555-7962" + " or then 12435557962 again" * n
        _, spans = pii.all_spans(text, model)
        assert [pii.KINDS[k] for _, _, k in spans] == ["phone"] * (n + 1)
        assert "12435557962" not in pii.redacted(text, spans)
        first = " or then 12435557962 again" * n + " call +1 (243) 555-7962"  # the marked one comes last
        assert "12435557962" not in pii.redacted(first, pii.all_spans(first, model)[1])
        assert pii.all_spans("or then 12435557962 again " * n, model)[1] == []
    # a key without a base span: one site of 21 that is surely a phone carries the others
    score = np.zeros((22, 2))
    score[0, 1] = 20.0
    p = pii._belief(score, [(21, i, np.eye(2) * 4) for i in range(21)])
    assert (p[1:21, 1] > 0.9).all()
    # a chain carries to its end
    p = pii._belief(score, [(i, i + 1, np.eye(2) * 8) for i in range(21)])
    assert (p[:, 1] > 0.9).all()
    # messages that swing come to rest
    assert np.isfinite(pii._belief(np.random.default_rng(1).normal(size=(9, 2)), [(i, j, (np.eye(2) - 0.5) * 9 * (-1) ** (i + j)) for i in range(9) for j in range(i)])).all()


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "Tom bought 12 apples and then gave Anna 5 of the apples for 3 days in the park."), (2, None), (3, ""), (4, "too few")], "item_id bigint, text string")
    rows = [
        (100, "start here. Tom bought 12 apples and then gave Anna 5 of the apples for 3 days in the park. more"),
        (101, "so Tom bought 40 apples and then gave Maria 7 of the apples for 9 days in the park. end"),
        (102, "Tom bought some pears and then went home to sleep for a while in the garden"),
        (103, None),
        (104, ""),
    ]
    held = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.leaks(held, bench).collect()}
    assert got == {(100, 1): True, (101, 1): False}
    joined = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.leaks(held, bench, broadcast_windows=-1).collect()}
    assert joined == got
    assert sorted(r["doc_id"] for r in decontaminate.clean(held, bench).collect()) == [102, 103, 104]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(held, bench.limit(0)).count() == 0


def test_slots_must_agree():
    ours, places = ["tom", "", "5", "tom"], np.array([0, 1])
    assert decontaminate.judge(places, places, ours, ["ann", "", "9", "ann"], 3, 2) == (1.0, False)
    assert decontaminate.judge(places, places, ours, ["ann", "", "9", "eve"], 3, 2) is None


def test_decontamination_short_and_bare_items(spark):
    texts = {1: "Zeta omega kappa", 2: "12 34 56 78 90", 3: "12 34 56 78 90 apples were in the box today", 4: "Zeta omega kappa"}
    bench = spark.createDataFrame(list(texts.items()), "item_id bigint, text string")
    held = frame(spark, [(1, "well, zeta omega kappa it is"), (2, "7 12 34 56 78 90 8"), (3, "1 2 3 4 5 6 7 8 9"), (4, "1 2 3 4 5 apples were in the box today"), (5, "zeta omega"), (None, "zeta omega kappa")])
    want = {(1, 1), (1, 4), (2, 2), (4, 3)}
    for limit in (1000, -1):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(held, bench, broadcast_windows=limit).collect()} == want
        assert {r["doc_id"] for r in decontaminate.clean(held, bench, broadcast_windows=limit).collect()} == {3, 5}


def brute_leaks(docs, items, percent=80):
    """Every window of every item against every window of every document; slots by the same greedy rule, written plainly."""
    out = {}
    for i, item in items:
        shape = decontaminate.shape_of(item) if item else None
        if not shape:
            continue
        length, places, hashes, ours = shape
        for d, text in docs:
            found, slots = decontaminate.scan(text)
            theirs = decontaminate.slot_values(len(found), slots)
            own = decontaminate.window_hashes(np.array(found, np.uint64), slots, length)[0].tolist()
            lines = {}
            for place, h in zip(places.tolist(), hashes.tolist()):
                for pos in (k for k, x in enumerate(own) if x == h):
                    lines.setdefault(pos - place, []).append((place, pos))
            taken, covered = [], set()
            for line in sorted(lines.values(), key=lambda x: (-len(x), x[0][0])):
                for place, pos in line:
                    pairs = [(a, b) for a, b in zip(ours[place : place + length], theirs[pos : pos + length]) if a or b]
                    both = taken + pairs
                    if place not in covered and all((a == x) == (b == y) for a, b in both for x, y in both):
                        taken, covered = both, covered | {place}
            if len(covered) * 100 >= percent * len(places) and d is not None:
                out[d, i] = all(a == b for a, b in taken)
    return out


def test_decontamination_brute_force(spark):
    draw = random.Random(8)
    words = "the cost of a box is then paid by Anna and Tom in 12 days for 7 kg".split()
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([2, 4, 6, 12, 25])))) for i in range(25)] + [(25, None), (26, "")]
    items += [(30, items[3][1])]
    swap = {"Anna": "Maria", "Tom": "Eve", "12": "40", "7": "9"}
    rows = []
    for i in range(60):
        item = items[draw.randrange(25)][1].split()
        if i % 3 == 0:
            item = [swap.get(w, w) for w in item]
        if i % 4 == 0:
            item[draw.randrange(len(item))] = "other"
        around = [draw.choice(words) for _ in range(draw.randrange(40))]
        rows.append((i, " ".join(around + item + around[:5])))
    rows += [(60, None), (61, ""), (None, items[4][1]), (5, rows[5][1]), (62, " ".join(words * 2000 + items[9][1].split()))]
    want = brute_leaks([r for r in rows if r[0] != 62], items)
    assert len(want) > 20
    held, bench = frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (10_000, -1):
        got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.leaks(held, bench, broadcast_windows=limit).collect()}
        assert (62, 9) in got
        assert {k: v for k, v in got.items() if k[0] != 62} == want


PAGE = """<html><head><title>t</title><script>x("</p>")</script></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class="ad">buy</div>
<article><h1>A &amp; B</h1><p>One  <b>two</b><br>three<p>Four &lt;x&gt;</p><form><input>Go</form></article><section id="comments"><p>first!</p></section><footer>&copy; x</footer></body>"""
PLAIN = "<div>Home and away</div><div><p>Story number {0} goes on about thing {0} for a while.</p></div><div>Call us now</div>"


def test_html(spark):
    rows = [(1, "http://a.example.org/1", PAGE), (2, None, None), (3, "http://b.org/x", ""), (4, "x", "<p>un<b>closed & <i>text"), (1, "http://a.example.org/1", PAGE)]
    rows += [(10 + i, f"https://c.org/{i}", PLAIN.format(i)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("y")})
    for limit in (1000, -1):
        got = html_text.extract(pages, broadcast_tokens=limit).collect()
        assert len(got) == len(rows)
        texts = {r["page_id"]: r["text"] for r in got}
        assert texts[1] == "A & B\nOne two three\nFour <x>"
        assert (texts[2], texts[3], texts[4]) == ("", "", "unclosed & text")
        assert texts[12] == "Story number 2 goes on about thing 2 for a while."  # the rest is the host's template
    assert html_text.extract(pages.limit(0)).count() == 0


INSIDE = "<body><article><h1>Title {0}</h1><p>Story {0} goes on about thing {0}.</p><p>The same line.</p>{1}<p class=tip>Write to our readers</p><p>Printed in our town</p></article></body>"
TEASER = "<body><article><p>Read more with us</p></article><div><p>Long story {0} about thing {0} and what came of it.</p></div></body>"


def test_template_decides_in_articles(spark):
    rows = [(i, f"https://d.org/{i}", INSIDE.format(i, "<p>Told twice.</p>" * (i % 2))) for i in range(6)]
    rows += [(10 + i, f"https://e.org/{i}", INSIDE.format("x", "") + f"<!-- {i} -->") for i in range(6)]  # copies of one page
    rows += [(20 + i, f"https://f.org/{i}", TEASER.format(i)) for i in range(6)]
    texts = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    # what every page of the host holds goes; a line of some articles stays, as nothing that encloses it is on just these pages
    assert texts[2] == "Title 2\nStory 2 goes on about thing 2."
    assert texts[3] == "Title 3\nStory 3 goes on about thing 3.\nTold twice."
    assert texts[10] == "Title x\nStory x goes on about thing x.\nThe same line.\nWrite to our readers\nPrinted in our town"
    assert texts[21] == "Long story 1 about thing 1 and what came of it."


def test_language_id(spark, docs, empty):
    draw = random.Random(3)
    stems = {"aa": "ka lo mi ku".split(), "bb": "str ent pfl gr".split(), "cc": "oue aux eau ion".split()}
    rows = [(i, " ".join("".join(draw.choice(s) for _ in range(3)) for _ in range(draw.randrange(2, 60))), lang) for i in range(450) for lang, s in [list(stems.items())[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = language_id.predict(table, language_id.train(table)).join(table, "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count() > 0
    odd = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(table)).collect()}
    assert (odd[1]["lang_pred"], odd[1]["score"]) == ("und", 0.0) and odd[3]["lang_pred"] == "und"
    assert odd[12]["lang_pred"] in stems and 0 <= odd[12]["score"] <= 1
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        words = [f"w{draw.randrange(400)}" for _ in range(40)]
        if i % 4 == 0:
            words[draw.randrange(40)] = draw.choice(["foulword", "Badword!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    table, marks = frame(spark, rows), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(table, marks)
    assert 0 < len(model["weights"]) < 400
    out = toxicity.score(table, model).join(marks.filter("toxic IS NOT NULL"), "doc_id").filter("held_out")
    assert out.filter("predicted = toxic").count() >= 0.97 * out.count() > 0
    assert toxicity.score(docs, model).filter("score BETWEEN 0 AND 1").count() == len(odd_rows())
    assert toxicity.score(empty, toxicity.train(empty, marks)).count() == 0


def test_url_filter(spark):
    rows = [(i, f"http://n{i % 7}.example.com/{'en' if i % 2 else 'fr'}/{i}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "no scheme"), (103, "HTTP://WWW.Example.COM/en/x?y#z"), (104, "http://a.org/en/5"), (105, "http://x.net/es/" + "a" * 5000), (106, "http://net/fr/"), (107, "http://planet/fr/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"host": F.lit("q"), "rule": F.lit("q")})
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert (got[103]["host"], got[103]["path"], got[103]["rule"], got[103]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1]["rule"] == "example.com/en/" and got[1]["verdict"] == "block" and got[2]["rule"] == "com/"
    assert (got[100]["host"], got[100]["path"], got[100]["verdict"]) == ("", "", "block") and got[102]["host"] == ""
    assert got[105]["rule"] == "net/es/" and got[106]["rule"] == "net/fr/" and got[107]["rule"] is None
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_fold(spark):
    import zlib

    rows = spark.range(20).select("id", fold("id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


ARTICLE = "<article><h1>Title here</h1><p>" + "word " * 40 + "</p></article>"


@pytest.mark.parametrize(
    "html,want",
    [
        (f'<div class="content-sidebar-wrap">{ARTICLE}<div class="sidebar"><p>{"other " * 60}</p></div></div>', 42),
        (f'<div class="layout has-sidebar">{ARTICLE}</div>', 42),
        (f'<div class="post no-comments">{ARTICLE}</div>', 42),
        (f'<div id="main" class="with-ads">{ARTICLE}</div>', 42),
        (f'<form id="whole-page">{ARTICLE}</form><div class="related"><article><p>{"teaser " * 9}</p></article></div>', 42),
        (f'<form id="whole-page">{ARTICLE}</form><div class="comments"><p>{"reader " * 90}</p></div>', 42),
        (f'{ARTICLE}<div class="related"><article><p>{"teaser " * 9}</p></article></div>', 42),
        (f'{ARTICLE}<form><p>{"field " * 90}</p></form>', 42),
    ],
)
def test_wrappers_of_the_main_slot_stay(html, want):
    assert len(html_text.main_text(html_text.blocks(f"<body>{html}</body>"), frozenset()).split()) == want


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p title=it's>Hello there</p>", "Hello there"),
        ('<p title="abc>Hello there</p>', "Hello there"),
        ('<p title="abc>Hello there</p><p class="x">More</p>', "Hello there\nMore"),
        ('<p title="a > b" data-q=\'"\'>ok</p>', "ok"),
        ('<article><p>We <span class="search">search</span> the web <button>Go</button> now</p></article>', "We search the web now"),
        ('<article><p>Long text</p><section id="related-work"><h2>Related work</h2><p>We cite.</p></section><p class="side-effects">None.</p><div class="share-buttons"><p>Share</p></div></article>', "Long text\nRelated work\nWe cite.\nNone."),
    ],
)
def test_markup_and_names(html, want):
    assert html_text.main_text(html_text.blocks(html), frozenset()) == want


def test_url_filter_learns_from_every_url(spark):
    urls = spark.range(30_000).select(F.concat(F.when(F.col("id") % 3 == 0, "http://n.net/es/").otherwise("http://x.com/"), F.md5(F.col("id").cast("string"))).alias("url"))
    ruled = urls.withColumn("verdict", url_filter.rule_of(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))[1])
    learned = lambda df: spark.range(1).select(url_filter.learn(df)[0].alias("w")).first()["w"]
    kept = url_filter.with_codes(ruled, F.col("url")).filter(F.crc32(F.col("url").cast("binary")) % 5 != 0)
    want = spark.range(1).select(url_filter.weights(kept).alias("w")).first()["w"]
    assert learned(ruled.union(ruled.limit(500))) == want

"""Odd inputs, clashing columns, real documents and the whole pipeline."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, html_text, language_id, learning, mixing, near_dup, pii, quality, substring_dedup, toxicity, url_filter, words
from tests.llm.test_corpus import WORD, brute_leaks, frame, shingles

SF = "/root/testdata/sf0.01"
#: Every name that an operator uses itself.
NAMES = sorted({*quality.MEASURES, *mixing.ADDED, *url_filter.ADDED} | set("k0 k1 row whole_text failures salt p_salt p_source whole cut order_key doc rep copy packed at other marks firsts node comp key part parts cells beyond bands gone_id gone_text text_hash shape page host token model _key _group _turn _first".split()) - {"source"})


@pytest.fixture(scope="module")
def clash(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(f"word{draw.randrange(300)}" for _ in range(60)), f"s{i % 3}") for i in range(12)]
    rows += [(20, None, None), (21, "", "s0"), (3, rows[3][1], "s0"), (30, rows[4][1], "s1")]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return base.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES]).persist()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_clashing_columns_pass_through(spark, clash):
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(clash).collect()}
    want = clash.filter(F.col("doc_id").isin([i for i, k in judged.items() if k]))
    assert quality.keep(clash).columns == clash.columns and rows_of(quality.keep(clash)) == rows_of(want)
    mixed = mixing.mix(clash)
    others = [c for c in clash.columns if c not in mixing.ADDED]
    assert mixed.columns == [*others, *mixing.ADDED]
    assert rows_of(mixed.select(others)) == rows_of(clash.select(others))
    assert rows_of(mixing.mix(clash, broadcast_sources=-1)) == rows_of(mixed)
    single = near_dup.keep_one(clash)
    assert single.columns == clash.columns and rows_of(single) == rows_of(clash.filter("doc_id <> 30"))
    bench = clash.filter("doc_id = 5").select(F.lit(1).cast("bigint").alias("item_id"), "text")
    clean = decontaminate.clean(clash, bench)
    assert clean.columns == clash.columns and rows_of(clean) == rows_of(clash.filter("doc_id <> 5"))
    assert pii.redact(clash, {}).columns == clash.columns and rows_of(pii.redact(clash, {})) == rows_of(clash)
    with pytest.raises(ValueError):
        quality.ledger(clash, keep=("doc_id", "n_words"))
    for out in (substring_dedup.deduplicate(clash), near_dup.groups(clash), pii.find(clash, {}), language_id.predict(clash, {}), toxicity.score(clash, {})):
        assert out.count() == clash.count()
    pages = clash.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/").alias("url"), F.lit("<p>x").alias("html"), *[n for n in NAMES])
    assert html_text.extract(pages).count() == pages.count()
    judged = url_filter.judge(pages)
    kept = [c for c in pages.columns if c not in url_filter.ADDED]
    assert judged.columns == [*kept, *url_filter.ADDED] and rows_of(judged.select(kept)) == rows_of(pages.select(kept))


def test_quality_gives_texts_back_in_small_parts():
    texts = [f"{i} " + "word and line " * 150_000 for i in range(6)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(texts)], names=["k0", "k1"])
    parts = list(quality._measured([batch, batch.slice(0, 0)], 2, 1))
    assert max(sum(map(len, filter(None, p["k1"].to_pylist()))) for p in parts) <= words.SLICE_BYTES
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["k0"], r["k1"], tuple(r[m] for m in quality.MEASURES)) for r in rows] == [(i, t, quality.measure(t)) for i, t in enumerate(texts)]


def test_quality_sends_the_text_once(spark):
    docs = spark.createDataFrame([(1, "some words " * 60, "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    sent = lambda df: re.search(r"MapInArrow (?:<lambda>|run)\((.*?)\)#?", df._jdf.queryExecution().optimizedPlan().toString())[1].split(", ")
    assert len(sent(quality.keep(docs))) == 3 and len(sent(quality.ledger(docs))) == 2


def test_slices_give_memory_back(monkeypatch):
    pool, given = pa.default_memory_pool(), []
    monkeypatch.setattr(words.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda _: given.append(pool.bytes_allocated())})())
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"] * 4)], names=["text"])
    assert sum(p.num_rows for p in words.slices([batch, batch], limit=6)) == 8 and len(given) == 2


def test_bounded_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("lang")).union(spark.sql("SELECT 7L, 'b' FROM range(4000)"))
    for limit in (50, 400, 10_000):
        got = learning.bounded_sample(rows, limit, F.col("doc_id"), "lang").collect()
        counts = {lang: len({r["doc_id"] for r in got if r["lang"] == lang}) for lang in "ab"}
        assert counts == {"a": min(limit, 500), "b": min(limit, 4500)} and len(got) == sum(counts.values())
    again = learning.bounded_sample(rows.repartition(5), 50, F.col("doc_id"), "lang")
    assert rows_of(again) == rows_of(learning.bounded_sample(rows, 50, F.col("doc_id"), "lang"))
    # only the sample meets in one task
    plan = learning.bounded_sample(rows, 50, F.col("doc_id")).repartition(1)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" not in plan


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = frame(spark, [(3, a), (5, a), (5, b), (6, b), (None, b)])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.groups(docs).collect() if r["doc_id"])
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (6, 5, False)]
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in near_dup.keep_one(docs).collect()) == [(0, "b"), (3, "a"), (5, "b")]


def test_links_near_the_threshold(spark):
    """Pairs whose similarity is just at or below 85 in 100, in small and large sets: all links found, no other."""
    draw, rows, want = random.Random(2), [], {}
    for n, size in ((40, 60), (40, 300), (12, 2500)):
        for _ in range(n):
            words = [f"w{draw.randrange(10**6)}" for _ in range(size)]
            other, before, own = list(words), list(words), shingles(" ".join(words))
            while 100 * len(own & shingles(" ".join(other))) >= 85 * len(own | shingles(" ".join(other))):
                before = list(other)
                at = draw.randrange(size - max(1, size // 100))
                other[at : at + max(1, size // 100)] = [f"x{draw.randrange(10**6)}" for _ in range(max(1, size // 100))]
            other = draw.choice([other, before, before])  # just below or just above
            i = len(rows)
            rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
            x, y = shingles(rows[i][1]), shingles(rows[i + 1][1])
            want[i + 1] = i if 100 * len(x & y) >= 85 * len(x | y) else i + 1
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 10 < sum(w % 2 == 0 for w in want.values()) < len(want)
    assert {i: got[i] for i in want} == want


def test_large_bucket_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PART_ROWS", 7)
    draw, words = random.Random(3), [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:50], f"x{i}", *words[51:]])) for i in range(60)] + [(100 + i, " ".join(draw.sample(words, 80))) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(20))


def test_comparisons_are_dealt_by_their_number(spark, monkeypatch):
    """A bucket's rows are few bytes and its pairs many, so their number and not their bytes decides how many tasks compare them."""
    frame, dealt = type(spark.range(0)), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: (dealt.append((n, by)), deal(self, n, *by))[1])
    monkeypatch.setattr(near_dup, "TASK_PAIRS", 10)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:50], f"x{i}", *words[51:]])) for i in range(30)]
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert dealt and all(by == ("key", "part") for _, by in dealt) and max(n for n, _ in dealt) > 10


def test_substring_rows_without_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(None, a), (None, a), (None, b), (None, f"{b} z"), (4, f"y {b}"), (None, None), (None, ""), (2, None)]
    out = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicate(frame(spark, rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, 30, 0), (None, 30, 0), (None, 30, 30), (None, 31, 30), (4, 31, 0), (None, 0, 0), (None, 0, 0), (2, 0, 0)], key=str)


def plain_base(text):
    """The patterns as they are written, with Python's own engine."""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii_base_brute_force(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("09 47.-+()@a%b\n") for _ in range(draw.randrange(60))) for _ in range(4000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t)


def test_pii_masked_spans_of_real_documents(spark):
    """Mentions of real documents stripped of their marks are found beside a marked one, and only by skip edges."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = pii.train(docs)
    assert model["skip"][0, 0] > 1
    without = model | {"skip": model["skip"] * 0}
    found = plain = n = 0
    for r in docs.filter("text RLIKE '[0-9@]'").orderBy("doc_id").collect():
        for s, e, k in pii.base_spans(r["text"]):
            bare = pii.masked(r["text"][s:e], k)
            if k != 3 or not bare:
                continue
            text = f"{r['text']}\nand later {bare} once more"
            at = len(r["text"]) + len("\nand later ")
            n += 1
            found += (at, at + len(bare), k) in pii.all_spans(text, model)[1]
            plain += (at, at + len(bare), k) in pii.all_spans(text, without)[1]
    assert n >= 10 and found >= 0.9 * n and plain <= 0.1 * n


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lang = language_id.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert lang.filter("lang = lang_pred").count() >= 0.98 * lang.count() > 0
    toxic = toxicity.op6_toxicity(spark, SF).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL")
    rows = [(r["toxic"], r["score"]) for r in toxic.select("toxic", "score").collect()]
    pairs = [(b > a) + 0.5 * (a == b) for (x, a), (y, b) in itertools.product(rows, rows) if not x and y]
    assert np.mean(pairs) >= 0.85
    pages = url_filter.judge(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"))
    ruled = pages.filter((F.crc32(F.col("url").cast("binary")) % 5 == 0) & F.col("rule").isNotNull())
    right = F.avg(((F.col("lm_score") >= F.col("lm_threshold")) == (F.col("verdict") == "allow")).cast("double"))
    assert all(r["right"] >= 0.9 for r in ruled.groupBy("verdict").agg(right.alias("right")).collect())


def test_ties_and_repeats_have_one_answer(spark):
    rows = [(i, t) for i in (1, 1, 2) for t in ("same words here", "", None)] * 2
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, "aa").otherwise("bb"))
    for out in (language_id.predict(docs, language_id.train(docs)), toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")))):
        assert out.count() == len(rows)
        assert all(r["n"] % 2 == 0 for r in out.groupBy(out.columns).agg(F.count("*").alias("n")).collect())


def test_html_long_and_deep_pages():
    for html in ("<div>" * 200_000 + "x", "<div>x" * 50_000, "<b>" * 100_000 + "</i>" * 100_000 + "x", "<b>" * 50_000 + "<div></div>" * 50_000 + "x", "<a " * 100_000, "<td>" * 50_000 + "</div>" * 50_000 + "x", "word " * 500_000):
        began = time.time()
        found = html_text.blocks(html, {})
        assert time.time() - began < 15 and found
        assert all(len(path) <= html_text.DEPTH + 1 for path, *_ in found)
    assert html_text.main_text(html_text.blocks("<article><p>" + "long " * 200_000), frozenset()).count("long") == 200_000


def test_html_brute_force(spark):
    """Pages put together from known blocks: the text is the article's blocks and nothing else."""
    draw = random.Random(6)
    word = lambda n: " ".join(f"w{draw.randrange(900)}" for _ in range(n))
    chrome = ["<nav><ul><li><a href=/>Home</a></ul></nav>", "<header><h1>Site</h1></header>", "<aside><p>Read this too</p></aside>", '<div class="ad-box">Buy now</div>', '<form><label>Name</label><input></form>', "<script>var a = '<p>no</p>';</script>", "<!-- <p>hidden</p> -->", '<section id="comments"><p>I agree</p></section>', '<div role="alert">We use cookies</div>']
    rows, want = [], {}
    for i in range(40):
        body = [word(draw.randrange(4, 20)) for _ in range(draw.randrange(1, 6))]
        article = "".join(f"<p>{b.replace(' ', draw.choice([' ', chr(10), '  ', ' <b>', '&#32;']), 1)}</p>" + (draw.choice(chrome[2:6]) if draw.random() < 0.3 else "") for b in body)
        around = draw.sample(chrome, 5)
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<html><body>{''.join(around[:2])}<article>{article}</article>{''.join(around[2:])}<footer>&copy;</footer></body></html>"))
        want[i] = "\n".join(body)
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def plain_mix(docs, seed=17):
    """Weights by loops: clamp, share again, until nobody is above; then whole rounds and a cut of the seeded order."""
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(docs)}
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, d in enumerate(docs) if d[2] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else level * weight[s]
            budget -= target[s] if over else 0
        open_ = open_ - over if over else set()
    repeats = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, reached = target[s] - whole * total[s], 0
        own = sorted((hashlib.md5(f"{seed}:{d[0] if d[0] is not None else d[1] or ''}".encode()).hexdigest(), k) for k, d in enumerate(docs) if d[2] == s)
        best, cut, steps = rest, -1, []
        for n, (_, k) in enumerate(own):
            reached += size[k]
            steps.append(abs(reached - rest))
            if steps[-1] < best:
                best, cut = steps[-1], n
        for n, (_, k) in enumerate(own):
            repeats[k] = whole + (n <= cut)
    return target, repeats, size


def test_pipeline_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    draw = random.Random(9)
    word = lambda: draw.choice("river stone table green quiet market window carries under before seven letters about people never".split()) + draw.choice("abcdefgh")
    base = [[word() for _ in range(draw.randrange(60, 160))] for _ in range(40)]
    item = "Anna bought 12 boxes of paint and then gave Tom 5 of the boxes for 3 days"
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(base[i][:-1] + ["last"])) for i in range(10)]  # near copies
    rows += [(200, rows[0][1]), (201, None), (202, ""), (203, "few words"), (204, "la la la " * 60), (205, f"{rows[5][1][:200]} . {item} . {rows[6][1]}"), (None, " ".join(word() for _ in range(80)))]
    rows += [(300 + i, " ".join(word() for _ in range(70)) + f" call +1 (243) 555-79{i:02d} or 124355579{i:02d} or mail a{i}@mail.example.org") for i in range(8)]
    docs = [(i, t, None if (i or 0) % 7 == 3 else f"s{(i or 0) % 4}") for i, t in rows]
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in docs]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(full, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(1, item), (2, None), (3, "")]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def passes(t):
        m = dict(zip(quality.MEASURES, quality.measure(t)))
        return not any(eval(rule.replace(" OR ", " or "), {}, m) for rule in quality.RULES.values())

    kept = [d for d in docs if passes(d[1])]
    sets = [shingles(t) for _, t, _ in kept]
    root = list(range(len(kept)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(kept)), 2):
        if kept[a][0] is not None and kept[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, d in enumerate(kept):
        if d[0] is not None:
            least[find(k)] = min(least.get(find(k), d[0]), d[0])
    single = [d for k, d in enumerate(kept) if d[0] is None or least[find(k)] == d[0]]
    leaky = {d for d, _ in brute_leaks([(k, t) for k, (_, t, _) in enumerate(single)], bench)}
    clean = [d for k, d in enumerate(single) if k not in leaky]
    model = pii.train(spark.createDataFrame([(i, t) for i, t, _ in clean], "doc_id bigint, text string"))
    redacted = [(i, pii.redacted(t, pii.all_spans(t, model)[1]), s) for i, t, s in clean]
    target, repeats, size = plain_mix(redacted)
    want = {(i, t, s, size[k], repeats[k]) for k, (i, t, s) in enumerate(redacted) if repeats[k] > 0}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"], r["source"], r["size"], r["repeats"]) for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) and r["target"] == pytest.approx(target[r["source"]]) for r in got)
    assert len(kept) < len(docs) and len(single) < len(kept) and len(clean) == len(single) - 1
    assert any("[PHONE] or [PHONE]" in t for _, t, _ in redacted)
    # an empty table goes through every stage
    none = tmp_path / "none"
    spark.createDataFrame([], schema).write.parquet(str(none / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(none / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0

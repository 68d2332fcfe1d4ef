"""Phrases against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, chunk string, n string, phrase string"


def corpus():
    draw = random.Random(11)
    words = ["alpha", "Beta", "gamma", "DELTA", "é", "x y", "new", "york", "city", "|", "Ärger"]
    out = []
    for i in range(60):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!?"]) for _ in range(draw.randrange(0, 90)))
        out.append((i, text + draw.choice(["", "new york city", "New York"]), draw.choice(["en", "de", None])))
    same = "new york city hall is in new york city hall " * 3
    out += [(100 + i, same, "en") for i in range(9)] + [(200, None, "en"), (201, "", None), (202, " \t\n", "de"), (203, "long " * 30_000, "fr"), (204, "one", "es"), (None, same, "en"), (0, *out[0][1:])]
    out += [(300, "z" * 100_000 + " q " * 40, "nl"), (301, "tie a tie b tie a tie b " * 12, "it")]
    return out


def expected(rows, max_words=3, least=10, top=2000, share=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    kept = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in inside or 100 * inside[lang, w] < share * a:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            kept.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows_ in kept.items() for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top]))


@pytest.mark.parametrize("options", [{}, {"period": 1}, {"period": 12}, {"period": 3, "max_words": 4, "least": 5, "top": 7}, {"max_words": 2, "share": 101}])
def test_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in collocations.phrases(df, **options).collect())
    assert got == expected(rows, **{k: v for k, v in options.items() if k != "period"})


def test_empty_tables(spark):
    assert collocations.phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.phrases(spark.createDataFrame([(1, None, None, "", "", ""), (2, "a b", "en", "", "", "")], SCHEMA)).count() == 0


def test_saturated_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITMAP_BITS", 17)
    monkeypatch.setattr(collocations, "SEGMENT_BITS", 15)
    rows = corpus()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in collocations.phrases(df).collect()) == expected(rows)


def test_plain_reads_slices():
    texts = pa.array(["Ab,C", None, "É\tX!", "y"])
    assert collocations.plain(texts.slice(1, 2)).to_pylist() == ["", "É x\n"]

"""Collocations equal a plain count with Python's whole numbers, however small the sketch, the shards and what is held."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import collocations as c

LAST = {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}


def brute(docs, max_words, min_count, percent, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[p : p + m]) for m in range(1, max_words + 1) for p in range(len(words) - m + 1))
    found = {}
    for (lang, *g), a in f.items():
        if len(g) > 1 and a >= min_count:
            cuts = [(1000 * a * n[lang] // (f[lang, *g[:k]] * f[lang, *g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found[lang, tuple(g)] = (a, f[lang, *g[:k]], f[lang, *g[k:]], n[lang], score)
    gone = {(lang, g[p : p + m]) for (lang, g), x in found.items() for m in range(2, len(g)) for p in range(len(g) - m + 1) if 100 * x[0] >= percent * f[lang, *g[p : p + m]]}
    out = []
    for lang in n:
        rows = [(-x[4], -x[0], " ".join(g).encode(), x) for (own, g), x in found.items() if own == lang and (own, g) not in gone]
        out += [(lang, k, p.decode(), *x) for k, (_, _, p, x) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["the", "of", "New", "york", "é", "ﬁ", "日本", "a\0b", "x y", "x\x1fy"]
    out = []
    for _ in range(120):
        some = r.choices(words, [9, 8, 3, 3, 2, 1, 1, 1, 1, 1], k=r.randint(0, 60))
        out.append((r.choice(["en", "en", "fr", None, "und"]), "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "; new york city of the "]) for w in some)))
    return [*out, ("en", None), ("en", ""), (None, " . ,"), ("fr", "la la la la la la la la la la la la"), ("en", "one two three four five six " * 30), *[out[0]] * 15]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(k, t, i, "x") for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string").repartition(parts)


@pytest.mark.parametrize(
    ("max_words", "min_count", "percent", "top", "cell_bytes", "limits"),
    [(5, 12, 100, 2000, 16, {}), (5, 3, 80, 7, 1000, {"PART_BYTES": 100, "SHARD_CHARS": 300, "SLICE_CHARS": 50, "HELD_PHRASES": 10, "MEMORY_WORDS": 3}), (3, 2, 100, 50, 1, {"PART_CELLS": 1024, "SALT": 3}), (2, 1, 100, 2000, 16, {"SLICE_CHARS": 1})],
)
def test_equals_brute_force(spark, monkeypatch, texts, max_words, min_count, percent, top, cell_bytes, limits):
    for k, v in limits.items():
        monkeypatch.setattr(c, k, v)
    got = c.collocations(frame(spark, texts), max_words=max_words, min_count=min_count, percent=percent, top=top, cell_bytes=cell_bytes)
    assert dict(got.dtypes) == LAST
    want = brute(texts, max_words, min_count, percent, top)
    assert sorted(map(tuple, got.collect())) == want
    assert want


def test_exact_beyond_64_bits(spark, texts, monkeypatch):
    """Counts of a very large corpus: the products pass 64 bits."""
    big = 3 * 10**9
    counted = c.count_phrases
    monkeypatch.setattr(c, "count_phrases", lambda *a: counted(*a).selectExpr("part", "lang", "phrases", f"transform(counts, f -> f * {big}) AS counts"))
    got = {(r.lang, r.phrase): r.score for r in c.collocations(frame(spark, texts), min_count=12).collect()}
    monkeypatch.undo()
    # a n / (l r) does not change when all are multiplied
    every = brute(texts, 5, 1, 101, 10**6)
    assert got and got == {k: v for k, v in {(x[0], x[2]): x[7] for x in every}.items() if k in got}


def test_empty_table_and_rare_phrases(spark, texts):
    assert c.collocations(frame(spark, texts).limit(0)).count() == 0
    assert c.collocations(frame(spark, texts[:3])).count() == 0


def test_gaps_come_back():
    r = np.random.default_rng(1)
    for high in (3, 300, 100_000):
        numbers = np.sort(r.integers(0, high, 2000))
        assert np.array_equal(c.from_gaps(c.to_gaps(numbers)), numbers)
    assert c.from_gaps(c.to_gaps(np.array([0, 255, 255, 510, 511]))).tolist() == [0, 255, 255, 510, 511]


def test_a_cell_never_counts_less_than_a_phrase(spark, texts):
    own = frame(spark, texts).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    cells = 1 << 10
    bits = c.bits_of(own, cells, 3, 12)
    f = Counter()
    for lang, text in texts:
        for part in c.slices(text or ""):
            words = next(c.joined([part]))
            for h, whole in c.phrase_hashes(words, c.Hashes(), lang or "und", 3):
                f.update(c.cells_of(h[whole], cells).tolist())
    assert [k for k in range(cells) if bits[k >> 3] >> (k & 7) & 1] == sorted(k for k, n in f.items() if n >= 12)

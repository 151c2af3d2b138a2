"""Ranked search equals a plain ranking with Python's whole numbers, whatever the shards, blocks and partitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(LAST if i is None else i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for i, text in set(items):
        found = []
        for d, b in bags:
            m = 100 - 90 + (90 * b.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, d))
        out += [(i, r, None if d == LAST else d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


LAST = lexical_search.LAST_ID
WORDS = [a + b for a in "ba ce dé fo 日 gu".split() for b in "ran sel 7 VOM zup k".split()]


@pytest.fixture(scope="module")
def case():
    r = random.Random(8)
    text = lambda n: r.choice([" ", ", ", "\n", "\0"]).join(r.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=n))
    docs = [(k, text(r.randint(1, 60))) for k in range(150)]
    docs += [(150 + k, docs[7][1]) for k in range(30)] + [(3, docs[3][1]), (3, "baran"), (None, docs[7][1]), (190, None), (191, ""), (192, " .,\0"), (193, text(3000))]
    items = [(k, text(r.randint(1, 12))) for k in range(12)] + [(0, "CESEL déran"), (None, docs[7][1]), (20, None), (21, ""), (22, "nowhere"), (23, docs[7][1]), (23, docs[7][1])]
    return docs, items


@pytest.mark.parametrize(("k", "shard", "block", "parts"), [(10, 2_000_000, 1 << 24, 3), (1, 40, 1 << 24, 5), (10, 200, 100, 2), (40, 1, 1 << 24, 1)])
def test_search_equals_brute_force(spark, case, k, shard, block, parts):
    docs, items = case
    have = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(parts)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical_search.search(have, asked, k=k, shard_postings=shard, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_empty_tables(spark, case):
    docs, items = (spark.createDataFrame(x, f"{i} long, text string") for x, i in zip(case, ("doc_id", "item_id"), strict=True))
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_terms_in_slices(monkeypatch, case):
    monkeypatch.setattr(lexical_search, "SLICE", 7)
    for _, t in case[0]:
        assert [w.decode() for part in lexical_search.terms_of(t) for w in part] == terms(t)


def test_stops_before_all_postings_are_read(monkeypatch):
    """One document has both rare terms, all have the common one: nothing after the first groups can change the best one."""
    n = 5000
    bounds = np.concatenate([[0], np.cumsum(np.where(np.arange(n) == 77, 3, 1))])
    shown = np.concatenate([np.array([0, 1, 2]) if d == 77 else np.array([2]) for d in range(n)])
    shard = lexical_search.Shard(np.arange(n), np.full(n, 100), bounds, shown, np.ones(len(shown), np.int64), np.array([9000, 9000, 1]))
    taken = []
    monkeypatch.setattr(lexical_search, "FIRST_STEP", 1)
    add = np.add.at
    monkeypatch.setattr(lexical_search.np, "add", type("Add", (), {"at": staticmethod(lambda a, d, v: (taken.append(len(d)), add(a, d, v)))}))
    assert shard.best(np.array([0, 1, 2]), 1, 1) == [(-(9000 + 9000 + 1) * (10**9 // (1000 + 800)), 77)]
    assert sum(taken) <= 3


def test_many_terms_in_many_documents():
    """More terms than a step could double for, each in every document."""
    r = np.random.default_rng(2)
    n, terms = 400, 150
    counts = r.integers(1, 9, (n, terms))
    weights, m = r.integers(0, 5000, terms), r.integers(10, 400, n)
    shard = lexical_search.Shard(np.arange(n), m, np.arange(n + 1) * terms, np.tile(np.arange(terms), n), counts.ravel(), weights)
    whole = (weights * (10**9 * counts // (1000 * counts + 8 * m[:, None]))).sum(axis=1)
    assert shard.best(np.arange(terms), 10, 1) == sorted((-int(s), d) for d, s in enumerate(whole))[:10]

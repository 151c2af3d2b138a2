"""The operators of linkloom.llm: defined cases, brute force, and both paths where there are two."""

import hashlib
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import components, decontam, html_mincut, langid, line_dedup, neardup, ngram_join, packing, quality_lm, queries, suffix_dedup, tables, toxicity

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha ke li mo nu".split() for b in "ran sel tik vom zup".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed string"


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: plain, null, empty, short, repeated rows, near copies, passages that repeat, one long text."""
    r = random.Random(3)
    shared = sentence(r, 120)
    out = [(k, sentence(r, r.randint(1, 90))) for k in range(40)]
    out += [(40, None), (41, ""), (42, "one two"), (43, "one two"), (44, out[3][1]), (3, out[3][1]), (45, " \n\t ")]
    base = sentence(r, 100)
    out += [(50 + k, base + " " + sentence(r, k)) for k in range(12)]
    out += [(70 + k, sentence(r, 30) + " " + shared + " " + sentence(r, 30)) for k in range(6)]
    return [*out, (90, "\n".join(sentence(r, 12) for _ in range(300))), (91, "ab" * 700), (92, "é" * 500)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def brute_strings(texts, length):
    bodies, seen = [(t or "").encode() for _, t in texts], {}
    for b in bodies:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for (i, _), b in zip(texts, bodies, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


@pytest.mark.parametrize(("length", "run"), [(64, 4000), (64, 1), (150, 4000), (400, 4000)])
def test_repeated_strings(docs, texts, length, run):
    got = suffix_dedup.drop_repeated_strings(docs, length=length, run=run).collect()
    assert sorted((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.removed), bytes(r.kept)) for r in got) == brute_strings(texts, length)


def test_multikey_quicksort_finds_equal_strings():
    r = np.random.default_rng(3)
    for length in (64, 100, 400):
        pieces = [r.integers(0, 2, int(r.integers(1, 900)), dtype=np.uint8) for _ in range(8)]
        data = np.concatenate([*pieces, pieces[2], r.integers(0, 3, 300, dtype=np.uint8), pieces[5], np.zeros(700, np.uint8)])
        at = r.permutation(len(data) - length + 1)
        bodies = [data[p : p + length].tobytes() for p in at]
        want = [k for k, b in enumerate(bodies) if bodies.count(b) > 1]
        assert suffix_dedup.equal_runs(data, at, length).tolist() == want


def test_repeated_strings_of_hot_heads(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    got = suffix_dedup.drop_repeated_strings(docs, length=100).collect()
    assert sorted((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.removed), bytes(r.kept)) for r in got) == brute_strings(texts, 100)


def brute_classes(texts):
    def shingles(t):
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").split() if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets, low = [(i, shingles(t)) for i, t in texts], [i for i, _ in texts]
    changed = True
    while changed:
        changed = False
        for x, (_, a) in enumerate(sets):
            for y, (_, b) in enumerate(sets):
                if a and b and low[y] < low[x] and 100 * len(a & b) >= 75 * len(a | b):
                    low[x] = low[y]
                    changed = True
    return sorted((i, len(s), c) for (i, s), c in zip(sets, low, strict=True))


def test_jaccard_join(docs, texts):
    got = ngram_join.join_near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(texts)


def test_words_are_hashed_by_the_piece(monkeypatch):
    """Short words are never hashed one by one, and a word's hash is the same wherever it stands, whatever the pieces."""
    r = random.Random(4)
    few = " ".join(r.choice([sentence(r, 1), "Àé", "\x1f", "W" * 64]) + r.choice(["", "\n\t", "\x0b\x0c\r"]) for _ in range(3000))
    one_by_one = []
    monkeypatch.setattr(ngram_join, "xxh3_64_intdigest", lambda w: one_by_one.append(w) or hash(w) % 2**64)
    assert len(ngram_join.shingles(few)) and not one_by_one
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 300)
    known = {}
    for text in (few, few.upper(), "x" * 5000 + " " + few, few + " " + "y" * 5000, "q" * 400, "Q" * 400 + " ", " ", "a " * 150, "z" * 65):
        data = text.encode()
        words, codes = data.lower().split(), ngram_join.word_codes(data).tolist()
        assert len(words) == len(codes)
        assert all(known.setdefault(w, c) == c for w, c in zip(words, codes, strict=True))
    assert len(set(known.values())) == len(known) and {b"x" * 5000, b"y" * 5000, b"q" * 400} <= set(one_by_one)


def test_worker_memory_is_bounded():
    """What a worker keeps between tasks: no words of the join, and a bounded part of those of the packing."""
    r = random.Random(5)
    texts = [" ".join(f"{r.getrandbits(60):x}" for _ in range(20_000)) for _ in range(6)]

    def kept():
        return sum(len(x) for k, x in vars(ngram_join).items() if isinstance(x, dict) and not k.startswith("__"))

    before = kept()
    for t in texts:
        ngram_join.shingles(t)
    assert kept() == before
    coder = packing.coder(packing.TOKENIZER)
    for t in texts:
        coder.encode([t])
        assert max(len(coder.known), len(coder.words)) <= 130_000


def test_jaccard_join_tells_rows_apart(spark, monkeypatch):
    """Null and repeated ids, large sets near the threshold, a passage that most texts share; small blocks of runs."""
    r = random.Random(12)
    a, b, c, passage = sentence(r, 60), sentence(r, 60), sentence(r, 40), sentence(r, 50)
    rows = [(1, a), (2, b), (None, a), (None, b), (5, b), (5, c), (7, c), (None, sentence(r, 30)), (None, "")]
    base = [r.choice(WORDS) + str(k) for k in range(900)]
    for k, n in enumerate((0, 40, 120, 126, 127, 128, 129, 130, 132, 140)):  # n words changed at the end
        rows.append((20 + k, " ".join(base[: 900 - n] + [f"{w}_{k}" for w in base[900 - n :]])))
    rows += [(100 + k, passage + " " + sentence(r, r.randint(12, 30))) for k in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row_id int")
    # brute force by rows: numbers in the place of ids
    by_row = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    low = {c: min((rows[k][0] for k, _, d in by_row if d == c and rows[k][0] is not None), default=None) for _, _, c in by_row}
    want = sorted(((rows[k][0], n, low[c]) for k, n, c in by_row), key=str)
    for block in (ngram_join.RUN_BLOCK, 4):
        monkeypatch.setattr(ngram_join, "RUN_BLOCK", block)
        got = ngram_join.join_near_duplicates(docs).collect()
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == want
    kept = ngram_join.keep_one_each(docs.unionByName(docs.where("doc_id = 7")))
    assert kept.columns == docs.columns
    n_components = len({c for _, _, c in by_row})
    assert kept.count() == n_components
    assert {x.text for x in kept.where("doc_id is null").collect()} == {t for i, t in rows[7:9]}
    assert {(x.doc_id, x.text) for x in kept.where("doc_id <= 7").collect()} == {(1, a), (2, b), (5, c)}


def test_one_of_each_group_stays(docs, texts):
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in brute_classes(texts) if i == c}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def test_lines(spark):
    rows = [(1, "A long line here\nB\nshort"), (2, " a LONG line here \nB\nkept line of 2"), (2, None), (3, ""), (None, "a long line here"), (4, "a long line here\na long line here")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_dropped int")
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == {(1, rows[0][1], 3, 0), (2, "B\nkept line of 2", 3, 1), (2, None, 1, 0), (3, "", 1, 0), (None, "", 1, 1), (4, "", 2, 2)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    assert sorted(got.astype(str).values.tolist()) == sorted(want.astype(str).values.tolist())


def brute_links(rows):
    """Links and components by row: (id, vector, label)."""
    sound = {k: (np.array(v, float), y) for k, (_, v, y) in enumerate(rows) if v and y is not None and np.isfinite(v).all() and any(v)}
    norm = {k: v / np.linalg.norm(v) for k, (v, _) in sound.items()}
    links = {a: [b for b in sound if b != a and sound[a][1] == sound[b][1] and len(norm[a]) == len(norm[b]) and norm[a] @ norm[b] >= 0.98] for a in sound}
    comp = list(range(len(rows)))
    for _ in range(20):
        for a in links:
            comp[a] = min([comp[a], *(comp[b] for b in links[a])])
    low = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    return sorted(((i, len(links.get(k, [])), low[comp[k]], i == low[comp[k]]) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_vectors(spark, block):
    r = np.random.default_rng(1)
    base = r.normal(size=(30, 16))
    rows = [(k, [float(x) for x in base[k % 30] + 0.1 * r.normal(size=16) * (k >= 30)], k % 2) for k in range(120)]
    dense = r.normal(size=16)  # one crowd of near copies
    rows += [(1000 + k, [float(x) for x in dense + 0.05 * r.normal(size=16)], 1) for k in range(90)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (204, rows[0][1], 0), (205, [], 0), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0)]
    # ids that are null or repeat, over unrelated vectors
    rows += [(None, rows[0][1], 0), (None, rows[1][1], 1), (5, rows[40][1], 1), (5, [float(x) for x in r.normal(size=16)], 0)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = neardup.find_near_duplicates(df, block=block).collect()
    assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in got), key=str) == brute_links(rows)


def test_calibration_holds():
    """Pairs at the threshold collide often enough, by the chance that is promised."""
    cells, tables = neardup.calibrated(100_000, missed=0.05)
    r = np.random.default_rng(4)
    a = r.normal(size=(4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    d = np.sqrt(0.04)
    places, label = neardup.Places(32, cells, tables, neardup.CELL * d), np.zeros(len(a), np.int64)
    (ka, pa_), (kb, pb) = places(a, label), places(b, label)
    count = ((ka == kb) & (np.abs(pa_ - pb) <= neardup.WINDOW * d)).sum(axis=1)
    assert 0.01 < (count < neardup.COUNT).mean() < 0.065


def brute_tiles(doc, item, n):
    """Greedy string tiling as it is defined: mark the longest unmarked match, the first in the document, until none is left."""
    in_doc, in_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (n - 1, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                k = 0
                while p + k < len(doc) and q + k < len(item) and doc[p + k] == item[q + k] and not in_doc[p + k] and not in_item[q + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, q)
        k, p, q = best
        if k < n:
            return covered
        in_doc[p : p + k], in_item[q : q + k] = [True] * k, [True] * k
        covered += k


def test_tiles_are_those_of_the_definition():
    r = random.Random(8)
    for _ in range(60):
        item = [r.choice("abcdefgh") for _ in range(r.randint(8, 24))]
        doc = [r.choice("abcdefgh") for _ in range(10)]
        for _ in range(4):
            a = r.randrange(len(item))
            doc += item[a : a + r.randint(3, 12)] + [r.choice("xyz")]
        hit = decontam.Items([(7, " ".join(item))], 3, 0.0).hits(" ".join(doc))
        assert (hit[0]["n_covered"] if hit else 0) == brute_tiles(doc, item, 3)


def test_tiles_of_repetitive_texts_take_bounded_work():
    """Only the starts of longest matches are listed, so a page of one word or of one period does not hold a pair for each of its places and the item's."""
    for period, tail in (["w"], []), (["w"], list("abcdefgh")), ("a b c d e f g".split(), ["q"] * 6):
        item = (period * 1000)[:1000] + tail
        found = decontam.Items([(1, " ".join(item))], 5, 0.5)
        ids = np.array([found.codes[w] for w in (period * 200_000)[:200_000]])
        p, _, _ = found.seeds[0].pairs(ids, np.zeros(len(ids) + 1, np.int64))
        assert len(p) < 300_000
        began = time.time()
        (hit,) = found.hits(" ".join((period * 200_000)[:200_000]))
        assert (hit["n_covered"], hit["n_tiles"]) == (1000, 1) and time.time() - began < 30
    r = random.Random(5)
    for _ in range(40):
        letters = "ab"[: r.randint(1, 2)]
        item, doc = ([r.choice(letters) for _ in range(r.randint(3, 25))] for _ in range(2))
        hit = decontam.Items([(7, " ".join(item))], 3, 0.0).hits(" ".join(doc))
        assert (hit[0]["n_covered"] if hit else 0) == brute_tiles(doc, item, 3)


def test_tiles_catch_reordered_passages(spark):
    item, other = [f"w{k}" for k in range(24)], [f"v{k}" for k in range(12)]
    long = " ".join(["z"] * 200_000 + item)
    rows = [(1, " ".join(["x"] * 9 + item[12:] + ["y"] * 9 + item[:12])), (2, " ".join(item[:10])), (3, None), (4, ""), (5, "x " * 50), (None, " ".join(item)), (None, "clean"), (1, "clean too"), (6, long), (7, " ".join(other)), (7, " ".join(other))]
    rows += [(8, "they say that counterrevolutionaries misunderstand everything here"), (9, "too few words")]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, hits string")
    test = [(0, " ".join(item)), (0, " ".join(other)), (0, " ".join(other)), (1, "too few words"), (2, None), (None, " ".join(item)), (3, "Counterrevolutionaries misunderstand everything")]
    test = spark.createDataFrame(test, "item_id long, text string")
    shape = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.item_id is None else r.item_id, r.n_covered, r.n_tiles) for r in df.collect())
    want = sorted([(d, i, 24, 2 if d == 1 else 1) for d in (-1, 1, 6) for i in (0, -1)] + [(7, 0, 12, 1)] * 2 + [(8, 3, 3, 1)])
    kept = [(i, t) for i, t in rows if t in (None, "", "clean", "clean too", "too few words") or i in (2, 5)]
    for size in (decontam.BLOCK_BYTES, 200):
        assert shape(decontam.find_leaks(docs, test, block_bytes=size)) == want
        left = decontam.drop_leaks(docs, test, block_bytes=size)
        assert left.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(kept, key=str)


def test_packing_round_trip(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.pack_documents(docs, capacity=64).collect()
    want = []
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(ids[64 * k : 64 * k + 64].tobytes())) for k in range(-(-len(ids) // 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64


def test_packing_encodes_frequent_words_once(monkeypatch):
    """Words that every text holds stay remembered, however many others there are."""
    r, asked, word_ids = random.Random(6), Counter(), packing.WordCoder._word
    monkeypatch.setattr(packing.WordCoder, "_word", lambda self, word: asked.update([word]) or word_ids(self, word))
    coder = packing.WordCoder(packing.TOKENIZER)
    common = ["".join(r.choices("abcdefgh", k=5)) for _ in range(50)]
    for _ in range(12):
        coder.encode([" ".join([*common, *("".join(r.choices("ijklmnopqr", k=9)) for _ in range(20_000))])])
    assert {asked[w] for w in common} == {1}


def test_packing_encodes_odd_chunks_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    odd = ["", " ", "Foo, foo FOO... \n\tbar", "İstanbul \u212aelvin \u212bngstr STRAẞE Ÿ ÀÉß,", "don't we'll x's 's '' word'.", "e\u0301 \u0301e \u0301 a\u0308.", "a\x0bb\x0cc\x1cd\x85e\xa0f\u2028g",
           "<|endoftext|> <|startoftext|>x <| endoftext|> <|EndOfText|>", "1234 a1 1a ½ x² ªº µm", "日本語 текст 👍🏽, 👍", "-a- _b_ c_d \"q,\" (r).", "x" * 3000 + ",", "\x00 \x7f a\x00b"]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    coder = packing.WordCoder(packing.TOKENIZER)
    assert coder.encode(odd) == want == [coder.encode([t])[0] for t in odd]
    assert coder.encode(["", ""]) == [b"", b""]


def test_gradients_are_those_of_the_loss():
    """Backpropagation through time against differences of the loss, on words of several lengths."""
    r = np.random.default_rng(2)
    net = langid.Network.new(["a", "b", "c"], 1)
    net.x, net.b, net.u, net.out, net.out_b = (p.astype(np.float64) for p in net.parameters())
    codes, lengths = langid.padded([b"abc", b"hello", b"x", "\u00e9t\u00e9".encode()])
    labels = np.array([0, 1, 2, 1])
    _, grads = net.gradients(codes, lengths, labels)
    for p, g in zip(net.parameters(), grads, strict=True):
        places = [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g).ravel())[:5]] + [tuple(r.integers(0, n) for n in p.shape) for _ in range(5)]
        for at in places:
            before, h = p[at], 1e-5
            p[at] = before + h
            up = net.gradients(codes, lengths, labels)[0]
            p[at] = before - h
            down = net.gradients(codes, lengths, labels)[0]
            p[at] = before
            assert abs((up - down) / (2 * h) - g[at]) < 1e-4 + 0.02 * abs(g[at])


def test_languages_of_odd_rows(spark):
    net = langid.Network.new(["de", "en"])
    long = "word " * 100_000 + "x" * 5000
    rows = [(1, long, "a"), (None, "Hello", "b"), (1, "Hello", "c"), (1, "Hello", "c")]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, label string"), net)
    assert got.columns == ["doc_id", "text", "label", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == 4 and len({(r.lang_pred, r.score) for r in found if r.text == "Hello"}) == 1
    assert all(r.lang_pred in ("de", "en") and 0 < r.score <= 1 for r in found)
    assert langid.stretches("ab" * 20) == [b"ab" * 16, b"ab" * 4]


def test_languages(spark, sf_dir):
    got = queries.op1_language_id(spark, sf_dir).join(tables.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*")).first()
    assert right >= 0.95 * n
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 34!", "a")], "doc_id long, text string, score string")
    assert {(r.lang_pred, r.score) for r in langid.identify_languages(odd, langid.Network.new(["de", "en"])).collect()} == {("und", 0.0)}


def test_toxicity_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    assert got.count() == docs.count()
    assert {r.predicted for r in got.collect()} == {0}


def test_pairs_of_terms_are_learned():
    r = np.random.default_rng(0)
    docs = [np.unique(r.choice(40, 6)) for _ in range(3000)]
    docs = [np.union1d(d, np.array([k for k, p in ((100, k & 1), (101, k & 2)) if p], np.int64)) for k, d in enumerate(docs)]
    labels = np.array([int(100 in d and 101 in d) for d in docs])
    model = toxicity.fit(docs, labels, 0.25, epochs=20)
    index = model.index()
    margin = lambda *b: model.margins(np.array([index[x] for x in b]), np.array([0, len(b)]))[0]
    assert margin(100, 101) > 0 > max(margin(100), margin(101))


def test_quality_paths_agree(spark):
    r = random.Random(5)
    rows = [(k, sentence(r, 30), "en" if k % 2 else None) for k in range(300)] + [(500, "%$#@ ZZQX!! 99 %%%", "en"), (501, None, "en"), (502, " \n", None), (3, sentence(r, 30), "en"), (None, sentence(r, 5000), "fr")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, key int")
    ids = docs.where("doc_id < 280").select("doc_id")
    one = sorted(quality_lm.score_quality(docs, ids).collect(), key=str)
    two = sorted(quality_lm.score_quality(docs, ids, broadcast_grams=0).collect(), key=str)
    assert len(one) == len(rows)
    assert all(a.doc_id == b.doc_id and (a.perplexity == b.perplexity or abs(a.perplexity / b.perplexity - 1) < 1e-9) for a, b in zip(one, two, strict=True))
    kept = {x.doc_id: x.kept for x in one}
    assert not kept[500] and not kept[501] and not kept[502]
    assert sum(kept[k] for k in range(280, 300)) >= 18  # trusted by none


def counts_of(texts):
    """Counts of the highest order, and of lower ones the numbers of different symbols before a gram."""
    n = quality_lm.ORDER
    count = {k: {} for k in range(1, n + 1)}
    for t in texts:
        c = quality_lm.codes(t).tolist()
        for e in range(n - 1, len(c)):
            g = tuple(c[e - n + 1 : e + 1])
            count[n][g] = count[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        for g in count[k + 1]:
            count[k][g[1:]] = count[k].get(g[1:], 0) + 1
    return count


def test_probabilities_are_those_of_the_definition(spark):
    r = random.Random(6)
    texts = [sentence(r, 40) for _ in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = quality_lm.fit(docs).toArrow()
    model = quality_lm.Model(*(rows.column(c).to_numpy() for c in ("order", "gram", "p", "back")))
    hashes = [x[0] for x in docs.select(F.xxhash64("text")).collect()]
    folds = [counts_of([t for t, h in zip(texts, hashes, strict=True) if h & 1 == f]) for f in (0, 1)]
    d = {}
    for k in range(1, quality_lm.ORDER + 1):  # discounts are those of both folds together
        n = [sum(c == m for f in folds for c in f[k].values()) for m in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] and n[2] else None
        d[k] = [0.5, 0.75, 0.9] if y is None else [min(max(m - (m + 1) * y * n[m] / n[m - 1], 0.05), m - 0.05) for m in (1, 2, 3)]

    def p(f, g):
        k = len(g)
        if not k:
            return quality_lm.UNIFORM
        same = {x: c for x, c in folds[f][k].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(f, g[1:])
        cut = lambda c: d[k][min(c, 3) - 1]
        own = same.get(g, 0)
        return (own - cut(own) if own else 0) / total + sum(map(cut, same.values())) / total * p(f, g[1:])

    for f in (0, 1):
        for text in ("ba", "Q", "ransel tik", ""):
            c = quality_lm.codes(text).tolist()[-quality_lm.ORDER + 1 :]
            every = np.array([sum(x << 8 * (quality_lm.ORDER - 1 - j) for j, x in enumerate([*c, s])) for s in range(256)], np.int64) | quality_lm.FOLD * f
            got = np.exp(model.log_p(every))
            assert np.allclose(got[1:], [p(f, (*c, s)) for s in range(1, 256)], rtol=1e-9)
            assert abs(got.sum() - 1) < 1e-6


def test_parity_of_terms_is_learned():
    """Two terms that mean nothing alone: label 1 if exactly one of them is there."""
    r = np.random.default_rng(0)
    docs = [np.union1d(r.choice(40, 6), np.array([k for k in (100, 101) if r.random() < 0.5], np.int64)) for _ in range(4000)]
    labels = np.array([int((100 in d) != (101 in d)) for d in docs])
    model = toxicity.fit(docs, labels, 0.5)
    index = model.index()
    rows = [[index[b] for b in d.tolist() if b in index] for d in docs]
    got = model.margins(np.array([b for x in rows for b in x]), np.r_[0, np.cumsum([len(x) for x in rows])]) >= 0
    assert (got == labels).mean() > 0.99


PAGES = {
    "<nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>First  paragraph\nof some length, with words.</p><p>Second one that is long enough to count.</p></article><footer>&copy; x</footer>": "Title & more\nFirst paragraph of some length, with words.\nSecond one that is long enough to count.",
    "": "",
    "<script>var a = '<p>no</p>';</script>": "",
    "<div class='sidebar'><p>Links and links</p></div>": "",
}


def test_pages(spark):
    df = spark.createDataFrame([(h, "old") for h in PAGES] + [(None, "old")], "html string, text string")
    assert {r.html: (r.text, r.n_chars) for r in html_mincut.extract_text(df).collect()} == {h: (t, len(t)) for h, t in PAGES.items()} | {None: ("", 0)}


LONG = "A long paragraph of many words, which reads like the body of an article. " * 3


def test_names_inside_an_article_do_not_hide_it():
    text = LONG.strip()
    assert html_mincut.main_text(f"<article><div class='legal'><p>{LONG}</p></div></article>") == text
    assert html_mincut.main_text(f"<main><div class='story-header'><h1>Title</h1><p>{LONG}</p></div></main>") == f"Title\n{text}"
    assert html_mincut.main_text(f"<article><p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here. {LONG}</p></article>") == f"It is x=2 here. {text}"
    assert html_mincut.main_text(f"<main><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></main>") == text


def test_broken_pages_take_linear_time():
    began = time.time()
    assert html_mincut.main_text("<div>x</p> " * 100_000) == ""
    assert len(html_mincut.main_text(f"<p>{LONG} " * 20_000)) > 4_000_000
    assert time.time() - began < 60


def test_labelling_is_the_cheapest():
    """Of all labellings of small pages, the one with the least cost of blocks and edges."""
    r = random.Random(4)
    part = lambda: r.choice([f"<p>{sentence(r, r.randint(1, 40))}</p>", f"<div class='{r.choice(['ad', 'x', 'footer'])}'><p>{sentence(r, 5)}</p></div>", f"<ul><li><a href='/'>{sentence(r, 2)}</a><li>{sentence(r, 9)}</ul>", f"<nav>{sentence(r, 3)}</nav>", "<article>", "</article>"])
    for _ in range(40):
        blocks = html_mincut.blocks_of("".join(part() for _ in range(r.randint(2, 8))))[:9]
        if not blocks:
            continue
        weights = html_mincut.given_weights()
        odds = np.array([html_mincut.seen_of(t, b) for t, b in blocks]) @ weights
        edges = html_mincut.edges_of([b for _, b in blocks])
        cost = lambda keep: sum(np.log1p(np.exp(-x if k else x)) for x, k in zip(odds, keep, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(len(blocks))]) for m in range(1 << len(blocks)))
        assert abs(cost(html_mincut.labels_of(blocks, weights)) - best) < 1e-6


def test_classifier_is_fitted(spark, sf_dir):
    weights = html_mincut.fit(tables.table(spark, sf_dir, "pages"))
    given = html_mincut.given_weights()
    assert np.abs(weights - given).max() > 0.01
    assert np.sign(weights[[1, 2, 4]]).tolist() == np.sign(given[[1, 2, 4]]).tolist()
    assert html_mincut.fit(spark.createDataFrame([], "html string")).tolist() == given.tolist()


def test_cut_is_minimal():
    r = np.random.default_rng(2)
    for _ in range(30):
        n = int(r.integers(1, 8))
        source, sink = r.random(n).tolist(), r.random(n).tolist()
        edges = [(k, k + 1, float(r.random())) for k in range(n - 1)]
        cost = lambda side: sum(t if s else c for s, c, t in zip(side, source, sink, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html_mincut.source_side(source, sink, edges)) - best) < 1e-6


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.drop_repeated_strings(nothing).count() == 0
    assert ngram_join.join_near_duplicates(nothing).count() == 0
    assert line_dedup.drop_repeated_lines(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert decontam.find_leaks(nothing, bench).count() == 0
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert langid.identify_languages(nothing, langid.train(nothing)).count() == 0
    assert html_mincut.extract_text(spark.createDataFrame([], "html string")).count() == 0
    assert neardup.find_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert quality_lm.score_quality(nothing, nothing.select("doc_id")).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on its own input: null and repeated ids, null and empty texts, repeated rows, an extra column; then run()."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(21)
    line, item, base = sentence(r, 8), [f"w{k}" for k in range(20)], sentence(r, 80)
    rows = [(k, "\n".join([sentence(r, 12), line, sentence(r, 20)])) for k in range(6)]
    rows += [(10, base), (11, base + " end"), (None, base + " fin"), (12, sentence(r, 9) + " " + " ".join(item[10:] + ["x"] + item[:10])), (13, None), (14, ""), (14, sentence(r, 15)), (15, line), (16, sentence(r, 40)), (16, "other " + sentence(r, 30))]
    rows += [rows[-1]]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, hits string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def lines(rows):
        key = lambda x: "".join(c.lower() if c.isascii() else c for c in x).strip(" \t\n\r\v\f")
        order = lambda i: (i is None, i)
        held = {}
        for i, t in rows:
            for x in (t or "").split("\n"):
                held.setdefault(key(x), set()).add(order(i))
        stays = lambda i, x: len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == order(i)
        return [(i, t if t is None else "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in rows]

    def one_each(rows):
        numbered = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
        groups = {}
        for k, n, c in numbered:
            groups.setdefault(c if n else ("empty", k), []).append(k)
        # equal ids are told apart by a hash here; the fixture has none within a group but repeated rows
        return [rows[min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))] for g in groups.values()]

    clean = lambda rows: [(i, t) for i, t in rows if brute_tiles(decontam.words_of(t), item, 5) < 10]
    want, docs = rows, tables.table(spark, str(tmp_path), "documents")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (lambda x: x, lines, one_each, clean), strict=False):
        docs, want = tables.settle(stage(spark, docs, str(tmp_path))), brute(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "hits"], name
        assert sorted(((x.doc_id, x.text) for x in docs.collect()), key=str) == sorted(want, key=str), name
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    lengths = sorted(((i, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want), key=str)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.length) for x in packed), key=str) == lengths
    assert len({x.sequence_id for x in packed}) == 1


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = tables.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        docs = tables.settle(after)
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()


def test_digest_of_kept_bytes(spark, sf_dir):
    rows = queries.op6_suffix_array_dedup(spark, sf_dir).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in tables.table(spark, sf_dir, "documents").collect()}
    untouched = [r for r in rows if not r.n_spans]
    assert all(r.n_kept == r.n_bytes - r.n_removed for r in rows)
    assert all(r.n_chars_kept == len(next(t.decode() for i, t in texts.items() if i == r.doc_id)) for r in untouched)
    assert untouched and all(r.kept_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest() for r in untouched)


def test_packing_comes_near_the_lower_bound_and_ignores_other_columns(spark, docs):
    named = "sequence_id piece length used row group offset ids_crc32".split()
    more = docs.select("doc_id", "text", *(F.lit("x").alias(c) for c in named))
    got = packing.pack_documents(more, capacity=64).collect()
    tokens, sequences = sum(r.length for r in got), len({r.sequence_id for r in got})
    # one group is packed as a whole; two pieces above a third of a sequence may leave a gap that nothing fits
    assert -(-tokens // 64) <= sequences <= 1.1 * -(-tokens // 64) + 1
    same = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert same(got) == same(packing.pack_documents(docs, capacity=64).collect())


def test_packing_of_equal_lengths_fills_sequences(spark):
    """Ties: many pieces of one length, two to a sequence, and a third of a sequence three times."""
    lengths = np.array([30] * 11 + [20] * 9 + [60] * 4)
    bins, offsets, n = packing.match_and_fit(lengths, 60)
    assert n == 13 and np.bincount(bins, lengths).max() <= 60
    for b in range(n):
        own = np.argsort(offsets[bins == b])
        assert offsets[bins == b][own].tolist() == [0, *np.cumsum(lengths[bins == b][own])[:-1].tolist()]


def test_toxicity_of_rows_that_tie_and_of_clashing_columns(spark):
    r = random.Random(1)
    rows = [(k, sentence(r, 12) + (" vile ransel" if k % 3 == 0 else ""), k % 3 == 0) for k in range(240)]
    own = [(k, t, 0.5, "x", 9) for k, t, _ in rows] + [(0, rows[0][1], 0.5, "x", 9), (500, rows[0][1], 0.5, "x", 9), (None, None, 0.5, None, 9)]
    docs = spark.createDataFrame(own, "doc_id long, text string, score double, predicted string, held_out int")
    labels = spark.createDataFrame([(k, int(bad), 1) for k, _, bad in rows], "doc_id long, toxic int, quality int")
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == len(own)
    # equal texts have equal scores, whatever their ids
    assert len({x.score for x in found if x.text == rows[0][1]}) == 1
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found)
    assert np.mean([(x.predicted == 1) == (x.text is not None and "vile" in x.text) for x in found]) > 0.95


def test_parts_are_shuffled_without_their_first_bytes():
    parts = np.array([0, 1, 2**63 + 77, 2**48 + 5, 2**48 - 1, 2**64 - 1], np.uint64)
    short = ngram_join.cut(parts)
    assert len(short) == 6 * len(parts)
    assert ngram_join.uncut(short).tolist() == [int(p) % 2**48 for p in parts]
    assert len(ngram_join.uncut(b"")) == 0

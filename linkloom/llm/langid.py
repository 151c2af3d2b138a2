"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a word, labels every position with a language, and a document's probabilities are
the pooled log-probabilities of all its positions. States start anew at each word (and every 32 bytes of a longer
one), so each distinct word is read once per worker however often it occurs. Training is numpy, by backpropagation
through time, on a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import crc_mod, table, unused

HIDDEN, STRETCH = 20, 32
#: Training reads about so many documents of each language, and of them about so many words.
DOCS_PER_LANG, WORDS_PER_LANG = 300, 24_000
MEMORY_WORDS = 300_000
NONE = "und"
WORD = re.compile(r"[^\W\d_]+")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes (256 at the ends and beyond) and lengths, with an end mark before and after each word."""
    lengths = np.array([len(w) for w in words], np.int64) + 2
    codes = np.full((len(words), lengths.max()), 256, np.int64)
    for k, w in enumerate(words):
        codes[k, 1 : 1 + len(w)] = np.frombuffer(w, np.uint8)
    return codes, lengths


@dataclass
class Network:
    """x: each byte's inputs to the three gates; u: the state's; both directions on axis 0. out: from states to languages."""

    langs: list[str]
    x: np.ndarray
    b: np.ndarray
    u: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 5) -> Network:
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s: r.normal(0, 1 / np.sqrt(h), s).astype(np.float32)
        return cls(langs, f(2, 257, 3 * h), np.zeros((2, 3 * h), np.float32), f(2, h, 3 * h), f(2 * h, len(langs)), np.zeros(len(langs), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.b, self.u, self.out, self.out_b]

    def states(self, codes: np.ndarray, lengths: np.ndarray, d: int, keep: bool = False):
        """States of one direction at every position (d = 1 reads backwards); padded positions keep the state unchanged."""
        n, t = codes.shape
        h = HIDDEN
        state, every, kept = np.zeros((n, h), np.float32), np.zeros((n, t, h), np.float32), []
        u_zr, u_c = self.u[d][:, : 2 * h], self.u[d][:, 2 * h :]
        for s in range(t) if d == 0 else range(t - 1, -1, -1):
            live = (s < lengths)[:, None]
            given = self.x[d][codes[:, s]] + self.b[d]
            zr = sigmoid(given[:, : 2 * h] + state @ u_zr)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(given[:, 2 * h :] + (r * state) @ u_c)
            new = np.where(live, z * state + (1 - z) * c, state)
            if keep:
                kept.append((s, live, state, z, r, c))
            state = every[:, s] = new
        return every, kept

    def log_probabilities(self, codes: np.ndarray, lengths: np.ndarray):
        forward, k0 = self.states(codes, lengths, 0)
        backward, k1 = self.states(codes, lengths, 1)
        both = np.concatenate([forward, backward], axis=2)
        logits = both @ self.out + self.out_b
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities of each word's positions, and the number of positions."""
        pieces, owner = [], []
        for k, w in enumerate(words):
            own = stretches(w)
            pieces += own
            owner += [k] * len(own)
        total, count = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        order = np.argsort([len(s) for s in pieces], kind="stable")
        owner = np.array(owner)
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            codes, lengths = padded([pieces[k] for k in part])
            log_p = self.log_probabilities(codes, lengths)
            log_p *= (np.arange(codes.shape[1])[None] < lengths[:, None])[:, :, None]
            np.add.at(total, owner[part], log_p.sum(axis=1))
            np.add.at(count, owner[part], lengths)
        return total, count

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of all positions, and its gradients by backpropagation through time."""
        h, (n, t) = HIDDEN, codes.shape
        runs = [self.states(codes, lengths, d, keep=True) for d in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
        logits = both @ self.out + self.out_b
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        live = (np.arange(t)[None] < lengths[:, None]).astype(np.float32)
        total = live.sum()
        own = p[np.arange(n)[:, None], np.arange(t)[None], labels[:, None]]
        loss = float(-(np.log(own + 1e-12) * live).sum() / total)
        p[np.arange(n), :, labels] -= 1
        p *= live[:, :, None] / total
        flat = p.reshape(n * t, -1)
        grads = [np.zeros_like(self.x), np.zeros_like(self.b), np.zeros_like(self.u), both.reshape(n * t, -1).T @ flat, flat.sum(axis=0)]
        back = p @ self.out.T
        for d in (0, 1):
            given = back[:, :, d * h : (d + 1) * h]
            u_zr, u_c = self.u[d][:, : 2 * h], self.u[d][:, 2 * h :]
            ahead = np.zeros((n, h), np.float32)
            for s, live_s, before, z, r, c in reversed(runs[d][1]):
                new = ahead + given[:, s]
                on = np.where(live_s, new, 0)
                d_c = on * (1 - z) * (1 - c * c)
                d_z = on * (before - c) * z * (1 - z)
                held = d_c @ u_c.T
                d_r = held * before * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                ahead = np.where(live_s, on * z + held * r + d_zr @ u_zr.T, new)
                every = np.concatenate([d_zr, d_c], axis=1)
                np.add.at(grads[0][d], codes[:, s], every)
                grads[1][d] += every.sum(axis=0)
                grads[2][d][:, : 2 * h] += before.T @ d_zr
                grads[2][d][:, 2 * h :] += (r * before).T @ d_c
        return loss, grads


def fit(words: list[bytes], labels: np.ndarray, langs: list[str], epochs: int = 3, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam over the words; each word's label is its document's language."""
    net, random = Network.new(langs, seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step, steps = 0, max(1, epochs * -(-len(words) // batch))
    sizes = np.array([len(w) for w in words])
    for _ in range(epochs):
        order = random.permutation(len(words))
        order = order[np.argsort(sizes[order] // 3, kind="stable")]  # words of like length together
        parts = [order[k : k + batch] for k in range(0, len(order), batch)]
        for k in random.permutation(len(parts)):
            codes, lengths = padded([words[j] for j in parts[k]])
            _, grads = net.gradients(codes, lengths, labels[parts[k]])
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def stretches(word: str) -> list[bytes]:
    """A word's bytes, cut where the network's states start anew."""
    w = word.encode()
    return [w[k : k + STRETCH] for k in range(0, max(1, len(w)), STRETCH)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, doc_id, place, word) of each stretch of a document's words."""
    for batch in batches:
        for lang, i, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = [x for w in WORD.findall(text.lower()) for x in stretches(w)]
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([i] * n, pa.int64()), pa.array(np.arange(n)), pa.array(found, pa.binary())], names=["lang", "doc_id", "place", "word"])


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_lang: int = WORDS_PER_LANG) -> Network:
    """Fit on docs (doc_id, text, lang) whose crc32 of the id, modulo 4, is not 2.

    A language's share of its documents, by the hash of their ids, is such that about docs_per_lang are read; of their
    words, a share such that about words_per_lang reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) != 2))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Network.new([NONE])

    def part(share: dict[str, float], *by: str):
        shares = F.create_map(*(F.lit(x) for k in sorted(share) for x in (k, share[k])))
        return F.pmod(F.xxhash64(*by), F.lit(1 << 20)) / (1 << 20) < F.coalesce(shares[F.col("lang")], F.lit(0.0))

    sample = known.where(part({k: docs_per_lang / n for k, n in counts.items()}, "doc_id")).select("lang", F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text")
    words = sample.mapInArrow(_words, "lang string, doc_id long, place long, word binary")
    n_words = {r["lang"]: r["count"] for r in words.groupBy("lang").count().collect()}
    if not n_words:
        return Network.new(langs)
    rows = sorted((r["lang"], r["doc_id"], r["place"], bytes(r["word"])) for r in words.where(part({k: words_per_lang / n for k, n in n_words.items()}, "doc_id", "place")).collect())
    return fit([r[3] for r in rows], np.array([langs.index(r[0]) for r in rows]), langs) if rows else Network.new(langs)


class Pool:
    """Scores of the words that a worker has met, and the pooled probabilities of texts."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.net.langs) + 1), np.float32)

    def pooled(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the languages, pooled over positions, and the number of positions, for each text."""
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.at) > MEMORY_WORDS:
            self.clear()
        if new := list(set().union(*found).difference(self.at)):
            total, count = self.net.word_scores(new)
            count *= [w.isalpha() or any(map(str.isalpha, w)) for w in new]
            total *= count[:, None] > 0
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, np.c_[total, count].astype(np.float32)])
        sums = np.zeros((len(texts), self.scores.shape[1]))
        get = self.at.__getitem__
        for k, ws in enumerate(found):
            if ws:
                sums[k] = self.scores[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64)
        positions = sums[:, -1]
        mean = sums[:, :-1] / np.maximum(positions, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), positions


def identify_languages(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the pooled probability of that language, from the whole text.

    Defined cases: a null text, or one without a letter, is `und` with score 0; a text of any length is read whole; ids
    are not read, so null and repeated ones change nothing; rows that repeat get the same result;
    of equal probabilities the language that sorts first wins; an empty table gives an empty table. Other columns pass
    through, whatever their names; lang_pred and score replace columns of those names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    state: dict = {}

    @F.pandas_udf("lang string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        if not state:
            state["pool"] = Pool(shared.value)
        langs, values, rows = [], [], list(texts)
        start = size = 0
        for k in range(len(rows) + 1):
            if k == len(rows) or size > 2_000_000:
                if k > start:
                    p, n = state["pool"].pooled(rows[start:k])
                    best = p.argmax(axis=1)
                    langs += [shared.value.langs[b] if c else NONE for b, c in zip(best, n, strict=True)]
                    values += [float(p[j, b]) if n[j] else 0.0 for j, b in enumerate(best)]
                start, size = k, 0
            if k < len(rows):
                size += len(rows[k] or "")
        return pd.DataFrame({"lang": langs, "score": values})

    name = unused("label", docs)
    out = docs.withColumn(name, label(F.col(f"`{text_col}`")))
    return out.withColumn("lang_pred", F.col(f"{name}.lang")).withColumn("score", F.col(f"{name}.score")).drop(name)


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = identify_languages(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

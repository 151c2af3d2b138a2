"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings of 4 and 5 letters, hashed to 2**BUCKET_BITS buckets.
The model has a weight and a short vector for each bucket that takes part; the product of two vectors is the weight of
the two terms together, as of an insult beside the mention of a group. A bucket takes part if it tells the labels of
the training rows apart by itself, or if it does so together with another bucket: pairs are tried too, so a term that
means nothing alone keeps its place. The model is fitted on a bounded sample of the labelled rows, so every task can
hold it.
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
from xxhash import xxh32_intdigest

from linkloom.llm.tables import crc_mod, table

BUCKET_BITS, FACTORS = 26, 4
#: Chi-square against the label that a bucket must have, and that two buckets must have where both occur; others are noise.
MIN_CHI2, MIN_PAIR_CHI2 = 12.0, 40.0
#: Pairs are tried among buckets that at least so many training rows, and at least this share of them, hold.
PAIR_DOCS, PAIR_SHARE, PAIR_BLOCK = 8, 0.01, 1024
#: At most so many labelled rows of either label are fitted, those with the smallest hash of their id.
SAMPLE_PER_LABEL = 4000
MEMORY_WORDS = 400_000
WORD = re.compile(r"\w+")


def term_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word's terms: the word, and its beginnings if it is longer."""
    terms = [word] + [f"{word[:k]}\n" for k in (4, 5) if len(word) > k]
    return tuple(xxh32_intdigest(t) >> (32 - BUCKET_BITS) for t in terms)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def ragged_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of values from each start to the next; starts end with len(values)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass
class Machine:
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def index(self) -> dict[int, int]:
        return {int(b): k for k, b in enumerate(self.buckets)}

    def margins(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        v = self.vectors[features]
        pairs = 0.5 * (ragged_sum(v, starts) ** 2 - ragged_sum(v * v, starts)).sum(axis=1)
        return self.bias + ragged_sum(self.weights[features], starts) + pairs


def chi_square(n: int, pos: int, df: np.ndarray, tp: np.ndarray) -> np.ndarray:
    """Chi-square of the label with something that df rows hold, tp of them of label 1; n rows in all, pos of label 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(n * (tp * n - df * pos) ** 2 / (df * (n - df) * pos * (n - pos)), posinf=0.0)


def telling(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets that tell the labels apart, alone or in a pair."""
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    seen, at = np.unique(np.concatenate([*docs, np.empty(0, np.int64)]), return_inverse=True)
    n, pos = len(labels), int(labels.sum())
    df = np.bincount(at, minlength=len(seen)).astype(float)
    tp = np.bincount(at, labels[row], minlength=len(seen)).astype(float)
    alone = chi_square(n, pos, df, tp)
    keep = alone >= MIN_CHI2
    common = np.flatnonzero(df >= max(PAIR_DOCS, PAIR_SHARE * n))
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(seen) + 1))

    def dense(terms: np.ndarray) -> np.ndarray:
        x = np.zeros((n, len(terms)), np.float32)
        for k, t in enumerate(terms):
            x[row[order[begin[t] : begin[t + 1]]], k] = 1
        return x

    parts = [common[k : k + PAIR_BLOCK] for k in range(0, len(common), PAIR_BLOCK)]
    for i, a in enumerate(parts):
        x = dense(a)
        for b in parts[i:]:
            y = dense(b)
            both, good = (x.T @ y).astype(float), (x[labels == 1].T @ y[labels == 1]).astype(float)
            # more than either term shows alone
            strong = chi_square(n, pos, both, good) >= MIN_PAIR_CHI2 + np.maximum(alone[a][:, None], alone[b][None])
            keep[a[strong.any(axis=1)]] = True
            keep[b[strong.any(axis=0)]] = True
    return seen[keep]


def fit(docs: list[np.ndarray], labels: np.ndarray, prior: float, epochs: int = 12, rate: float = 0.15, sparse: float = 2e-4, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the log loss over the buckets of each document; prior: share of label 1 among all labelled rows."""
    buckets = telling(docs, labels)
    random = np.random.default_rng(seed)
    n = len(buckets)
    model = Machine(buckets, np.zeros(n), random.normal(0, 0.01, (n, FACTORS)), 0.0)
    if not n or not labels.any() or labels.all():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Machine(buckets[:0], np.zeros(0), np.zeros((0, FACTORS)), float(np.log(p / (1 - p))))
    rows = [np.searchsorted(buckets, d[np.isin(d, buckets)]) for d in docs]
    # rows of the rarer label count more, so that both weigh the same while fitting
    share = labels.mean()
    heft = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    g_w, g_v, g_b = np.full(n, 1e-8), np.full((n, FACTORS), 1e-8), 1e-8
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            features = np.concatenate([rows[k] for k in part])
            starts = np.r_[0, np.cumsum([len(rows[k]) for k in part])]
            slope = heft[part] * (1 / (1 + np.exp(-np.clip(model.margins(features, starts), -30, 30))) - labels[part]) / len(part)
            doc = np.repeat(np.arange(len(part)), np.diff(starts))
            v = model.vectors[features]
            summed = ragged_sum(v, starts)
            used, inverse = np.unique(features, return_inverse=True)
            grad_w = np.bincount(inverse, slope[doc], len(used))
            own = slope[doc][:, None] * (summed[doc] - v)
            grad_v = np.stack([np.bincount(inverse, own[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * model.vectors[used]
            g_w[used] += grad_w**2
            step = rate / np.sqrt(g_w[used])
            w = model.weights[used] - step * grad_w
            model.weights[used] = np.sign(w) * np.maximum(0, np.abs(w) - step * sparse)
            g_v[used] += grad_v**2
            model.vectors[used] -= 0.2 * rate * grad_v / np.sqrt(g_v[used])
            g_b += slope.sum() ** 2
            model.bias -= rate * slope.sum() / np.sqrt(g_b)
    # a bucket without a weight of its own still counts in pairs
    live = (np.abs(model.weights) > 0) | (np.abs(model.vectors).max(axis=1) > 0.05)
    return Machine(buckets[live], model.weights[live].astype(np.float32), model.vectors[live].astype(np.float32), float(model.bias))


def train(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> Machine:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic) whose crc32 of the id, modulo 5, is not 0.

    Ids of the sample, at most sample_per_label of either label, are few by that bound; they find their texts in one
    scan, and only the buckets of those texts reach the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_label) for y in (0, 1)]
    sample = docs.sparkSession.createDataFrame([tuple(r) for p in picked for r in p.collect()], "doc_id long, toxic int")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({b for w in words_of(t) for b in term_buckets(w)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "buckets"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(features, "doc_id long, toxic int, buckets array<int>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    buckets = rows.column("buckets").combine_chunks()
    offsets, values = buckets.offsets.to_numpy(), buckets.values.to_numpy()
    return fit([values[offsets[k] : offsets[k + 1]].astype(np.int64) for k in order], rows.column("toxic").to_numpy()[order].astype(np.int64), float(prior))


def scorer(spark, model: Machine):
    """A column function: probability of label 1 for a text."""
    shared = spark.sparkContext.broadcast(model)
    state: dict = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not state:
            state["index"], state["words"] = shared.value.index(), {}
        index, words = state["index"], state["words"]
        if len(words) > MEMORY_WORDS:
            words.clear()
        features, ends = [], [0]
        margins = []
        for k, text in enumerate(texts):
            own: set[int] = set()
            for w in words_of(text):
                found = words.get(w)
                if found is None:
                    found = words[w] = tuple(index[b] for b in term_buckets(w) if b in index)
                if found:
                    own.update(found)
            features += sorted(own)
            ends.append(len(features))
            if len(features) > 500_000 or k == len(texts) - 1:
                margins.append(shared.value.margins(np.array(features, np.int64), np.array(ends)))
                features, ends = [], [0]
        out = np.concatenate(margins) if margins else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5) and held_out (crc32 of the id as text, modulo 5, is 0).

    labels has the ids and toxic; only rows that aren't held out are learned from, at most sample_per_label of either
    label, and only the text is scored.

    Defined cases: a null or empty text has the score of no terms; a text of any length is read whole, each of its terms
    counting once; of rows tied for a place in the sample the smaller id is taken; a null id is not held out; an id that repeats is
    scored row by row; of several labels of an id the highest counts; without both labels to learn from, every score
    is the share of label 1 (0 if there is none); an empty table gives an empty table. Other columns pass through;
    score, predicted and held_out replace columns of those names.
    """
    model = train(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), labels.select(F.col(id_col).cast("long").alias("doc_id"), "toxic"), sample_per_label)
    score = scorer(docs.sparkSession, model)
    return docs.withColumn("score", score(F.col(f"`{text_col}`"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("held_out", F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False)))


def op4_toxicity(spark, sf_dir):
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")

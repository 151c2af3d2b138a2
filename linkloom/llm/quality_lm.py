"""Quality by an interpolated modified Kneser-Ney model of byte n-grams.

The model is counted on trusted texts. Each task counts the n-grams that it reads; counts are summed by n-gram, in as
many shards as there are shuffle partitions, and joined shard by shard: contexts' totals to n-grams, lower orders to
higher ones. Bytes, not words, keep the number of different n-grams near that of an alphabet's habits, in any script,
so counts shrink in every task before they are shuffled, and a new word is no surprise while odd marks or shouting are.

Texts fall into two folds by their hash, and each fold has a model of its own. A text is scored by the model of the
other fold, so no text, trusted or not, is judged by a model that has read it, nor by one that has read a copy of it;
the thresholds are those of unseen trusted texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import settle, table

ORDER, BITS = 5, 8
#: Marks the grams of the second fold.
FOLD = 1 << 62
#: Quantiles of the trusted documents' perplexities, in each language, between which a document is kept.
LOW, HIGH, ACCURACY = 0.002, 0.98, 10_000
#: A language's thresholds lie between its own and those of all, nearer its own the more trusted documents it has; halfway at so many.
HALFWAY = 50
#: The model goes to the executors as a whole up to so many n-grams (32 bytes each); beyond, n-grams are joined to it.
BROADCAST_GRAMS, BROADCAST_IDS, BROADCAST_LANGS = 8_000_000, 4_000_000, 10_000
#: The chance of a symbol of which nothing is known: one of 256 bytes.
UNIFORM = 1 / 256
BLANKS = re.compile(r"\s+")
DIGITS = re.compile(r"\d")
GRAM = "order int, gram long, p double, back double"


def codes(text: str) -> np.ndarray:
    """The bytes of a text, white space made single blanks and digits 0, after ORDER - 1 zeros."""
    text = BLANKS.sub(" ", DIGITS.sub("0", text)).strip()
    c = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    return np.concatenate([np.zeros(ORDER - 1, np.int64), np.maximum(c, 1)])


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte."""
    n = len(c) - ORDER + 1
    out = np.zeros(n, np.int64)
    for j in range(order):
        out = (out << BITS) | c[ORDER - order + j : ORDER - order + j + n]
    return out


def fold_of(text_hash: int) -> int:
    return FOLD * (text_hash & 1)


def ending(gram, k: int):
    """The last k symbols of a gram, in its fold."""
    return gram & (FOLD | ((1 << BITS * k) - 1))


def context(gram):
    """A gram without its last symbol."""
    return ((gram & ~FOLD) >> BITS) | (gram & FOLD)


def ending_column(k: int):
    return F.col("gram").bitwiseAND(F.lit(FOLD | ((1 << BITS * k) - 1)))


def context_column(gram):
    return F.shiftright(gram.bitwiseAND(F.lit(~FOLD)), BITS).bitwiseOR(gram.bitwiseAND(F.lit(FOLD)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-grams of the highest order, counted; the table of counts is sent on before it gets large."""

    def added(more: list[np.ndarray], known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new, m = np.unique(np.concatenate(more), return_counts=True)
        keys, inverse = np.unique(np.concatenate([known, new]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n, m]), len(keys)).astype(np.int64)

    known, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        for text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = grams(codes(text), ORDER) | fold_of(text_hash)
            held.append(found)
            size += len(found)
            if size > 2_000_000:
                known, n = added(held, known, n)
                held, size = [], 0
                if len(known) > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["gram", "n"])
                    known, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if held:
        known, n = added(held, known, n)
    if len(known):
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["gram", "n"])


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3), strict=True))


def fit(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """The model as a table (order, gram, p, back), counted over all of trusted.

    p is the interpolated probability of a gram's last symbol after the others; back, of a gram as context of one
    order more, is the weight of the lower order there (1 where the gram was never a context). The rows of order 0
    hold the probability of a symbol that was never seen. Both folds are in the table, told apart by FOLD.
    """
    counts = {ORDER: settle(trusted.where(F.col(text_col) != "").select(text_col, F.xxhash64(text_col)).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):  # of lower orders count different symbols before the gram, not places
        counts[k] = settle(counts[k + 1].groupBy(ending_column(k).alias("gram")).agg(F.count("*").alias("n")))
    below: DataFrame | None = None
    tables, lost = [], None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = counts[k].withColumn("context", context_column(F.col("gram"))).withColumn("cut", cut)
        totals = own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
        joined = own.join(totals, "context")
        if below is None:
            lost = totals
            now = joined.select("gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * UNIFORM).alias("p"))
        else:
            tables.append(_with_back(below, totals, k - 1))
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
            now = joined.withColumn("suffix", ending_column(k - 1)).join(lower, "suffix").select("gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("p_lower")).alias("p"))
        below = settle(now)
    tables.append(below.select(F.lit(ORDER).alias("order"), "gram", "p", F.lit(1.0).alias("back")))
    # contexts made of the zeros before a text never end a gram, so they have a weight only
    bottom = lost.select(F.lit(0).alias("order"), F.col("context").alias("gram"), F.lit(UNIFORM).alias("p"), F.col("weight").alias("back"))
    return settle(reduce(DataFrame.unionByName, [bottom, *tables]))


def _with_back(below: DataFrame, totals: DataFrame, order: int) -> DataFrame:
    joined = below.join(totals.withColumnRenamed("context", "gram"), "gram", "full")
    return joined.select(F.lit(order).alias("order"), "gram", "p", F.coalesce("weight", F.lit(1.0)).alias("back"))


class Model:
    """The model's table as sorted arrays, one pair for each order."""

    def __init__(self, orders: np.ndarray, gram: np.ndarray, p: np.ndarray, back: np.ndarray):
        self.at, self.p, self.back = [], [], []
        for k in range(ORDER + 1):
            rows = np.flatnonzero(orders == k)
            rows = rows[np.argsort(gram[rows], kind="stable")]
            self.at.append(gram[rows])
            self.p.append(p[rows])
            self.back.append(back[rows])
        self.unseen = [next((float(p * b) for g, p, b in zip(self.at[0], self.p[0], self.back[0], strict=True) if g == fold), UNIFORM) for fold in (0, FOLD)]

    def find(self, k: int, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.at[k]):
            return np.zeros(len(g), np.int64), np.zeros(len(g), bool)
        row = np.minimum(np.searchsorted(self.at[k], g), len(self.at[k]) - 1)
        return row, self.at[k][row] == g

    def log_p(self, distinct: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each gram of the highest order."""
        out, todo, factor = np.zeros(len(distinct)), np.arange(len(distinct)), np.ones(len(distinct))
        for k in range(ORDER, 0, -1):
            g = ending(distinct[todo], k)
            row, there = self.find(k, g)
            there = there & ~np.isnan(self.p[k][row]) if len(self.p[k]) else there
            out[todo[there]] = np.log(factor[there] * self.p[k][row[there]])
            todo, factor, g = todo[~there], factor[~there], g[~there]
            if not len(todo):
                return out
            if k > 1:
                row, there = self.find(k - 1, context(g))
                factor = np.where(there, factor * self.back[k - 1][row], factor) if len(self.back[k - 1]) else factor
        out[todo] = np.log(factor * np.where(distinct[todo] & FOLD, self.unseen[1], self.unseen[0]))
        return out


class Scorer:
    """Log probabilities of the grams that a worker has met, beside the model."""

    def __init__(self, model: Model):
        self.model = model

    def perplexities(self, texts: list[str | None], hashes: list[int]) -> list[float | None]:
        """By the model of the other fold."""
        every = [grams(codes(t), ORDER) | (fold_of(h) ^ FOLD) if t else np.zeros(0, np.int64) for t, h in zip(texts, hashes, strict=True)]
        flat = np.concatenate([*every, np.zeros(0, np.int64)])
        known = self.model.at[ORDER]
        logs = np.zeros(len(flat))
        row, there = self.model.find(ORDER, flat)
        logs[there] = self.logs[row[there]] if len(known) else 0.0
        other, inverse = np.unique(flat[~there], return_inverse=True)
        logs[~there] = self.model.log_p(other)[inverse]
        out, at = [], 0
        for g in every:
            out.append(float(np.exp(-logs[at : at + len(g)].mean())) if len(g) else None)
            at += len(g)
        return out

    @property
    def logs(self) -> np.ndarray:
        if not hasattr(self, "_logs"):
            self._logs = np.log(self.model.p[ORDER])
        return self._logs


def _scored(docs: DataFrame, model: DataFrame, text_col: str) -> DataFrame:
    rows = model.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("order", "gram", "p", "back")))
    state: dict = {}

    @F.pandas_udf("double")
    def perplexity(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        if not state:
            state["scorer"] = Scorer(Model(*shared.value))
        out, start, size, rows, own = [], 0, 0, list(texts), list(hashes)
        for k, t in enumerate(rows):
            size += len(t or "")
            if size > 500_000 or k == len(rows) - 1:
                out += state["scorer"].perplexities(rows[start : k + 1], own[start : k + 1])
                start, size = k + 1, 0
        return pd.Series(out, dtype=float)

    return docs.withColumn("perplexity", F.nanvl(perplexity(F.col(text_col), F.xxhash64(text_col)), F.lit(None).cast("double")))


def _joined(docs: DataFrame, model: DataFrame, text_col: str) -> DataFrame:
    """The same perplexities for a model of any size: each document's counts of grams are joined to every order's table."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                g, n = np.unique(grams(codes(text), ORDER) | (fold_of(key) ^ FOLD), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(g), pa.int64()), pa.array(g), pa.array(n)], names=["key", "gram", "n"])

    rows = docs.withColumn("__key", F.xxhash64(text_col))
    texts = rows.where(F.col(text_col) != "").select("__key", text_col).dropDuplicates(["__key"])
    found = settle(texts.mapInArrow(counted, "key long, gram long, n long"))
    distinct = found.select("gram").distinct()
    log_p, factor = F.lit(None).cast("double"), F.lit(1.0)
    for k in range(ORDER, 0, -1):
        level = model.where(F.col("order") == k).select(F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}"), F.col("back").alias(f"b{k}"))
        own = ending_column(k)
        distinct = distinct.withColumn(f"o{k}", own).join(level.select(f"g{k}", f"p{k}"), F.col(f"o{k}") == F.col(f"g{k}"), "left").drop(f"g{k}", f"o{k}")
        log_p = F.coalesce(log_p, F.log(factor * F.col(f"p{k}")))
        if k > 1:
            lower = model.where(F.col("order") == k - 1).select(F.col("gram").alias("gc"), F.col("back").alias(f"b{k}"))
            distinct = distinct.withColumn("c", context_column(own)).join(lower, F.col("c") == F.col("gc"), "left").drop("c", "gc")
            factor = factor * F.coalesce(F.col(f"b{k}"), F.lit(1.0))
    bottom = {r["gram"]: r["unseen"] for r in model.where("order = 0").select("gram", (F.col("p") * F.col("back")).alias("unseen")).collect()}  # a row for each fold
    unseen = F.when(F.col("gram") >= FOLD, bottom.get(FOLD, UNIFORM)).otherwise(bottom.get(0, UNIFORM))
    log_p = F.coalesce(log_p, F.log(factor * unseen))
    scores = found.join(distinct.select("gram", log_p.alias("log_p")), "gram").groupBy("key").agg(F.exp(-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("perplexity"))
    return rows.join(scores, rows["__key"] == scores["key"], "left").drop("__key", "key")


def score_quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """One row per row of docs: id_col, lang, trusted, perplexity, low and high (its language's thresholds) and kept.

    trusted_ids has one column, the ids of the documents to learn from; all of their texts are counted. A document is
    kept if its perplexity lies between the quantiles low and high of its language's trusted documents (a mergeable
    sketch of ACCURACY), drawn towards those of all languages by HALFWAY / (HALFWAY + number of trusted documents) on
    the scale of logarithms. Up to broadcast_grams every task holds the model; beyond, grams are joined to it.

    Defined cases: a null text, or one of white space, has a null perplexity and is not kept; a text of any length is
    read whole; a null language is one of its own; a null id is never trusted, and of an id that repeats every row is;
    rows that repeat get the same result; a perplexity equal to a threshold is kept; without trusted documents nothing
    can be judged, and every text is kept; an empty table gives an empty table; other columns are not returned, whatever
    their names.
    """
    ids = trusted_ids.toDF("__id").where("__id is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    own = own.withColumn("text", F.when(F.col("text").rlike(r"\S"), F.col("text")))
    model = fit(own.join(ids, F.col("id") == F.col("__id"), "left_semi"))
    scored = _scored(own, model, "text") if model.count() <= broadcast_grams else _joined(own, model, "text")
    scored = settle(scored.select("id", "lang", "perplexity"))
    scored = scored.join(ids, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("lang", F.lit("")).alias("key"), "lang", F.col("__id").isNotNull().alias("trusted"), "perplexity")
    known = scored.where("trusted and perplexity is not null")
    both = F.percentile_approx("perplexity", [low, high], ACCURACY)
    of_all = known.agg(both.alias("q")).first()["q"] or [0.0, float("inf")]
    by_lang = settle(known.groupBy("key").agg(both.alias("q"), F.count("*").alias("n")))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGS else by_lang
    own_share = F.col("n") / (F.col("n") + F.lit(HALFWAY))
    threshold = lambda k: F.coalesce(F.exp(own_share * F.log(F.col("q")[k]) + (1 - own_share) * F.log(F.lit(of_all[k]))), F.lit(of_all[k]))
    out = scored.join(by_lang, "key", "left").withColumn("low", threshold(0)).withColumn("high", threshold(1))
    kept = F.coalesce((F.col("perplexity") >= F.col("low")) & (F.col("perplexity") <= F.col("high")), F.lit(False))
    return out.select(F.col("id").alias(id_col), "lang", "trusted", "perplexity", "low", "high", kept.alias("kept"))


def op7_quality_classifier(spark, sf_dir):
    """Trusted: the documents of labels.quality 1."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_quality(table(spark, sf_dir, "documents"), trusted)

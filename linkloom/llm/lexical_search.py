"""Ranked lexical search: the best documents for each item of a query set, score-at-a-time over impact-ordered postings.

The documents are read once into a forward index that holds the item terms of each document. Each task then turns the
rows that it has read into shards: a term's postings in descending order of their exact impact (what the term adds to
the document's score). For an item, the groups of equal impact of all its terms are taken from the highest down, and
taking them ends only when what is left cannot bring another document among the best; the scores of those that are left
in are then completed from the forward rows. Only the best of each task are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.tables import LAST_ID, forget, settle, table

TOP = 10
#: Items are taken in blocks of so many bytes of text at most; a task handles so many postings at a time.
BLOCK_BYTES, SHARD_POSTINGS = 16 << 20, 2_000_000
#: Bytes of a document that are cut into terms at a time.
SLICE = 4 << 20
#: Groups of equal impact taken before the first look at the bounds; each further step takes twice as many.
FIRST_STEP = 16
#: Parts into which the rows of an item are dealt before the last ranking.
SALT = 32

#: Digits, letters in lower case and all bytes beyond ASCII stay; every other byte parts terms.
_BYTES = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in slices that end between two terms."""
    shown = (text or "").encode().translate(_BYTES)
    at = 0
    while at < len(shown):
        end = at + SLICE
        if end < len(shown) and (end := shown.find(b" ", end)) < 0:
            end = len(shown)
        yield shown[at:end].split()
        at = end


def weigh(terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


class Shard:
    """Some documents with their postings by term, in descending order of impact."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        docs = np.repeat(np.arange(len(ids)), np.diff(bounds))
        self.ids, self.bounds, self.terms = ids, bounds, terms
        self.impacts = weigh(terms, tfs.astype(np.int64), m[docs], weights)
        order = np.argsort(-self.impacts, kind="stable")
        order = order[np.argsort(terms[order], kind="stable")]
        self.docs, self.falling = docs[order], -self.impacts[order]
        self.first = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.scores = np.zeros(len(ids), np.int64)
        self.asked = np.zeros(len(weights), bool)

    def best(self, item: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(-score, id) of the k best documents with a score of at least floor, which is above 0."""
        at, last = self.first[item], self.first[item + 1]
        at, last = at[at < last], last[at < last]
        scores, falling, step = self.scores, self.falling, FIRST_STEP
        scores[:] = 0
        chosen = None
        while len(at):
            # every group of impact >= level, of all terms; half the terms go on by a step or to their ends
            ahead = falling[np.minimum(at + step, last - 1)]
            level = np.partition(ahead, len(ahead) // 2)[len(ahead) // 2]
            upto = [lo + np.searchsorted(falling[lo:hi], level, "right") for lo, hi in zip(at.tolist(), last.tolist(), strict=True)]
            own = np.concatenate([np.arange(lo, hi) for lo, hi in zip(at.tolist(), upto, strict=True)])
            np.add.at(scores, self.docs[own], -falling[own])
            at = np.array(upto)
            at, last, step = at[at < last], last[at < last], min(2 * step, len(scores))
            rest = -int(falling[at].sum())
            kth = max(floor, int(np.partition(scores, -k)[-k])) if len(scores) >= k else floor
            if rest < kth and len(chosen := np.flatnonzero(scores + rest >= kth)) <= k:
                break
            chosen = None
        if chosen is None:  # all is taken: the scores are whole
            kth = max(floor, int(np.partition(scores, -k)[-k])) if len(scores) >= k else floor
            chosen, whole = np.flatnonzero(scores >= kth), scores
            found = sorted((-int(whole[d]), int(self.ids[d])) for d in chosen.tolist())
        else:
            self.asked[item] = True
            rows = (slice(self.bounds[d], self.bounds[d + 1]) for d in chosen.tolist())
            found = sorted((-int(self.impacts[r][self.asked[self.terms[r]]].sum()), int(self.ids[d])) for d, r in zip(chosen.tolist(), rows, strict=True))
            self.asked[item] = False
        return [x for x in found if -x[0] >= floor][:k]


def forward_index(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """One row per document: id, n_terms, and the numbers in terms of those that it holds, in order, with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: k for k, t in enumerate(shared.value)}
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column(1).to_pylist():
                size, own, n = 0, np.zeros(0, np.int32), np.zeros(0, np.int64)
                for words in terms_of(text):
                    size += len(words)
                    new, m = np.unique(np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words)), return_counts=True)
                    own, place = np.unique(np.concatenate([own, new]), return_inverse=True) if len(own) else (new, np.arange(len(new)))
                    n = np.bincount(place, np.concatenate([n, m])).astype(np.int64)
                sizes.append(size)
                found.append(own[own >= 0])
                counts.append(n[own >= 0])
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(x).astype(np.int32) if x else [], pa.int32())) for x in (found, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n_terms", "terms", "counts"])

    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return own.mapInArrow(read, "id long, n_terms long, terms array<int>, counts array<int>")


def best_of_tasks(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_postings: int) -> DataFrame:
    """Rows item (its place in items), id and score: the k best of what each task has read, or more."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]

        def take(some: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(some).combine_chunks()
            sizes = whole["n_terms"].to_numpy()
            terms, counts = (whole[c].combine_chunks() for c in ("terms", "counts"))
            bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
            shard = Shard(whole["id"].to_numpy(), 100 - 90 + (90 * sizes * n_docs) // n_terms, bounds, terms.flatten().to_numpy(), counts.flatten().to_numpy(), weights)
            for i, item in enumerate(items):
                floor = -best[i][-1][0] if len(best[i]) == k else 1
                best[i] = sorted(best[i] + shard.best(item, k, floor))[:k]

        held, size = [], 0
        for batch in batches:
            # a row's postings are distinct terms of the items, so no row is larger than their number
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= shard_postings:
                take(held)
                held, size = [], 0
        if held:
            take(held)
        rows = [(i, d, -s) for i, own in enumerate(best) for s, d in own]
        for lo in range(0, len(rows), 100_000):
            part = list(zip(*rows[lo : lo + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], names=["item", "id", "score"])

    return index.where(F.size("terms") > 0).mapInArrow(search, "item int, id long, score long")


def _blocks(items: DataFrame, block_bytes: int) -> list[list[tuple]]:
    """Conditions under which the items of a block are read: blocks hold block_bytes of text at most, or one item."""
    total = items.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        sizes = items.groupBy(block.alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        if all(r["size"] <= block_bytes or r["n"] == 1 for r in sizes):
            return [block == r["block"] for r in sizes]
        n *= 2


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The k documents of the highest score for each query: query_id, rank (from 1), id_col (long) and score (long).

    Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. A term in df of the N
    documents with terms weighs w = floor(1000 ln((2N + 2) / (2df + 1))); with tf occurrences in a document of n terms it
    adds w * ((10^9 tf) div (1000 tf + 8m)), where m = 10 + (90 n N) div L and L is the number of all terms. A query's
    terms count once each; only scores above 0 are returned, equal ones by ascending id.

    Queries are taken in blocks of block_bytes of text, so that the terms of a block fit a worker; each block is a pass of
    its own over docs, and results do not depend on the number of blocks.

    Defined cases: null and empty texts have no terms, and find nothing as queries; a text of any length is read whole;
    rows of docs that repeat, with whatever id, are documents of their own, and a null id comes after all others among
    equal scores and is returned as null; of equal scores and ids any row is as good; a query is a pair of id and text:
    repeated rows count once, other texts under one id are ranked by themselves, and a null id is returned as it is;
    empty tables give an empty table; other columns are not returned, whatever their names.
    """
    asked = queries.select(F.col(f"`{query_id}`").alias("item_id"), F.col(f"`{query_text}`").alias("text")).where("text is not null").distinct().withColumn("size", F.octet_length("text") + F.lit(16))
    spark, parts = docs.sparkSession, []
    blocks = _blocks(asked, block_bytes)
    if not blocks:
        blocks, docs = [F.lit(False)], docs.limit(0)
    for where in blocks:
        rows = sorted((tuple(r) for r in asked.where(where).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r))
        words = [sorted({w for part in terms_of(t) for w in part}) for _, t in rows]
        terms = sorted(set().union(*words)) if words else []
        number = {t: j for j, t in enumerate(terms)}
        index = settle(forward_index(docs, id_col, text_col, terms))
        n_docs, n_terms = index.where("n_terms > 0").agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
        found = best_of_tasks(index, [np.array([number[w] for w in ws], np.int64) for ws in words], weights, n_docs, n_terms, k, shard_postings)
        order = [F.col("score").desc(), F.col("id")]
        first = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        kept = settle(last.select("item", "rank", "id", "score"))  # k rows of each query
        forget(index)
        names = spark.createDataFrame([(j, r[0]) for j, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        parts.append(kept.join(names, "item").select(F.col("item_id").alias(query_id), F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(LAST_ID)).alias(id_col), "score"))
    return reduce(DataFrame.unionByName, parts)


def op13_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), sizes AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), total AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN weights USING (term) JOIN sizes USING (doc_id), total
), scores AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a seed of min_match words are tiled: their longest common stretch of words that
are still unmarked is marked, again and again, down to min_match words. Matches are found with Karp-Rabin hashes of
min_match words where the words before differ, so each longest match is found once, at its start, and run on by halving.
The share of the item's words that tiles cover decides, so a passage
is caught when its parts come in another order.

Test items are taken in blocks of bounded size. A block is joined to the documents where they are: every task holds the
block's seeds, so no document is shuffled, and a seed that a third of all documents share costs nothing more.
"""

from __future__ import annotations

import heapq
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import settle, table, unused

MIN_MATCH, MIN_COVERAGE = 5, 0.5
#: An item of fewer than min_match words is matched as a whole if it has so many characters; a shorter one matches nothing.
MIN_CHARS = 20
#: A block of test items has about so many bytes of text, or is a single item.
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<item_id:long,n_item_words:int,n_covered:int,n_tiles:int,tiles:array<struct<doc_word:int,item_word:int,n_words:int>>>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of every k successive word codes."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = out * BASE + ids[j : len(ids) - k + 1 + j]
    return out


def prefix_sums(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums of codes times powers up to each place, modulo 2**64: stretches of two arrays are told apart by their differences."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=out[1:])
    return out


def tile(doc: np.ndarray, item: np.ndarray, matches: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), the longest first. doc and item are word codes; matches has rows (place in doc, place in item, words) that cannot be made longer on either side."""
    matches = matches[np.lexsort((matches[:, 1], matches[:, 0], -matches[:, 2]))]
    in_doc, in_item, tiles, covered = bytearray(len(doc)), bytearray(len(item)), [], 0
    pieces: list[tuple[int, int, int]] = []
    rows = ((-n, p, q) for p, q, n in map(np.ndarray.tolist, matches))
    at = next(rows, None)
    while (at or pieces) and len(item) - covered >= min_match:
        if at and (not pieces or at < pieces[0]):
            (n, p, q), at = at, next(rows, None)
        else:
            n, p, q = heapq.heappop(pieces)
        n = -n
        if in_item.count(1, q, q + n) > n - min_match:
            continue
        free = np.frombuffer(in_doc, np.uint8)[p : p + n] + np.frombuffer(in_item, np.uint8)[q : q + n] == 0
        free &= doc[p : p + n] == item[q : q + n]
        if free.all():
            tiles.append((p, q, n))
            in_item[q : q + n] = in_doc[p : p + n] = b"\x01" * n
            covered += n
        elif np.count_nonzero(free) >= min_match:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
            for begin, end in edges.reshape(-1, 2).tolist():
                if end - begin >= min_match:
                    heapq.heappush(pieces, (begin - end, p + begin, q + begin))
    return tiles


class Seeds:
    """The windows of so many words of test items, by hash and by the word before: sorted, with the item and place of each."""

    def __init__(self, n: int, items: list[tuple[int, np.ndarray]]):
        self.n = n
        hashes = np.concatenate([rolling(codes, n) for _, codes in items])
        left = np.concatenate([np.concatenate([[1], codes[: len(codes) - n].astype(np.int64) + 2]) for _, codes in items])
        self.groups, group = np.unique(hashes, return_inverse=True)
        keys = (group << 32) + left
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate([np.full(len(codes) - n + 1, k) for k, codes in items])[order]
        self.place = np.concatenate([np.arange(len(codes) - n + 1) for _, codes in items])[order]

    def pairs(self, ids: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document places, items and item places where a window is equal and the words before it are not.

        A place deep in a longer match, or in a period that both have, has equal words before it and is never listed.
        """
        whole = np.flatnonzero(missing[self.n :] == missing[: -self.n])
        hashes = rolling(ids.astype(np.uint64), self.n)[whole]
        group = np.minimum(np.searchsorted(self.groups, hashes), len(self.groups) - 1)
        known = self.groups[group] == hashes
        at, group = whole[known], group[known]
        if not len(at):
            return at, at, at
        left = np.where(at > 0, ids[at - 1] + 2, 0)
        left[left == 1] = 0  # a word that no item has
        first, last = np.searchsorted(self.keys, group << 32), np.searchsorted(self.keys, (group + 1) << 32)
        same, after = np.searchsorted(self.keys, (group << 32) + left), np.searchsorted(self.keys, (group << 32) + left, "right")
        starts, sizes = np.concatenate([first, after]), np.concatenate([same - first, last - after])
        own = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.repeat(np.concatenate([at, at]), sizes), self.item[own], self.place[own]


class Items:
    """A block of test items (item_id, text) with an index of their seeds."""

    def __init__(self, rows: list[tuple[int | None, str]], min_match: int, min_coverage: float):
        self.min_coverage = min_coverage
        words = [(i, words_of(t)) for i, t in rows]
        words = [(i, w) for i, w in words if len(w) >= min_match or sum(map(len, w)) >= MIN_CHARS]
        self.ids = [i for i, _ in words]
        self.codes = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in words for w in ws))}
        self.items = [np.array([self.codes[w] for w in ws], np.uint64) for _, ws in words]
        self.seed_words = [min(min_match, len(w)) for w in self.items]
        self.seeds = [Seeds(n, [(k, w) for k, w in enumerate(self.items) if self.seed_words[k] == n]) for n in sorted(set(self.seed_words))]
        self.starts = np.cumsum([0, *map(len, self.items)])
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(self.starts[-1]) + 1, BASE)]))
        self.sums = prefix_sums(np.concatenate([*self.items, np.zeros(1, np.uint64)]) + np.uint64(1), self.powers)

    def hits(self, text: str | None) -> list[dict]:
        words = words_of(text)
        ids = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        missing = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids < 0, out=missing[1:])
        found = [(seeds.n, *seeds.pairs(ids, missing)) for seeds in self.seeds if len(ids) >= seeds.n]
        out = []
        for n, p, item, q in found:
            if len(p):
                size = self.lengths(ids, p, item, q, n)
                order = np.argsort(item, kind="stable")
                bounds = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    own = order[lo:hi]
                    out.append((int(item[own[0]]), np.stack([p[own], q[own], size[own]], axis=1)))
        return [hit for k, matches in sorted(out, key=lambda x: x[0]) if (hit := self.judge(ids, k, matches))]

    def lengths(self, ids: np.ndarray, p: np.ndarray, item: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        """How far the words from p and q on are equal, n at least: by halving, each step one comparison of sums."""
        if len(self.powers) <= len(ids):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * len(ids), BASE)]))
        sums, powers = prefix_sums((ids + 1).astype(np.uint64), self.powers), self.powers
        at = self.starts[item] + q
        low, high = np.full(len(p), n), np.minimum(len(ids) - p, self.starts[item + 1] - at)
        while len(open_ := np.flatnonzero(low < high)):
            half = (low[open_] + high[open_] + 1) // 2
            a, b = p[open_], at[open_]
            equal = (sums[a + half] - sums[a]) * powers[b] == (self.sums[b + half] - self.sums[b]) * powers[a]
            low[open_] = np.where(equal, half, low[open_])
            high[open_] = np.where(equal, high[open_], half - 1)
        return low

    def judge(self, ids: np.ndarray, k: int, matches: np.ndarray) -> dict | None:
        i, item = self.ids[k], self.items[k].astype(np.int64)
        tiles = tile(ids, item, matches, self.seed_words[k])
        covered = sum(n for _, _, n in tiles)
        if covered < self.min_coverage * len(item) or not tiles:
            return None
        return {"item_id": i, "n_item_words": len(item), "n_covered": covered, "n_tiles": len(tiles), "tiles": [{"doc_word": p, "item_word": q, "n_words": n} for p, q, n in tiles]}


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The distinct test items, in blocks whose texts have about block_bytes at most; an item that is longer is one alone."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct().withColumn("size", F.octet_length("text") + F.lit(16))
    total = items.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        sizes = items.groupBy(block.alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        if all(r["size"] <= block_bytes or r["n"] == 1 for r in sizes):
            return [items.where(block == r["block"]).select("item_id", "text") for r in sizes]
        n *= 2


def _with_hits(docs: DataFrame, text_col: str, block: DataFrame, min_match: int, min_coverage: float, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is None, r)))
    state: dict = {}

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        if "items" not in state:
            state["items"] = Items(shared.value, min_match, min_coverage)
        return pd.Series([state["items"].hits(t) for t in texts], dtype=object)

    return docs.withColumn(name, hits(F.col(f"`{text_col}`")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and test item of which tiles cover at least min_coverage: id_col, item_id, n_item_words, n_covered, n_tiles, tiles, coverage.

    Words are runs of \\w, in lower case; tiles have min_match words at least, or are a shorter item as a whole.
    benchmark has item_id and text; beyond block_bytes of text it is taken in several blocks, each in a pass of its own
    over docs, with equal results.

    Defined cases: null and empty texts, and items of fewer than min_match words and MIN_CHARS characters, match
    nothing; a text of any length is read whole; a null id is returned as it is; rows of docs that repeat are judged one
    by one; an item is a pair of item_id and text: rows of benchmark that repeat one count once, other texts under the
    same item_id are items of their own, and a null item_id is returned as it is; of tiles of one length the first in
    the document is marked first; empty tables give an empty table; other columns are not returned, whatever their names.
    """
    own = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    blocks = _blocks(benchmark, block_bytes)
    parts = [_with_hits(own, "__text", b, min_match, min_coverage, "__hits").select(id_col, F.inline("__hits")) for b in blocks[:1] or [benchmark.select("item_id", "text").limit(0)]]
    for b in blocks[1:]:  # one block at a time, so that the driver and the tasks never hold two
        parts[-1] = settle(parts[-1])
        parts.append(_with_hits(own, "__text", b, min_match, min_coverage, "__hits").select(id_col, F.inline("__hits")))
    return reduce(DataFrame.unionByName, parts).withColumn("coverage", F.col("n_covered") / F.col("n_item_words"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that find_leaks() reports, each judged by its own text; the same columns, and the same defined cases.

    Clean rows stay whatever their id, null or repeated ones too. id_col is not read: it is there for the same call.
    """
    name = unused("hits", docs)
    for k, b in enumerate(_blocks(benchmark, block_bytes)):
        left = settle(docs) if k else docs
        docs = _with_hits(left, text_col, b, min_match, min_coverage, name).where(F.size(name) == 0).drop(name)
    return docs


def op10_benchmark_decontamination(spark, sf_dir):
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_words", "n_covered", "n_tiles", "coverage", F.lit(True).alias("contaminated"))

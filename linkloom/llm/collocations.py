"""Phrase collocations: phrases of two to five words that come together more often than their parts would by chance.

The first pass over the texts counts hashes of all phrases in a sketch whose width grows with the input; a cell's count
is an upper bound for every phrase in it. In the second pass each task takes those phrases of its shard all of whose
parts have cells that reach the threshold as candidates, compiles them into an automaton, with a blank as the guard on
both sides, and counts overlapping matches in its shard. The counts of all shards are summed and the threshold is
applied to the sums, so the sketch only saves work: whatever its cells hold, counts are those of the texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from linkloom.llm.tables import settle, table

MAX_WORDS, MIN_COUNT, PERCENT, TOP = 5, 100, 100, 2000
#: Bytes of text for one cell of the sketch; cells are merged in parts of so many; a sketch has so many parts at most.
CELL_BYTES, PART_CELLS, MAX_PARTS = 16, 1 << 20, 1 << 10
#: Bytes of text for each part into which phrases are dealt for their sums.
PART_BYTES = 1 << 20
#: Characters whose candidates are compiled into one automaton, characters that are hashed at a time, and phrases of
#: which a task holds counts.
SHARD_CHARS, SLICE_CHARS, HELD_PHRASES = 8_000_000, 1_000_000, 400_000
#: Words whose hashes a worker remembers before it starts again.
MEMORY_WORDS = 400_000
#: Parts into which the phrases of a language are dealt before the last ranking.
SALT = 64
NO_LANG = "und"

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)} | {"\t": " "})
_BREAKS = re.compile("[.,;:!?\n-\r]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxh3_64_intdigest(word)
        return h


def slices(text: str) -> Iterator[str]:
    """The text in lower case with one line break for each run of marks, in slices that end between two pieces."""
    text = _BREAKS.sub(" \n ", text.translate(_LOWER))
    at = 0
    while at < len(text):
        end = text.find("\n", at + SLICE_CHARS)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def gather(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[str, list[str]]]:
    """Slices of texts by language, about so many characters at a time."""
    held: dict[str, list[str]] = defaultdict(list)
    size: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in slices(text):
                held[lang].append(part)
                size[lang] += len(part)
                if size[lang] >= chars:
                    yield lang, held.pop(lang)
                    del size[lang]
    yield from held.items()


def joined(parts: list[str]) -> Iterator[list[str]]:
    """Words of the parts, a line break between pieces, about SLICE_CHARS at a time."""
    some, size = [], 0
    for p in parts:
        some.append(p)
        size += len(p)
        if size >= SLICE_CHARS:
            yield [w for w in " \n ".join(some).split(" ") if w]
            some, size = [], 0
    if some:
        yield [w for w in " \n ".join(some).split(" ") if w]


def phrase_hashes(words: list[str], known: Hashes, lang: str, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words from 1: hashes of the phrases that begin at each word, and which of them lie in a piece."""
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    inside = np.fromiter((w != "\n" for w in words), bool, len(words))
    h, whole = np.full(len(words), xxh3_64_intdigest(lang), np.uint64), inside
    for n in range(max_words):
        if n:
            h, whole = h[:-1], whole[:-1] & inside[n:]
        h = (h ^ own[n:]) * _MIX
        h ^= h >> np.uint64(29)
        yield h, whole


def cells_of(h: np.ndarray, cells: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def to_gaps(sorted_: np.ndarray) -> bytes:
    """Sorted numbers, repeats too, as their differences of a byte each; 255 adds 255 and stands for no number."""
    gaps = np.diff(sorted_, prepend=0)
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def sketch(own: DataFrame, cells: int, max_words: int, min_count: int) -> DataFrame:
    """Rows part and bits: for each cell of a part whether so many phrases or more fall into it."""
    part_cells = min(PART_CELLS, cells)
    parts = cells // part_cells

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            found = np.repeat(found, np.minimum(n, min_count))
            at = np.searchsorted(found, np.arange(parts + 1) * part_cells)
            rows = [(p, to_gaps(found[at[p] : at[p + 1]].astype(np.int64) - p * part_cells)) for p in range(parts) if at[p] < at[p + 1]]
            for lo in range(0, len(rows), 64):
                number, data = zip(*rows[lo : lo + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(data, pa.binary())], names=["part", "gaps"])

        for lang, texts in gather(batches, SLICE_CHARS):
            for words in joined(texts):
                if len(known) > MEMORY_WORDS:
                    known = Hashes()
                held += [cells_of(h[whole], cells).astype(np.uint32) for h, whole in phrase_hashes(words, known, lang, max_words)]
            if sum(map(len, held)) > SHARD_CHARS:
                yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part, so one part is held at a time
        part, sums = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(sums >= min_count, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield done()
                    part, sums = p, np.zeros(part_cells, np.int64)
                sums += np.bincount(from_gaps(data), minlength=part_cells)
        if part is not None:
            yield done()

    return own.mapInArrow(count, "part int, gaps binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")


def bits_of(own: DataFrame, cells: int, max_words: int, min_count: int) -> np.ndarray:
    """The whole sketch, a bit for each cell: MAX_PARTS * PART_CELLS bits at most, 128 MiB."""
    part_bytes = min(PART_CELLS, cells) // 8
    out = np.zeros(cells // 8, np.uint8)
    for r in sketch(own, cells, max_words, min_count).toLocalIterator():
        out[r["part"] * part_bytes : (r["part"] + 1) * part_bytes] = np.frombuffer(r["bits"], np.uint8)
    return out


def count_phrases(own: DataFrame, bits: np.ndarray, max_words: int, parts: int) -> DataFrame:
    """Rows part, lang, phrases and counts, partial ones: all phrases that may reach the threshold, and the number of words under the empty phrase.

    A task's counts are dealt into parts by the phrases' hashes, so that they are shuffled in blocks, not one by one.
    """
    cells, shared = 8 * len(bits), own.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Hashes(), shared.value
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                blocks: dict[int, list[tuple[str, int]]] = defaultdict(list)
                for phrase, f in own.items():
                    blocks[xxh3_64_intdigest(phrase) % parts].append((phrase, f))
                numbers = list(blocks)
                for lo in range(0, len(numbers), 1000):
                    some = numbers[lo : lo + 1000]
                    held = [list(zip(*blocks[n], strict=True)) for n in some]
                    columns = [pa.array(some, pa.int64()), pa.array([lang] * len(some), pa.string()), pa.array([h[0] for h in held], pa.list_(pa.string())), pa.array([h[1] for h in held], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "lang", "phrases", "counts"])
            counts.clear()

        for lang, texts in gather(batches, SHARD_CHARS):
            found: dict[int, str] = {}
            for words in joined(texts):
                if len(known) > MEMORY_WORDS:
                    known = Hashes()
                frequent = None
                for n, (h, whole) in enumerate(phrase_hashes(words, known, lang, max_words), 1):
                    cell = cells_of(h, cells)
                    reach = whole & (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                    frequent = reach if frequent is None else reach & frequent[:-1] & frequent[1:]
                    at = np.flatnonzero(frequent)
                    keys, first = np.unique(h[at], return_index=True)
                    for key, p in zip(keys.tolist(), at[first].tolist(), strict=True):
                        if key not in found:
                            found[key] = " ".join(words[p : p + n])
                counts[lang][""] += len(words) - words.count("\n")
            phrases = list(found.values())
            if phrases:
                automaton = ahocorasick.Automaton()
                for k, p in enumerate(phrases):
                    automaton.add_word(f" {p} ", k)
                automaton.make_automaton()
                sums = np.zeros(len(phrases), np.int64)
                for words in joined(texts):
                    # a line break is a word that no phrase has
                    matches = np.fromiter((k for _, k in automaton.iter(f" {' '.join(words)} ")), np.int64)
                    sums += np.bincount(matches, minlength=len(phrases))
                counts[lang].update(dict(zip(phrases, sums.tolist(), strict=True)))
            if sum(map(len, counts.values())) > HELD_PHRASES:
                yield from flush()
        yield from flush()

    return own.mapInArrow(count, "part long, lang string, phrases array<string>, counts array<long>")


def sum_phrases(counted: DataFrame, min_count: int) -> DataFrame:
    """Rows lang, phrase and f of the phrases that reach the threshold, and of the empty one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted, so the phrases of one part and language are held at a time
        at, sums = None, Counter()

        def done() -> pa.RecordBatch:
            kept = [(p, f) for p, f in sums.items() if f >= min_count or not p]
            return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()), pa.array([f for _, f in kept], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for part, lang, phrases, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, lang) != at:
                    if at is not None:
                        yield done()
                    at, sums = (part, lang), Counter()
                sums.update(dict(zip(phrases, f, strict=True)))
        if at is not None:
            yield done()

    return counted.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(merge, "lang string, phrase string, f long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, percent: int = PERCENT, top: int = TOP, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and split at [.,;:!?\\x0A-\\x0D] into pieces and those at blanks and tabs into words. a
    phrase of 2 to max_words words within a piece is a candidate if it occurs a >= min_count times, overlaps counted. A
    cut after its first words, found l times, before the rest, found r times, scores floor(1000 a n / (l r)), with n for
    all words of the language; the lowest score counts, of equal ones that of the first cut. Candidates within a longer
    one that has percent of their occurrences or more go.

    cell_bytes is the text for each cell of the sketch. Up to its full width (16 GiB of text at the given size) about 13
    phrases fall into a cell by chance; beyond it cells fill up and more candidates are counted in vain: the shuffle
    grows towards that of plain counting, results stay the same.

    Defined cases: a null or empty text has no words; a null language is `und`, like that language itself; a text of any
    length is read whole, piece by piece, and a piece of any length is held by one task; rows that repeat count each, ids
    are not read; equal scores are ranked by a, descending, then by phrase in the order of its bytes; an empty table
    gives an empty table; other columns are not read, whatever their names.
    """
    own = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max(1 << 10, 1 << (size // cell_bytes).bit_length()), MAX_PARTS * PART_CELLS)
    counted = count_phrases(own, bits_of(own, cells, max_words, min_count), max_words, 1 + size // PART_BYTES)
    sums = settle(sum_phrases(counted, min_count))
    totals = sums.where("phrase = ''").select("lang", F.col("f").alias("n"))  # a row for each language
    sums = sums.where("phrase <> ''").withColumn("words", F.split("phrase", " "))
    several = sums.where(F.size("words") > 1)

    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = several.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(sums.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(sums.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    # products have 38 digits at most: 1000 a n below 1e38, l r below 1e38
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("down", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))

    # of the longer ones around a phrase, one with a word more has the most occurrences
    around = several.where(F.size("words") > 2).select("lang", F.col("f").alias("longer"), F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    # SALT * top rows of a language at most
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words))::HUGEINT AS n FROM worded GROUP BY lang
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS p FROM worded
), grams AS (
  SELECT lang, words[p : p + m - 1] AS g FROM starts, range(1, 6) AS sizes(m) WHERE p + m - 1 <= len(words)
), counts AS (
  SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100
), cuts AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM counts WHERE len(g) > 1
), scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)]
  JOIN totals ON totals.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, g[1 : len(g) - 1] AS g, f FROM counts WHERE len(g) > 2 UNION ALL SELECT lang, g[2 : len(g)], f FROM counts WHERE len(g) > 2
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM lowest s
  WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = s.lang AND i.g = s.g AND 100 * i.f >= 100 * s.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Sorting every suffix of a corpus would shuffle each byte hundreds of times, so only some suffixes are: for each string
of the wanted length, the one that begins at the string's smallest hash of 32 bytes. Equal strings have theirs at the
same place, so equal strings always meet. Two kinds of suffixes never reach the sort: those whose leading bytes no other
suffix has, and copies with the same surroundings, which are one class from the start.

What is left is cut out of the texts and dealt by ranges of the leading bytes (Spark samples the splitters). Within a
range all strings are sorted by a multikey quicksort, which takes eight bytes at a time and sets those equal to the pivot
aside; strings that end up beside an equal one are repeated. A range never ends between equal leading bytes, so the
strings on both sides of a boundary differ there already. Leading bytes that too many classes share for one task are
dealt anew, by the fingerprints of their strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import LAST_ID, settle, table

LENGTH, GRAM = 400, 32
#: Suffixes that share their leading bytes are compared within a task up to so many; beyond, by a shuffle.
RUN = 4000
#: Classes with more copies than this, or than one in HOT_SHARE rows, are joined by broadcast; so they are HOT_SHARE at most.
HOT, HOT_SHARE = 1000, 50_000
RANGE_BYTES, BLOCK_BYTES = 24 << 20, 1 << 21
PIECE = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(17)
BYTES, BYTES2 = (_random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        one = np.ones(max(n, 2 * PIECE), np.uint64)
        _powers[:] = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = one * np.uint64(b)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sums:
    """Fingerprints of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES2[data] * up[: len(data)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each width successive ones."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def sampled(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of pieces laid end to end: place, head, first string's start, number of strings, fingerprint of all they cover.

    bounds: where pieces begin, and the end. Every string of length bytes within a piece belongs to one sampled suffix.
    """
    h, have = BYTES[data], 1
    while have < GRAM:
        h = h[:-have] * np.uint64(pow(BASE, have, 1 << 64)) + h[have:]
        have *= 2
    g = mix(h)
    low = smallest((g & ~PLACE) | np.arange(len(g), dtype=np.uint64), length - GRAM + 1)
    at = (low & PLACE).astype(np.int64)
    inside = np.diff(bounds) >= length
    first, last = bounds[:-1][inside], bounds[1:][inside] - length
    keep = np.zeros(len(at) + 1, np.int8)
    keep[first] += 1
    np.add.at(keep, last + 1, -1)
    p = np.flatnonzero(np.cumsum(keep[:-1]))
    a = at[p]
    begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    # pieces lie end to end, but the strings that would cross from one to the next are not in p
    start, n = p[begins], np.diff(np.r_[begins, len(p)])
    place = a[begins]
    around = Sums(data)(start, start + n + length - 1)
    around = mix(around + (place - start).astype(np.uint64) * np.uint64(BASE) + n.astype(np.uint64))
    return place, g[place], start, n, around


def _sampler(length: int):
    names = ["id", "text_hash", "head", "around", "at", "start", "n"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            bounds = np.cumsum([0, *(len(b) for _, _, b in held)])
            place, head, start, n, around = sampled(np.frombuffer(b"".join(b for _, _, b in held), np.uint8), bounds, length)
            piece = np.searchsorted(bounds, start, "right") - 1
            row, offset = np.array([r for r, _, _ in held])[piece], np.array([o for _, o, _ in held])[piece] - bounds[piece]
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(head.view(np.int64)), pa.array(around.view(np.int64)), *(pa.array((x + y).astype(np.int32)) for x, y in ((place, offset), (start, offset), (n, 0)))], names=names)

        for batch in batches:
            held, size = [], 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                if len(text) < length:
                    continue
                for o in range(0, len(text) - length + 1, PIECE - length + 1):
                    piece = text[o : o + PIECE]
                    held.append((row, o, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    return sample


def _cutter(length: int):
    names = ["lead", "head", "copies", "crowded", "id", "text_hash", "start", "n", "body"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around each suffix, from the first string's start to the last one's end."""
        for batch in batches:
            for i, t, text, suffixes in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for s in range(0, len(suffixes), 2000):
                    part = suffixes[s : s + 2000]
                    col = lambda c: [x[c] for x in part]  # noqa: B023, E731
                    arrays = [pa.array([text[a : a + 16] for a in col("at")], pa.binary()), pa.array(col("head"), pa.int64()), pa.array(col("copies"), pa.int64()), pa.array(col("crowded"), pa.bool_())]
                    arrays += [pa.array([i] * len(part), pa.int64()), pa.array([t] * len(part), pa.int64()), pa.array(col("start"), pa.int32()), pa.array(col("n"), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([text[x["start"] : x["start"] + x["n"] + length - 1] for x in part], pa.binary())], names=names)

    return cut


def strings_of(bodies: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes laid end to end, and the row and the place of each string in them."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum([0, *(len(b) for b in bodies[:-1])])
    row = np.repeat(np.arange(len(n)), n)
    return data, row, begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def equal_runs(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of length bytes that start at these places are equal to another.

    Multikey quicksort, for all runs at once and eight bytes at a time. In each round the first string of a run is its
    pivot. Strings equal to the pivot are set aside as done; the others fall into new runs by the place where they part
    from it, and by whether they are smaller or larger there. A string alone in its run is done. Bytes are compared,
    not fingerprints.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(data)]
    steps = [*range(0, length - 7, 8), length - 8] if length % 8 else list(range(0, length, 8))

    first = word[at]
    order = np.argsort(first, kind="stable")
    index, run = order, np.cumsum(np.r_[False, first[order][1:] != first[order][:-1]])
    found = [np.empty(0, np.int64)]
    while len(index):
        begin = np.r_[True, run[1:] != run[:-1]]
        size = np.diff(np.r_[np.flatnonzero(begin), len(run)])
        several = np.repeat(size > 1, size)
        index, begin = index[several], begin[several]
        if not len(index):
            break
        run = np.cumsum(begin) - 1
        # the middle one, so strings that come in order are halved as well
        pivot = at[index[np.flatnonzero(begin) + (np.bincount(run) - 1) // 2]][run]
        own, parted, open_ = at[index], np.full(len(index), -1), np.arange(len(index))
        for k, step in enumerate(steps):
            differ = word[own[open_] + step] != word[pivot[open_] + step]
            parted[open_[differ]] = k
            open_ = open_[~differ]
        equal = parted < 0  # the pivots among them
        n_equal = np.bincount(run, equal)
        found.append(index[equal & (n_equal[run] > 1)])
        index, run, own, pivot, parted = index[~equal], run[~equal], own[~equal], pivot[~equal], parted[~equal]
        step = np.array(steps)[parted]
        larger = word[own + step] > word[pivot + step]
        key = (run * len(steps) + parted) * 2 + larger
        order = np.argsort(key, kind="stable")
        index, run = index[order], key[order]
    return np.sort(np.concatenate(found))


def _comparer(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their leading bytes. Out: stretches of repeated strings, of suffixes without copies."""

        def flush() -> pa.RecordBatch:
            n = np.array([r[6] for r in rows])
            data, row, at = strings_of([r[7] for r in rows], n)
            found = equal_runs(data, at, length)
            found = found[(np.array([r[2] for r in rows]) == 1)[row[found]]]
            owner, place = row[found], found - (np.cumsum(n) - n)[row[found]]
            begins = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]) if len(found) else np.zeros(0, np.int64)
            ends = np.r_[begins[1:], len(found)][: len(begins)] - 1
            mine = [rows[k] for k in owner[begins]]
            start = np.array([r[5] for r in mine], np.int64) + place[begins]
            return pa.RecordBatch.from_arrays([pa.array([r[3] for r in mine], pa.int64()), pa.array([r[4] for r in mine], pa.int64()), pa.array(start.astype(np.int32)), pa.array((start + place[ends] - place[begins] + length).astype(np.int32))], names=["id", "text_hash", "start", "stop"])

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if size > BLOCK_BYTES and row[:2] != rows[-1][:2]:
                    yield flush()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[7])
        if rows:
            yield flush()

    return compare


def _fingerprints(length: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, copies, i, t, start, n, body in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                data, _, at = strings_of([body], np.array([n]))
                key = Sums(data)(at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array([head] * n, pa.int64()), pa.array(key.view(np.int64)), pa.array([copies] * n, pa.int64()), pa.array([i] * n, pa.int64()), pa.array([t] * n, pa.int64()), pa.array((start + np.arange(n)).astype(np.int32))], names=["head", "key", "copies", "id", "text_hash", "start"])

    return explode


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    removed = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        kept, spans = [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = merged([(s["start"], s["stop"]) for s in found or ()])
            cuts = [0, *(x for s in own for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            spans.append([{"start": a, "stop": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()), pa.array(spans, removed), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])


def _joined(rows: DataFrame, keys: DataFrame, on: list[str], hot: int) -> DataFrame:
    """rows joined to keys, which have the number of their rows as copies. Keys of more than hot rows never deal rows out: they are few, and go to every task."""
    many = F.broadcast(keys.where(F.col("copies") > hot))
    return rows.join(many, on).unionByName(rows.join(many, on, "left_anti").join(keys.where(F.col("copies") <= hot), on))


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, run: int = RUN) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, removed (maximal stretches [start, stop) of bytes) and kept (the other bytes).

    A byte goes if a string of length bytes that covers it starts anywhere else too, in another row or in the same.
    Texts are UTF-8 bytes; strings never cross rows, overlaps count, and all are judged on the input. length is 64 or
    more; id_col is an integer column.

    Defined cases: a null text is empty; texts shorter than length lose nothing, and a text of any length is read whole;
    a row that repeats is another place, so both lose all; rows are told apart by id and text, so null and repeated ids
    are returned as they are; an empty table gives an empty table; other columns are not
    returned, whatever their names.
    """
    if length < 2 * GRAM:
        raise ValueError("length must be 64 or more")
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"))
    suffixes = settle(own.where(F.octet_length("body") >= length).mapInArrow(_sampler(length), "id long, text_hash long, head long, around long, at int, start int, n int"))
    shared = settle(suffixes.groupBy("head").agg(F.count("*").alias("copies"), F.min("around").alias("a"), F.max("around").alias("b")).where("copies > 1").select("head", "copies", (F.col("a") != F.col("b")).alias("mixed")))
    hot = max(HOT, suffixes.count() // HOT_SHARE)
    near = settle(_joined(suffixes, shared, ["head"], hot).drop("copies"))
    stop = (F.col("start") + F.col("n") + F.lit(length - 1)).alias("stop")
    marks = near.where("not mixed").select("id", "text_hash", "start", stop)

    mixed = near.where("mixed").drop("mixed")
    classes = settle(mixed.groupBy("head", "around").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_hash", "at", "start", "n")).alias("one")))
    marks = marks.unionByName(_joined(mixed, classes.where("copies > 1").select("head", "around", "copies"), ["head", "around"], hot).select("id", "text_hash", "start", stop))
    crowds = settle(classes.groupBy("head").agg((F.count("*") > run).alias("crowded")))
    wanted = classes.join(crowds, "head").groupBy("one.id", "one.text_hash").agg(F.collect_list(F.struct("head", "copies", "crowded", "one.at", "one.start", "one.n")).alias("suffixes"))
    cut = settle(own.join(wanted, ["id", "text_hash"]).select("id", "text_hash", "body", "suffixes").mapInArrow(_cutter(length), "lead binary, head long, copies long, crowded boolean, id long, text_hash long, start int, n int, body binary"))
    few = cut.where("not crowded").select("lead", "head", "copies", "id", "text_hash", "start", "n", "body")
    total, crowded = cut.agg(F.sum(F.octet_length("body")), F.count_if("crowded")).first()
    ranges = max(8, math.ceil((total or 0) / RANGE_BYTES))
    marks = marks.unionByName(few.repartitionByRange(ranges, "lead", "head").sortWithinPartitions("lead", "head").mapInArrow(_comparer(length), "id long, text_hash long, start int, stop int"))
    if crowded:
        strings = settle(cut.where("crowded").select("head", "copies", "id", "text_hash", "start", "n", "body").mapInArrow(_fingerprints(length), "head long, key long, copies long, id long, text_hash long, start int"))
        again = settle(strings.groupBy("head", "key").agg(F.count("*").alias("places")).where("places > 1").select("head", "key"))
        marks = marks.unionByName(strings.where("copies = 1").join(again, ["head", "key"]).select("id", "text_hash", "start", (F.col("start") + length).alias("stop")))

    marks = settle(marks.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    out = own.join(marks, ["id", "text_hash"], "left").select("id", "body", "spans").mapInArrow(_remover, "id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary")
    return out.select(F.when(F.col("id") != LAST_ID, F.col("id")).alias(id_col), "n_bytes", "removed", "kept")


def op6_suffix_array_dedup(spark, sf_dir):
    out = drop_repeated_strings(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    # the last two say what is left, in bytes and in characters: all bytes but those that continue one
    n_chars = F.char_length(F.regexp_replace(F.decode("kept", "iso-8859-1"), r"[\x80-\xBF]", ""))
    return out.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"), n_chars.cast("long").alias("n_chars_kept"),
    )

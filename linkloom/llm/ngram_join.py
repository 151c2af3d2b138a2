"""N-gram Jaccard join by parity sketches.

Equal shingle sets are one class from the start. A class's shingles are hashed into the parts of a sketch, and each
part holds the XOR of its shingles' hashes, so the number of parts in which two sketches differ is at most the size
of the symmetric difference. Within a band of sizes a pair at the threshold differs in d parts at most, so of any d + k
parts, taken in one order that holds for all sets, k must agree in both (pigeonhole). A set whose parts agree with
others' in fewer has no partner; parts that agree bring the others together, and shingles of the texts themselves
decide; no link is missed, whatever the sizes.

The order puts rare parts first, so a passage that many documents share is sent only by those that hold little else:
the first pass over the texts counts the shingles that a task meets often, and a table of fixed size tells how common
a shingle about is.

In a run of classes with an equal part, each is compared with the first only. Runs that then still hold several
components have the other pairs across components compared too, by bit sketches before texts, block against block; so
a large group of near copies takes one comparison for each member, not for each pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from linkloom.llm.components import connected_components
from linkloom.llm.tables import LAST_ID, forget, settle, table, unused

SHINGLE, PERCENT = 5, 75
#: Sets of groups up to this size are their own parts.
TOKEN_GROUP = 16
ENTRIES_PER_BUCKET = 1_000_000
#: Bytes of a part that are shuffled.
PART_BYTES = 6
#: Shingles that a task meets in so many texts are counted; how common a shingle is, is told by so many cells.
OFTEN, CELL_BITS = 3, 22
#: Members of a run are compared in blocks of about this size.
RUN_BLOCK = 1500
#: Rows of 24 bytes, pairs or nodes, that every task may hold.
BROADCAST_PAIRS = 2_000_000
MEMORY_KEYS, MEMORY_SHINGLES = 500_000, 2_000_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Texts are hashed in pieces of about so many bytes; longer words are hashed one by one.
PIECE_BYTES, WORD_BYTES = 1 << 18, 64
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: What each byte counts: A-Z as much as a-z, and blanks, which part words, nothing.
WEIGHTS = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS[65:91] = WEIGHTS[97:123]
WEIGHTS[[9, 10, 11, 12, 13, 32]] = 0
UP, DOWN = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * PIECE_BYTES, b, np.uint64)])) for b in (int(BASE), pow(int(BASE), -1, 1 << 64)))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def begins(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _codes(data: bytes) -> np.ndarray:
    weight = WEIGHTS[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(weight, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(weight * UP[: len(data)], out=total[1:])
    codes = mix((total[end] - total[start]) * DOWN[start])
    for k in np.flatnonzero(end - start > WORD_BYTES).tolist():
        codes[k] = xxh3_64_intdigest(data[start[k] : end[k]].lower())
    return codes


def word_codes(data: bytes) -> np.ndarray:
    """Hashes of the words of some UTF-8 bytes, in order: those of a piece all at once, by sums of what their bytes count."""
    pieces, at = [], 0
    while len(data) - at > PIECE_BYTES:
        found = BLANK.search(data, at + PIECE_BYTES)
        end = found.start() if found else len(data)
        if end - at > 2 * PIECE_BYTES:  # its last word is longer than a piece
            *short, long = data[at:end].split()
            pieces += [*map(_codes, short), np.array([xxh3_64_intdigest(long.lower())], np.uint64)]
        else:
            pieces.append(_codes(data[at:end]))
        at = end
    return np.concatenate([*pieces, _codes(data[at:])])


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; with fewer words, of the whole sequence."""
    codes = word_codes(text.encode()) if text else np.empty(0, np.uint64)
    if not len(codes):
        return codes
    n = min(size, len(codes))
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for j in range(n):
        h *= BASE
        h += codes[j : len(codes) - n + 1 + j]
    h = np.sort(mix(h))
    return h[begins(h)]


def edges(up_to: int) -> np.ndarray:
    """Lower ends of the bands of sizes: each about 16 / 9 times the one before."""
    out = [1]
    while out[-1] <= up_to:
        out.append(max(out[-1] + 1, out[-1] * 16 // 9))
    return np.array(out)


EDGES = edges(1 << 31)


def largest(group: int) -> int:
    """The largest set that a group, the band of that number and what it can be linked to above, takes."""
    return 4 * (int(EDGES[group + 1]) - 1) // 3


def groups_of(n: int) -> list[tuple[int, int]]:
    """Groups of a set of n shingles, each with the most by which it and a partner there can differ."""
    own = int(np.searchsorted(EDGES, n, "right")) - 1
    out = [(own, (n + 4 * n // 3) // 7)]
    if own and n <= largest(own - 1):
        out.append((own - 1, 2 * n // 7))
    return out


def spare(differ: int) -> int:
    """How many parts are sent beyond those that may differ; a pair shares as many as the smaller of its two numbers."""
    return max(1, differ // 4)


def least_shared(n):
    """The fewest parts that a set of n shingles shares with a linked one, of 3/4 n shingles or more: below spare() of its partner's least d, 2/7 of its size."""
    return F.greatest(F.lit(1), F.floor(n / 20))


def parts_of(tokens: np.ndarray, group: int, differ: int, levels: np.ndarray) -> np.ndarray:
    """What a sorted set sends to a group: the first parts in the order that all sets share, the group in the last 6 bits of each."""
    # with eight parts a shingle nearly all hold one shingle alone, so a set never has too few parts
    sends = differ + spare(differ)
    top, level = largest(group), levels[tokens >> np.uint64(64 - CELL_BITS)]
    if top <= TOKEN_GROUP:
        sent = tokens[np.lexsort((tokens, level))[:sends]]
    else:
        part = ((tokens >> np.uint64(32)) * np.array([8 * top], np.uint64)) >> np.uint64(32)
        starts = np.flatnonzero(begins(part))
        sent = mix(np.bitwise_xor.reduceat(tokens, starts) + part[starts] * BASE)
        # rare ones first, then those with most shingles: the rank, 0 to 243, in the first 8 bits, and 56 bits of the part
        rank = np.minimum.reduceat(level, starts).astype(np.uint64) * np.uint64(4) + np.uint64(4) - np.minimum(np.append(starts[1:], len(part)) - starts, 4).astype(np.uint64)
        sent = np.sort(rank << np.uint64(56) | sent >> np.uint64(8))[:sends] & np.uint64((1 << 56) - 1)
    sent = mix(sent + np.array([group], np.uint64) * BASE)
    return (sent & ~np.uint64(63)) | np.array([group], np.uint64)


def cut(parts: np.ndarray) -> bytes:
    """The last PART_BYTES bytes of each part: within a bucket the first ones tell little. Parts that are equal only there bring classes together that texts part again."""
    return parts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PART_BYTES].tobytes()


def uncut(parts: bytes) -> np.ndarray:
    short = np.frombuffer(parts, np.uint8).reshape(-1, PART_BYTES)
    return np.pad(short, ((0, 0), (0, 8 - PART_BYTES))).view("<u8").ravel()


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def bits_of(tokens: np.ndarray, group: int) -> np.ndarray:
    """Parity of the shingles that fall on each of about four bits a shingle."""
    words = -(-4 * largest(group) // 64)
    at = (tokens & np.uint64(0xFFFFFFFF)) * np.uint64(64 * words) >> np.uint64(32)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and key of each text's set; and, as rows with a negative n_shingles, the shingles (k1) that the task meets often."""
    names = ["id", "text_hash", "n_shingles", "k1", "k2"]
    held, size = [], 0

    def often() -> pa.RecordBatch:
        token = np.concatenate([*held, np.empty(0, np.uint64)])
        held.clear()
        token.sort()
        starts = np.flatnonzero(begins(token))
        n = np.append(starts[1:], len(token)) - starts
        token, n = token[starts[n >= OFTEN]], n[n >= OFTEN]
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(-n), pa.array(token.view(np.int64)), none], names=names)

    for batch in batches:
        rows = []
        for text in batch.column(2):
            tokens = shingles(text.as_py())
            rows.append((len(tokens), *set_key(tokens)))
            held.append(tokens)
            size += len(tokens)
            if size > MEMORY_SHINGLES:
                yield often()
                size = 0
        n, k1, k2 = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=names)
    yield often()


def _levels(often: DataFrame) -> np.ndarray:
    """How common the shingles of each cell are at most, as a power of two; 2**CELL_BITS bytes, however many shingles there are."""
    cell = F.shiftrightunsigned("k1", 64 - CELL_BITS)
    total = often.groupBy("k1").agg(F.sum(-F.col("n_shingles")).alias("n")).groupBy(cell.cast("int").alias("cell")).agg(F.floor(F.log2(F.max("n"))).cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[total.column("cell").to_numpy()] = np.minimum(total.column("level").to_numpy(), 60)
    return levels


def _sender(buckets: int, levels):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts and their classes, packed by bucket."""

        def packed() -> pa.RecordBatch:
            s, owner = np.concatenate(sent), np.repeat(np.arange(len(keys), dtype=np.int32), counts)
            sent.clear()
            bucket = ((s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, s = bucket[order], s[order]
            k = np.array(keys, np.int64)[owner[order]]
            starts = np.flatnonzero(begins(bucket))
            ends = np.append(starts[1:], len(s))
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array([cut(s[a:b]) for a, b in zip(starts, ends, strict=True)]), pa.array([k[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])], names=["bucket", "parts", "classes"])

        sent, keys, counts, held = [], [], [], 0
        seen: set[tuple[int, int]] = set()  # copies that a task meets send once
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py())
                key, other = set_key(tokens)
                if not len(tokens) or (key, other) in seen:
                    continue
                if len(seen) > MEMORY_KEYS:
                    seen.clear()
                seen.add((key, other))
                for group, differ in groups_of(len(tokens)):
                    p = parts_of(tokens, group, differ, levels.value)
                    sent.append(p)
                    keys.append(key)
                    counts.append(len(p))
                    held += len(p)
                if held > 2_000_000:
                    yield packed()
                    keys, counts, held = [], [], 0
        if held:
            yield packed()

    return send


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the different sets of classes that share parts: part (the set's own hash), members, and how many parts. Rows come sorted by bucket."""

    def shared(pieces: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = np.concatenate([uncut(p) for p, _ in pieces])
        classes = np.concatenate([np.frombuffer(c, np.int64) for _, c in pieces])
        order = np.lexsort((classes, parts))
        parts, classes = parts[order], classes[order]
        first = np.r_[True, (parts[1:] != parts[:-1]) | (classes[1:] != classes[:-1])]  # copies send the same
        parts, classes = parts[first], classes[first]
        starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
        size = np.diff(np.r_[starts, len(parts)])
        # a run is told by its members, so two classes that share many parts are one run
        run = np.add.reduceat(mix(classes.view(np.uint64) + BASE), starts) * MIX + (parts[starts] & np.uint64(63))
        _, one, times = np.unique(run, return_index=True, return_counts=True)
        keep, n_parts = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
        keep[one[size[one] > 1]] = True
        n_parts[one] = times
        member = np.repeat(keep, size)
        run, group, classes, n_parts = np.repeat(run[keep], size[keep]), np.repeat(parts[starts] & np.uint64(63), size)[member], classes[member], np.repeat(n_parts[keep], size[keep])
        for at in range(0, len(run), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(run[part].view(np.int64)), pa.array(classes[part]), pa.array(group[part].astype(np.int32)), pa.array(n_parts[part])], names=["part", "class", "grp", "n_parts"])

    held, last = [], None
    for batch in batches:
        for bucket, p, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held and bucket != last:
                yield from shared(held)
                held = []
            held.append((p, c))
            last = bucket
    if held:
        yield from shared(held)


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose texts are linked; rows come with one side's text repeated, so the last sets are kept."""
        kept: dict[int, np.ndarray] = {}

        def tokens(i: int, text: str) -> np.ndarray:
            if i not in kept:
                if len(kept) > 200:
                    kept.clear()
                kept[i] = shingles(text)
            return kept[i]

        for batch in batches:
            a, b, s, t = (batch.column(k).to_pylist() for k in range(4))
            good = [linked(tokens(i, x), tokens(j, y), percent) for i, j, x, y in zip(a, b, s, t, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. Up to BROADCAST_PAIRS they go to the texts; beyond, both are dealt out by node."""
    near = F.broadcast(pairs) if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else pairs
    of = lambda c: texts.join(near, F.col("node") == F.col(c)).select("a", "b", F.col("text").alias(f"text_{c}"))
    return of("a").join(of("b"), ["a", "b"]).select("a", "b", "text_a", "text_b").mapInArrow(_verifier(percent), "a long, b long")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit sketches of texts (node, text): one for each group of the text's size."""
    for batch in batches:
        rows = []
        for node, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            tokens = shingles(text)
            rows += [(node, group, len(tokens), bits_of(tokens, group).tobytes()) for group, _ in groups_of(len(tokens))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["node", "grp", "n", "bits"])


def _near_enough(percent: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sketches differ in no more bits than linked sets of their sizes can."""
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b"))
            good = [
                min(m, n) * 100 >= percent * max(m, n) and int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()) * (100 + percent) <= (m + n) * (100 - percent)
                for m, x, n, y in zip(*columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return near


def _across(percent: int):
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of two blocks of a run, across components, whose bit sketches are near enough; rows come sorted by run and blocks."""

        def pairs(rows: list[tuple]) -> pa.RecordBatch:
            node, comp, n, block = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 7))
            bits = np.stack([np.frombuffer(r[6], np.uint64) for r in rows])
            within = rows[0][1] == rows[0][2]
            a, b = [], []
            for k in range(len(rows) - 1):
                m, other = n[k + 1 :], comp[k + 1 :] != comp[k]
                if not within:
                    other &= block[k + 1 :] != block[k]
                other &= np.minimum(m, n[k]) * 100 >= percent * np.maximum(m, n[k])
                near = np.flatnonzero(other) + k + 1
                differ = np.bitwise_count(bits[k] ^ bits[near]).sum(axis=1)
                near = near[differ * (100 + percent) <= (n[near] + n[k]) * (100 - percent)]
                a += [min(node[k], x) for x in node[near].tolist()]
                b += [max(node[k], x) for x in node[near].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    yield pairs(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield pairs(rows)

    return across


def _block_pairs(members: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """Members of runs (part, n_members), dealt into blocks of about size; each row once for each pair of blocks (i, j) that its own is in."""
    sizes = runs.select("part", F.ceil(F.col("n_members") / size).cast("int").alias("blocks"))
    own = members.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def _joined(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """id (LAST_ID for null), text_hash, n_shingles, class_id, component_id and first (the component's smallest (id, text_hash)) of each row."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    every = settle(own.mapInArrow(_classes, "id long, text_hash long, n_shingles long, k1 long, k2 long"))
    rows, real = every.where("n_shingles >= 0"), every.where("n_shingles > 0")
    # a class is a node of its own, whatever the ids of its rows
    classes = real.groupBy("k1", "k2").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("n_shingles").alias("n"))
    # nodes are numbered in the order of ids, as the first of a group of near copies often is what the others came from
    classes = settle(classes.orderBy("first").withColumn("node", F.monotonically_increasing_id()))

    total = classes.agg(F.sum(F.col("n") * 0.75 + 2)).first()[0] or 1
    buckets = max(8, math.ceil(total / ENTRIES_PER_BUCKET))
    levels = docs.sparkSession.sparkContext.broadcast(_levels(every.where("n_shingles < 0")))
    sent = own.select("text").where("text is not null").mapInArrow(_sender(buckets, levels), "bucket long, parts binary, classes binary")
    shared = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_runs, "part long, class long, grp int, n_parts long")
    shared = settle(shared.groupBy("part", "class", "grp").agg(F.sum("n_parts").alias("n_parts")).join(classes.select(F.col("k1").alias("class"), "node", "n"), "class").drop("class"))
    several = shared.groupBy("node", "grp").agg(F.sum("n_parts").alias("n_parts"), F.first("n").alias("n")).where(F.col("n_parts") >= least_shared(F.col("n"))).select("node", "grp")
    members = settle(shared.join(several, ["node", "grp"]).select("part", "grp", "node"))
    forget(shared)
    alive = settle(members.select("node").distinct().join(classes, "node").select("node", "first.id", "first.text_hash"))
    alive = F.broadcast(alive) if alive.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else alive
    found = alive.join(own, ["id", "text_hash"])
    # texts are dealt out again only where rows repeat, id and text
    repeats = rows.groupBy("id", "text_hash").count().where("count > 1").limit(1).count()
    texts = settle((found.dropDuplicates(["id", "text_hash"]) if repeats else found).select("node", "text"))

    sketches = settle(texts.mapInArrow(_sketches, "node long, grp int, n long, bits binary"))
    leaders = members.groupBy("part").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
    tried = settle(members.join(leaders, "part").where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.min("grp").alias("grp")))
    of = lambda c: sketches.select(F.col("node").alias(c), "grp", F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    near = tried.join(of("b"), ["b", "grp"]).join(of("a"), ["a", "grp"]).select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    links = settle(_verified(settle(near.mapInArrow(_near_enough(percent), "a long, b long")), texts, percent))
    found = connected_components(links)

    # runs that still hold several components
    placed = members.join(found, "node", "left").select("part", "grp", "node", F.coalesce("component", "node").alias("component"))
    # in a run of two their only pair has been tried
    open_runs = placed.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_members")).where("low < high and n_members > 2").select("part", "n_members")
    open_runs = settle(open_runs)
    # blocks are dealt out by number alone; sketches come to them last
    units = _block_pairs(placed, open_runs, RUN_BLOCK).join(sketches, ["node", "grp"]).select("part", "i", "j", "node", "component", "n", "bits", "block")
    units = units.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node")
    more = units.mapInArrow(_across(percent), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    more = settle(_verified(settle(more), texts, percent))
    if more.limit(1).count():
        found = connected_components(links.unionByName(more))

    # an id is looked up at the end only: the smallest of each class, and of each component
    named = classes.join(found, "node", "left").select("k1", "k2", "first", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("low"))
    named = named.join(lowest, "component").select("k1", "k2", F.col("first.id").alias("class_id"), F.col("low.id").alias("component_id"), F.col("low").alias("lowest"))
    out = rows.join(named, ["k1", "k2"], "left")
    return out.select("id", "text_hash", "n_shingles", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("lowest", F.struct("id", "text_hash")).alias("first"))


def join_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, and class_id, the smallest id with the same shingles.

    A-Z are lower-cased; words are runs of anything but [\\x20\\x09-\\x0D]. A text's set holds its distinct runs of 5
    words; with fewer words, the whole sequence. Two rows are linked when 100 * intersection >= percent * union of
    their sets (percent is 75 or more); component_id is the smallest id that links reach. id_col is an integer column.

    Defined cases: a null text, or one without words, has an empty set and is linked with nothing, its component_id
    being its own id; a text of any length is read whole; rows are linked by their texts alone, so rows whose ids are
    null or repeat are linked only as their own texts are; a null id is never the smallest (if there is no other, class
    and component are null); rows that repeat are linked copies; an empty table gives an empty table; other columns
    are not returned, whatever their names.
    """
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return _joined(docs, id_col, text_col, percent).select(known("id").alias(id_col), "n_shingles", known("component_id").alias("component_id"), known("class_id").alias("class_id"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest id (of null or equal ids, with the smallest hash of its text).

    Rows without words are linked with nothing, so they all stay; of rows that repeat one stays. The same columns, and
    the same defined cases, as in join_near_duplicates().
    """
    i, h, n = (unused(c, docs) for c in ("row_id", "row_hash", "row_times"))
    found = settle(_joined(docs, id_col, text_col, percent).where("n_shingles > 0").groupBy("id", "text_hash").agg(F.count("*").alias("times"), F.first("first").alias("first")))
    goes = (F.col("first.id") != F.col("id")) | (F.col("first.text_hash") != F.col("text_hash"))
    # few rows go or repeat beside those that stay, so only their keys are joined
    marked = found.where(goes | (F.col("times") > 1)).select(F.col("id").alias(i), F.col("text_hash").alias(h), F.when(goes, 0).otherwise(F.col("times")).alias(n))
    keyed = docs.withColumns({i: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)), h: F.xxhash64(f"`{text_col}`")}).join(marked, [i, h], "left")
    once = keyed.where(F.col(n) > 1).dropDuplicates([i, h])
    return keyed.where(F.col(n).isNull()).unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_ngram_jaccard_join(spark, sf_dir):
    return join_near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")

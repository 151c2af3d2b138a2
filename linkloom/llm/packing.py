"""Best-fit packing of tokenised documents into sequences of a fixed length.

Every document is tokenised inside the scan; only (id, piece, start, length, checksum) rows are shuffled. Pieces are
dealt into groups of a fixed mean size by a hash of their row number, so no group grows with the input, and each group
is packed on its own by large-item matching: pieces above a third of the capacity are matched in pairs, two to a
sequence at most, the largest first, each with the largest partner that fits; smaller pieces then go, largest first,
into the tightest gap that holds them. Sequences that a group leaves with a gap are taken apart and their pieces packed
again with those of other groups, in rounds, until they are one group or a round saves nothing.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.tables import settle, table

CAPACITY, END_ID, GROUP_PIECES = 4096, 1, 2000
#: Sequences with a larger gap than this share of the capacity are packed again, in so many rounds at most.
GAP, ROUNDS = 0.002, 8
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text whose chunks are told apart at once; the more, the fewer are met again.
PORTION_BYTES = 4_000_000
#: Words, and other units, that a worker remembers, and as many again that are new in one portion of texts.
MEMORY_WORDS, MEMORY_OTHERS = 100_000, 20_000

#: Letters whose only clean-up is lower case, and the ASCII marks that may follow them as one token of the first split.
LETTERS = "".join(c for c in map(chr, [*range(0x80), *range(0xC0, 0x100)]) if c.isalpha())
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_loaded: dict[str, WordCoder] = {}


class Recent:
    """Ids of units as bytes. The units met last are kept, limit of them and those of the last call."""

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        self.encode, self.limit = encode, limit
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.now) + len(self.before)

    def __call__(self, units: list[str]) -> list[bytes]:
        if 2 * len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        now, before, out = self.now, self.before, []
        for unit in units:
            ids = now.get(unit)
            if ids is None:
                ids = before.pop(unit, None)
                now[unit] = ids = self.encode(unit) if ids is None else ids
            out.append(ids)
        return out


def gathered(data: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked ones of runs that lie end to end in data, end to end again, and their lengths."""
    n = lengths[picks]
    shift = (np.cumsum(lengths) - lengths)[picks] - (np.cumsum(n) - n)
    return data[np.arange(n.sum()) + np.repeat(shift, n)], n


def strings(column: pa.Array) -> list[str]:
    """to_pylist of a column without nulls, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordCoder:
    """Encodes texts chunk by chunk between ASCII blanks, which this tokenizer never joins, each distinct chunk of a call once.

    Chunks of plain Latin letters before ASCII marks, where the tokenizer's clean-up can only lower the case, are two
    units: the word, which is handed to the tokenizer's model, and the marks. All others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.known = Recent(self._word, MEMORY_WORDS), Recent(self._whole, MEMORY_OTHERS)
        # one character for each byte, as the byte-level step writes them
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {}
        for letter in map(chr, range(0xC0, 0x100)):
            self.shown |= dict(zip(letter.encode(), level.pre_tokenize_str(letter)[0][0], strict=True))

    def _whole(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        lists = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        chunks = lists.flatten().dictionary_encode()
        distinct = chunks.dictionary
        letters = pc.utf8_rtrim(distinct, MARKS)
        plain = pc.equal(pc.binary_length(pc.utf8_trim(letters, LETTERS)), 0)
        # of plain chunks, all but the letters is marks; the others are one unit, the empty one stands where a word would
        words = pc.if_else(plain, pc.utf8_lower(letters), "").dictionary_encode()
        rest = pc.if_else(plain, pc.utf8_ltrim(distinct, LETTERS), distinct).dictionary_encode()
        ids = [*self.words(strings(words.dictionary)), *self.known(strings(rest.dictionary))]
        units = np.stack([words.indices.to_numpy(), rest.indices.to_numpy() + len(words.dictionary)], 1).ravel()
        data, n = gathered(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64), units)
        data, n = gathered(data, n.reshape(-1, 2).sum(1), chunks.indices.to_numpy())
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]] * 4
        out = data.tobytes()
        return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def coder(path: str) -> WordCoder:
    if path not in _loaded:
        _loaded[path] = WordCoder(path)
    return _loaded[path]


def portions(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so much size each; a larger row is a range of its own."""
    start = size = 0
    for k, n in enumerate(sizes):
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def match_and_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each length, and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    large = [int(k) for k in order if 3 * lengths[k] > capacity]
    small = order[len(large) :]

    def put(k: int, b: int) -> None:
        bins[k], offsets[k] = b, used[b]
        used[b] += int(lengths[k])

    left = large[::-1]  # ascending
    sizes = [int(lengths[k]) for k in left]
    while left:
        k = left.pop()
        sizes.pop()
        used.append(0)
        put(k, len(used) - 1)
        at = bisect_left(sizes, capacity - int(lengths[k]) + 1) - 1
        if at >= 0:
            put(left.pop(at), len(used) - 1)
            sizes.pop(at)
    gaps = sorted((capacity - u, b) for b, u in enumerate(used) if u < capacity)
    for k in map(int, small):
        at = bisect_left(gaps, (int(lengths[k]), -1))
        if at < len(gaps):
            _, b = gaps.pop(at)
        else:
            used.append(0)
            b = len(used) - 1
        put(k, b)
        if used[b] < capacity:
            insort(gaps, (capacity - used[b], b))
    return bins, offsets, len(used)


def tokenise(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type)] + [T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))])
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer).encode
        for batch in batches:
            texts = batch.column(1)
            rows, piece, start, length, crc = [], [], [], [], []
            for lo, hi in portions(pc.binary_length(texts).to_pylist(), PORTION_BYTES):
                for row, ids in enumerate(encode(texts[lo:hi]), lo):
                    ids += end
                    n = len(ids) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        part = ids[4 * s : 4 * (s + capacity)]
                        rows.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=schema.fieldNames(),
            )

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece of a document: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its ids without special ones, then end_id. Only documents longer than capacity are cut,
    into pieces of capacity tokens and a last one that may be shorter. A sequence holds at most capacity tokens,
    without gaps. tokenizer is the name of a public vocabulary file, or an absolute path that every executor has.

    Defined cases: a null or empty text is end_id alone; ids may be null or repeat, each row being a document of its
    own; equal lengths are packed in the order of id and piece; an empty table gives an empty table; other columns are
    not returned, whatever their names.
    """
    pieces = settle(tokenise(docs, id_col, text_col, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "used"))])

    def packer(round_: int, groups: int):
        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["id", "piece", "row"], kind="stable", ignore_index=True)
            bins, offsets, n = match_and_fit(rows["length"].to_numpy(), capacity)
            used = np.bincount(bins, rows["length"].to_numpy(), n).astype(np.int64)
            # group g owns the numbers g, g + groups, g + 2 * groups, ..., and each round those of its remainder
            return rows.assign(sequence_id=(bins * groups + key[0]) * ROUNDS + round_, offset=offsets, used=used[bins])[schema.fieldNames()]

        return pack

    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("used"))
    done, rest, before = [whole], pieces.where(F.col("length") < capacity), None
    for round_ in range(ROUNDS):
        n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, -(-n // group_pieces))
        if before is not None and before <= -(-tokens // capacity):  # as few as can be
            break
        packed = settle(rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(groups))).groupBy("group").applyInPandas(packer(round_, groups), schema))
        full = F.col("used") > capacity * (1 - GAP)
        gaps, after = packed.where(~full & (F.col("offset") == 0)).count(), packed.where("offset = 0").count()
        if before is not None and after >= before:  # the round before did as well
            break
        if done[1:]:
            done[-1] = done[-1].where(F.col("used") > capacity * (1 - GAP))
        done.append(packed)
        if groups == 1:
            break
        rest, before = packed.where(~full).select(*pieces.columns), gaps
    return reduce(DataFrame.unionByName, done).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))

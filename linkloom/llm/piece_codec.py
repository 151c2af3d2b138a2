"""SentencePiece encoding that keeps the source: every piece of a text with the bytes of the text that it stands for.

A text is normalised by longest prefixes through the model's compiled character map, and for each byte of the result the
place in the source is kept. The normalised text is cut where no piece of the vocabulary can span the cut, and the
library's own merge procedure encodes each chunk; chunks that come again are looked up. Pieces then lie end to end in
the normalised text, and the kept places project them to ranges of source bytes. All work is in the scan: no shuffle.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.packing import portions
from linkloom.llm.tables import table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Chunks that a worker remembers before it starts again.
MEMORY_CHUNKS = 400_000
#: Ids that one call of the library decodes, as far as there are places to cut at.
DECODE_IDS = 200_000

_loaded: dict[str, PieceCodec] = {}


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over the bytes of the source, whose values are places in a list of strings that end in a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, strings = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    below = (units >> 10) << ((units & 0x200) >> 6)
    bytes_ = np.arange(1, 256)
    rules, todo = {}, [(int(below[0]), b"")]
    while todo:
        at, key = todo.pop()
        near = at ^ bytes_
        near, label = near[near < len(units)], bytes_[near < len(units)]
        for place, byte in zip(near[(found := units[near] & 0x800000FF == label)].tolist(), label[found].tolist(), strict=True):
            child = place ^ int(below[place])
            if units[place] >> 8 & 1:
                begin = int(units[child]) & 0x7FFFFFFF
                rules[(key + bytes([byte])).decode()] = strings[begin : strings.index(b"\0", begin)].decode()
            todo.append((child, key + bytes([byte])))
    return rules


def char_class(chars: set[str]) -> str:
    return f"[{''.join(map(re.escape, sorted(chars)))}]" if chars else "(?!)"


class PieceCodec:
    """One model: normalisation with alignment, encoding by chunks, decoding."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        own = proto.ModelProto.FromString(model)
        self.whole = SentencePieceProcessor(model_proto=model)
        self.spec = spec = own.normalizer_spec
        self.as_suffix = own.trainer_spec.treat_whitespace_as_suffix
        self.rules = character_map(spec.precompiled_charsmap)
        kinds = proto.ModelProto.SentencePiece
        self.kept = {p.piece for p in own.pieces if p.type == kinds.USER_DEFINED}
        self.longest = max(map(len, self.rules), default=0)
        kept = "|".join(map(re.escape, sorted(self.kept, key=len, reverse=True))) or "(?!)"
        ones, longer = {k for k in self.rules if len(k) == 1}, [k for k in self.rules if len(k) > 1]
        self.turns = re.compile(f"({kept})|{char_class(ones)}|{char_class({k[0] for k in longer})}(?={char_class({k[1] for k in longer})})", re.DOTALL)

        # what is left of the model once a text is normalised
        core = proto.ModelProto.FromString(model)
        core.normalizer_spec.CopyFrom(proto.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.core = SentencePieceProcessor(model_proto=core.SerializeToString())
        self.unk = self.core.unk_id()
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in own.pieces], np.int32)
        cuttable = spec.escape_whitespaces and not any(re.search(f"[^{BLANK}]{BLANK}", p.piece) for p in own.pieces)
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if cuttable else ".+", re.DOTALL)
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, np.ndarray] = {}
        self.opens = np.array([p.type == kinds.NORMAL and p.piece.startswith(BLANK) for p in own.pieces])
        letters = [k for k, p in enumerate(own.pieces) if p.type == kinds.NORMAL and re.fullmatch("[a-z]", p.piece)]
        self.guard = letters[0] if letters and cuttable and not own.denormalizer_spec.precompiled_charsmap else None

    def mapped(self, text: str) -> tuple[str, np.ndarray]:
        """text through the character map, and the source byte at which each character of it begins, with the source's length at the end."""
        starts = np.arange(len(text) + 1)
        if not text.isascii():
            np.cumsum(utf8_sizes(text), out=starts[1:])
        if not self.rules and not self.kept:
            return text, starts
        out, places, done, at = [], [], 0, 0
        while m := self.turns.search(text, at):
            at = m.start()
            if m[1]:
                at = m.end()
                continue
            key = next((text[at : at + n] for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.rules), None)
            if key is None:
                at += 1
                continue
            out += text[done:at], self.rules[key]
            places += starts[done:at], np.full(len(self.rules[key]), starts[at])
            done = at = at + len(key)
        out.append(text[done:])
        places.append(starts[done:])
        return "".join(out), np.concatenate(places)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte at which the character it comes from begins."""
        mapped, places = self.mapped(text)
        if not mapped:
            return "", np.zeros(1, np.int64)
        if self.spec.remove_extra_whitespaces:
            blank = code_points(mapped) == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            kept = "".join(compress(mapped, keep.tolist()))
            mapped = kept.rstrip(" " + BLANK * self.spec.escape_whitespaces)
            places = places[np.append(np.flatnonzero(keep), len(keep))]
            places = places[: len(mapped) + 1]
            if not mapped:
                return "", np.zeros(1, np.int64)
        if self.spec.add_dummy_prefix:
            mapped = mapped + " " if self.as_suffix else " " + mapped
            places = np.append(places, places[-1]) if self.as_suffix else np.insert(places, 0, places[0])
        if self.spec.escape_whitespaces:
            mapped = mapped.replace(" ", BLANK)
        return mapped, np.append(np.repeat(places[:-1], utf8_sizes(mapped)), places[-1])

    def learn(self, chunks: set[str]) -> None:
        """Encode normalised chunks that are not known yet, in one call of the library."""
        new = list(chunks - self.known.keys())
        for chunk, ids in zip(new, self.core.encode(new, num_threads=1) if new else [], strict=True):
            self.known[chunk] = array("i", ids).tobytes()
            if self.unk in ids:
                shown = self.core.encode(chunk, out_type=str)
                self.odd[chunk] = np.array([len(s.encode()) if k == self.unk else self.lengths[k] for s, k in zip(shown, ids, strict=True)], np.int32)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ids, and the first and the past-the-end source byte of each. Of pieces that are single bytes of one character, the last has the range and the others are empty."""
        if len(self.known) >= MEMORY_CHUNKS:
            self.known, self.odd = {}, {}
        shown = list(map(self.normalise, texts))
        chunks = [self.chunks.findall(s) for s, _ in shown]
        self.learn(set().union(*chunks))
        out, get = [], self.known.__getitem__
        for (_, places), own in zip(shown, chunks, strict=True):
            ids = np.frombuffer(b"".join(map(get, own)), np.int32)
            lengths = self.lengths[ids]
            if self.odd and (ids == self.unk).any():
                lengths = np.concatenate([self.odd.get(c, self.lengths[np.frombuffer(get(c), np.int32)]) for c in own])
            ends = np.cumsum(lengths, dtype=np.int64)
            out.append((ids, places[ends - lengths].astype(np.int32), places[ends].astype(np.int32)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """What the library decodes ids to, in parts where they are many: a part begins at a piece with a blank before a word, and a letter in front of it keeps that blank."""
        if self.guard is None or len(ids) <= DECODE_IDS:
            return self.whole.decode(ids.tolist())
        cuts, at = [0], np.flatnonzero(self.opens[ids])
        while (k := np.searchsorted(at, cuts[-1] + DECODE_IDS)) < len(at):
            cuts.append(int(at[k]))
        parts = [self.whole.decode(ids[: cuts[1] if cuts[1:] else None].tolist())]
        parts += [self.whole.decode([self.guard, *ids[lo:hi].tolist()])[1:] for lo, hi in zip(cuts[1:], [*cuts[2:], None], strict=True)]
        return "".join(parts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def utf8_sizes(text: str) -> np.ndarray:
    first = np.frombuffer(text.encode(), np.uint8)
    sizes = np.flatnonzero((first & 0xC0) != 0x80)
    if len(sizes):
        sizes[:-1] = sizes[1:] - sizes[:-1]
        sizes[-1] = len(first) - sizes[-1]
    return sizes


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        name = path
        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        with open(name, "rb") as f:
            _loaded[path] = PieceCodec(f.read())
    return _loaded[path]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of docs: id_col, ids, begins, ends (source bytes of each piece, from 0) and decoded.

    ids are those of the library's encode without begin and end ids, decoded is its decode of them. model is the name of
    a public model file, or an absolute path that every executor has.

    Defined cases: a null or empty text has no ids and decodes to an empty text; characters that the vocabulary lacks
    are byte pieces, of which the last has the character's range, or the unknown piece in models without such; a text of
    any length is encoded whole, and decoded in parts at blanks before words; ids may be null or repeat, each row being
    encoded by itself, so there are no ties; an empty table gives an empty table; other columns are not returned,
    whatever their names.
    """
    lists = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, lists) for c in ("ids", "begins", "ends")), T.StructField("decoded", T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in portions([len(t) for t in texts]):
                found = own.encode(texts[lo:hi])
                bounds = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(f[0]) for f in found], out=bounds[1:])
                flat = (pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([f[k] for f in found]), pa.int32())) for k in range(3))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *flat, pa.array([own.decode(f[0]) for f in found], pa.string())], names=schema.fieldNames())

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(encode, schema)


def op12_piece_codec(spark, sf_dir):
    found = encode_pieces(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("source_bytes"))

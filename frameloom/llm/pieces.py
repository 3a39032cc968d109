"""SentencePiece models in the tokenizers library: encoding and decoding.

The model protobuf is parsed here (``parse``) and rebuilt as a tokenizer of the
tokenizers library: the normaliser (the precompiled character map and the rules on
white space), the metaspace marker, unigram scores or, for a BPE model, the merges
that its scores imply, and byte fallback.

Encoding visits each distinct fragment once per process.  A fragment is a run of
spaces with what follows up to the next space; that is exact for a model without a
character map whose pieces hold the marker only at their start (``by_fragment``);
other models are encoded text by text.  Fragments go to the library in batches,
which it encodes on several threads.  Parity: every distinct fragment is encoded by
SentencePiece as well; a fragment where the two differ takes its ids, and ``checked``
gives the number of such fragments of each text.

Decoding puts pieces' bytes together: marker to space, byte pieces to bytes, the
leading space that encoding added taken away; bytes that aren't UTF-8 become
U+FFFD.

Defined cases: a null or empty text has no ids and decodes to an empty text; a
literal marker in a text is a space; unknown ids decode to nothing; texts of any
length, repeated rows, null ids and other columns need nothing special; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import threading
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Texts, Words, hash_ranges, padded, steps, texts_of
from .wordcodec import IdCache

MARK = "▁"
THREADS = 2
BATCH = 4096

#: Fixed values of the public model format: kinds of model and of piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unk_id(self) -> int:
        return self.kinds.index(UNKNOWN)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protobuf message: number, and integer, bytes or four raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            raise ValueError("unknown wire type")


def parse(raw: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding needs."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append(piece.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            model.model_type, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.char_map = spec.get(2, b"")
            model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Merges that a BPE model's scores imply: best piece first, each from its every split in two pieces."""
    rank = {p: (-s, i) for i, (p, s, k) in enumerate(zip(model.pieces, model.scores, model.kinds, strict=True)) if k in (NORMAL, USER)}
    out = []
    for piece, at in rank.items():
        out += [(at, (piece[:k], piece[k:])) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
    out.sort(key=lambda x: (x[0], rank[x[1][0]], rank[x[1][1]]))
    return [pair for _, pair in out]


def tokenizer_of(model: Model, prefix: bool = True):
    """The tokenizers library's equivalent of a model."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    if model.model_type == BPE:
        vocab = {p: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocab=vocab, merges=merges_of(model), unk_token=model.pieces[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps_ = []
    if model.char_map:
        steps_.append(normalizers.Precompiled(model.char_map))
    if model.remove_extra_whitespaces:
        steps_ += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    if model.add_dummy_prefix and prefix:
        steps_.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps_.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps_)
    if all(MARK not in p.lstrip(MARK) for p in model.pieces):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    return out


def piece_bytes(model: Model) -> list[bytes]:
    out = []
    for p, k in zip(model.pieces, model.kinds, strict=True):
        out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
    return out


_LOCK = threading.Lock()
_CODECS: dict[str, "PieceCodec"] = {}


def codec(path: str) -> "PieceCodec":
    """This process's codec of a model file."""
    with _LOCK:
        if path not in _CODECS:
            _CODECS[path] = PieceCodec(path)
        return _CODECS[path]


class PieceCodec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.model = parse(raw)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.by_fragment = (
            not self.model.char_map and not self.model.remove_extra_whitespaces and self.model.add_dummy_prefix
            and self.model.escape_whitespaces and all(MARK not in p.lstrip(MARK) for p in self.model.pieces)
        )
        self.tokenizer = tokenizer_of(self.model, prefix=not self.by_fragment)
        self.cache = IdCache()
        self.differ = 0
        self.odd = np.zeros(0, np.uint64)
        parts = piece_bytes(self.model)
        self.piece_at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.piece_flat = np.frombuffer(b"".join(parts), np.uint8)

    def _both(self, texts: list[str], bare: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of the tokenizers library, but SentencePiece's where the two differ; and where they do."""
        found, odd = [], []
        for lo in range(0, len(texts), BATCH):
            ours = [x.ids for x in self.tokenizer.encode_batch_fast(texts[lo : lo + BATCH], add_special_tokens=False)]
            theirs = self.plain.encode(bare[lo : lo + BATCH], num_threads=1)
            other = [a != b for a, b in zip(ours, theirs, strict=True)]
            self.differ += sum(other)
            found += [b if o else a for a, b, o in zip(ours, theirs, other, strict=True)]
            odd += other
        return found, np.array(odd, dtype=bool)

    def _learn(self, words: Words, pick: np.ndarray, keys: np.ndarray) -> None:
        texts = [words.texts.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.start[pick].tolist(), words.end[pick].tolist(), strict=True)]
        found, odd = self._both(texts, [x[1:] for x in texts])
        # a lone space: SentencePiece gives no ids to an empty text, but a space inside one has its marker
        for k, x in enumerate(texts):
            if x == " ":
                found[k] = self.tokenizer.encode(x, add_special_tokens=False).ids
                odd[k] = False
        self.odd = np.union1d(self.odd, keys[odd])
        self.cache.add(keys, np.array([len(x) for x in found], dtype=np.int64), [np.array([i for x in found for i in x], dtype=np.uint32)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        return self.encode_both(column)[:2]

    def encode_both(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As encode, with the number of fragments of each text on which the two libraries differ."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.by_fragment:
            texts = column.to_pylist()
            found, odd = self._both(texts, texts)
            return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64), odd.astype(np.int64)
        column = pc.replace_substring(column, MARK, " ")
        has = pc.greater(pc.binary_length(column), 0)
        lead = pa.scalar(" ", pa.large_string())
        led = pc.if_else(has, pc.binary_join_element_wise(lead, column, pa.scalar("", pa.large_string())), column)
        parts = _fragments(texts_of(led))
        ids, counts = self.cache.ids_of(parts, self._learn)
        if not len(self.odd):
            return ids, counts, np.zeros(len(counts), np.int64)
        odd = np.isin(hash_ranges(parts.texts.buf, parts.start, parts.end), self.odd)
        return ids, counts, np.diff(np.concatenate([[0], np.cumsum(odd)])[parts.first])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Texts:
        """Bytes of the texts of these ids (UTF-8, but for byte pieces that aren't)."""
        ids = np.where(ids < len(self.piece_at) - 1, ids, 1).astype(np.int64)
        size = np.diff(self.piece_at)[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        flat = self.piece_flat[np.repeat(self.piece_at[ids] - to[:-1], size) + np.arange(int(to[-1]))]
        offsets = to[np.concatenate([[0], np.cumsum(counts)])]
        keep = np.ones(len(flat), dtype=bool)
        if self.model.add_dummy_prefix:
            head = offsets[:-1][np.diff(offsets) > 0]
            keep[head[flat[head] == 32]] = False
        return Texts(padded(flat[keep]), np.concatenate([[0], np.cumsum(keep)])[offsets])


def _fragments(texts: Texts) -> Words:
    buf = texts.buf[: texts.size]
    space = buf == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    firsts = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    opens[firsts] = True
    start = np.flatnonzero(opens)
    return Words(texts, start, np.append(start[1:], texts.size) if len(start) else start, np.searchsorted(start, texts.offsets))


ENCODED = "id long, n_tokens long, ids binary"
CHECKED = "id long, n_tokens long, ids_crc32 long, decoded_bytes long, round_trip boolean, n_differ long"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for step in steps(batch, "text"):
                ids, counts = own.encode(step.column("text"))
                raw, ends = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) * 4).tolist()
                blobs = [bytes(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([step.column("id"), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["id", "n_tokens", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for step in steps(batch, "ids"):
                raw = texts_of(step.column("ids"))
                texts = own.decode(raw.buf[: raw.size].view("<u4"), np.diff(raw.offsets) // 4)
                yield pa.RecordBatch.from_arrays([step.column("id"), pa.array([texts.raw(k).decode("utf-8", "replace") for k in range(len(texts))], pa.string())], ["id", "text"])

    return run


def _check(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for step in steps(batch, "text"):
                ids, counts, differ = own.encode_both(step.column("text"))
                raw, ends = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                back = own.decode(ids, counts)
                texts = texts_of(step.column("text"))
                same = [back.raw(k) == texts.raw(k) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([step.column("id"), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.diff(back.offsets), pa.int64()), pa.array(same, pa.bool_()), pa.array(differ, pa.int64())], ["id", "n_tokens", "ids_crc32", "decoded_bytes", "round_trip", "n_differ"])

    return run


def _slim(df: DataFrame, id_col: str, col: str, name: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{col}`").alias(name))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids (little-endian unsigned 32-bit) of every text."""
    return _slim(docs, id_col, text_col, "text").mapInArrow(_encode(path), ENCODED).withColumnRenamed("id", id_col)


def decoded(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, text of every row of ids."""
    return _slim(ids, id_col, ids_col, "ids").mapInArrow(_decode(path), "id long, text string").withColumnRenamed("id", id_col)


def checked(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_crc32, decoded_bytes, round_trip, n_differ (fragments on which the libraries differ): encodes, decodes and compares every text."""
    return _slim(docs, id_col, text_col, "text").mapInArrow(_check(path), CHECKED).withColumnRenamed("id", id_col)

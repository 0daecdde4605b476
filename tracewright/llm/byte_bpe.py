"""Byte-level BPE through a sentencepiece model that is serialised from a rank file's vocabulary.

Each byte is one character of a fixed 256-letter block, each rank's byte string a piece with score minus its rank, the
normaliser the identity. The library's merge order (highest score, then leftmost) is then that of the ranks. Texts are
parted by the pre-token pattern; each pre-token is encoded separately (a pre-token that is itself in the vocabulary is
that one id, as the rank file's own library has it). Decoding maps ids back to byte strings.

Nulls: a null text is empty; an empty text has no ids. Repeated rows and null ids keep their rows. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import whole_text
from .words49k import tokenizer_path

#: First of the 256 letters that stand for bytes; none of them is white space or changes under normalisation here.
FIRST_LETTER = 0x100
_MADE: dict[str, "ByteBpe"] = {}


def read_ranks(path: str) -> list[bytes]:
    """Byte string of each rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


def letters(piece: bytes) -> str:
    return "".join(chr(FIRST_LETTER + b) for b in piece)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the ranks; the id of a piece is its rank, the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [field(1, field(1, letters(p).encode()) + field(2, float(-k)) + field(3, normal)) for k, p in enumerate(ranks)]
    pieces.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, unknown)))
    absent = (1 << 64) - 1  # -1: no such id
    trainer = field(3, bpe) + field(4, len(pieces)) + field(40, len(ranks)) + field(41, absent) + field(42, absent) + field(43, absent)
    identity = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(pieces) + field(2, trainer) + field(3, identity)


class ByteBpe:
    """Encoder and decoder of one rank file, with a bounded cache of pre-tokens."""

    def __init__(self, path: str, most: int = 300_000):
        import public_tokenizers
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.rank = {p: k for k, p in enumerate(self.pieces)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.pieces))
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        self.letter = {b: chr(FIRST_LETTER + b) for b in range(256)}
        self.most, self.known = most, {}

    def encode(self, text: str) -> bytes:
        """ids as little-endian 32-bit bytes."""
        parts, known = self.parts(text), self.known
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(dict.fromkeys(parts))
        raw = [p.encode() for p in new]
        hard = []
        for p, b in zip(new, raw):
            if b in self.rank:
                known[p] = struct.pack("<I", self.rank[b])
            else:
                hard.append((p, b))
        if hard:
            for (p, _), ids in zip(hard, self.model.encode([b.decode("latin1").translate(self.letter) for _, b in hard], num_threads=1)):
                known[p] = np.array(ids, "<u4").tobytes()
        return b"".join([known[p] for p in parts])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def byte_bpe(path: str) -> ByteBpe:
    """One for each worker process and file."""
    if path not in _MADE:
        _MADE[path] = ByteBpe(path)
    return _MADE[path]


def encode_texts(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids): every whole text's ids as little-endian 32-bit bytes."""
    path = ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(t.as_py()) for t in b.column(1)], pa.binary())], names=["doc_id", "ids"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for."""
    path = ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = byte_bpe(path).decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([decode(x.as_buffer()) for x in b.column(1)], pa.binary())], names=["doc_id", "ids", "decoded"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

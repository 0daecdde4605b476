"""Payload columns in content-defined chunks: stored once by digest, rebuilt from ordered chunk lists, verified.

A text's payload is its UTF-8 bytes and zero bytes up to a positive multiple of 64. Rolling gear hashes cut it into
chunks. Its stored form is a chunk list (``CDC1``, the number of chunks, digest and size of each) and the chunks.
Digests are counted over the corpus; a chunk that occurs more than once is shared and kept once in a table of chunks,
any other stays in its document's row beside the list, so that most bytes never move. Which digests are shared is told
to the tasks by a Bloom filter of their number's size, ``MOST_BITS`` at most: a chunk taken for shared by mistake is
only kept in the other table, so that beyond the bound more bytes move but no result changes. Reading joins the chunk
lists with the shared chunks, rebuilds each distinct payload once, checks every chunk's digest and computes features of
the bytes. Payloads that very many rows have are joined by broadcast, of 1000 at most.

Nulls: a null text is empty and has 64 zero bytes. Repeated rows and null ids keep their rows; equal texts get equal
values. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import popular_join, stored, whole_text

UNIT, LEAST, MOST, CUT_BITS = 64, 512, 8192, 11
#: Bits of the filter for each shared digest, and at most and at least in all.
PER_KEY, MOST_BITS, LEAST_BITS = 16, 1 << 26, 1 << 16
MAGIC = b"CDC1"
#: The gear table by a rule: Weyl steps through a multiplicative mixer.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(29))) >> np.uint64(31)).astype(np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: after a position whose gear hash of the last 32 bytes begins with CUT_BITS zeros."""
    n, out, at = len(data), [], 0
    if n > LEAST:
        h = GEAR[np.frombuffer(data, np.uint8)]
        for k in (1, 2, 4, 8, 16):  # sums of the last 2k bytes' terms, each shifted by its age
            nxt = h.copy()
            nxt[k:] += h[:-k] << np.uint32(k)
            h = nxt
        where = np.nonzero(h >> np.uint32(32 - CUT_BITS) == 0)[0] + 1
        while n - at > LEAST:
            k = int(np.searchsorted(where, at + LEAST))
            end = min(int(where[k]) if k < len(where) else n, at + MOST, n)
            out.append(end)
            at = end
    if at < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the payload's chunks in order."""
    ends = cut_points(data)
    return [(digest(c := data[a:b]), c) for a, b in zip([0, *ends], ends)]


def in_filter(words: np.ndarray, key: bytes, salt: int = 0) -> bool:
    """Whether a Bloom filter may hold a digest with that salt."""
    at = (np.frombuffer(key, "<u4") + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) % np.uint32(len(words) * 64)
    return all(int(words[p >> 6]) >> (p & 63) & 1 for p in at.tolist())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def chunk_list(found: list[tuple[bytes, bytes]]) -> bytes:
    return MAGIC + struct.pack("<I", len(found)) + b"".join(d + struct.pack("<I", len(c)) for d, c in found)


def listed(record: bytes) -> list[tuple[bytes, int]]:
    """(digest, size) of a chunk list's chunks."""
    if record[: len(MAGIC)] != MAGIC or len(record) < 8 or len(record) != 8 + 20 * struct.unpack_from("<I", record, 4)[0]:
        raise ValueError("no chunk list")
    return list(struct.iter_unpack("<16sI", record[8:]))


def bloom(keys: DataFrame, most_bits: int) -> np.ndarray:
    """Bloom filter of (digest, salt), sized by their number; ``most_bits`` / 64 words reach the driver at most."""
    bits = min(most_bits, max(LEAST_BITS, 1 << (PER_KEY * keys.count()).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            salt = np.array([x * 0x9E3779B1 & 0xFFFFFFFF for x in b.column(1).to_pylist()], np.uint32)
            at = ((np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(-1, 4) + salt[:, None]) % np.uint32(bits)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((at & 63).astype(np.int32))], names=["word", "bit"])

    out = np.zeros(bits // 64, np.uint64)
    rows = mapped(keys.select("digest", "salt"), words, "word int, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("w")).toPandas()
    out[rows.word.to_numpy()] = rows.w.to_numpy(np.int64).view(np.uint64)
    return out


def shared_filter(docs: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Filter of the digests that occur more than once."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [d for t in b.column(1) for d, _ in chunks(payload(t.as_py())[1])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    counted = mapped(_texts(docs), digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    return bloom(stored(counted.where("n > 1").select("digest", F.lit(0).alias("salt")), "often"), most_bits)


DOC = "row_id long, doc_id long, n_bytes long, list_key binary, list binary, shared array<boolean>, n_shared int, own binary, digest binary, chunk binary, part int"


def write_media(docs: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Store the payloads and return what was written: (chunk lists with own chunks, shared chunks)."""
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(shared_filter(docs, most_bits))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents, and rows of shared chunks that this task has not sent yet."""
        w, part, n, sent = words.value, TaskContext.get().partitionId(), 0, set()
        names = [f.split()[0] for f in DOC.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.bool_()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                size, data = payload(text.as_py())
                got = chunks(data)
                flags = [in_filter(w, d) for d, _ in got]
                record = chunk_list(got)
                rows.append((part << 40 | n, doc, size, digest(struct.pack("<q", size) + record), record, flags, sum(flags), b"".join(c for (_, c), f in zip(got, flags) if not f), None, None, None))
                for (d, c), f in zip(got, flags):
                    if f and d not in sent:
                        sent.add(d)
                        rows.append((*[None] * 8, d, c, part))
                n += 1
            if len(sent) > 1_000_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), kinds)], names=names)

    both = stored(mapped(_texts(docs), lists, DOC), "media")
    sent = both.where("digest is not null")
    # One task's copy of each chunk is enough: a filter of the chosen ones spares the others the shuffle.
    chosen = sc.broadcast(bloom(stored(sent.groupBy("digest").agg(F.min("part").alias("salt")), "chosen"), most_bits))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = chosen.value
        for b in batches:
            yield b.filter(pa.array([in_filter(w, d, part) for d, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist())], pa.bool_())).select(["digest", "chunk"])

    one = mapped(sent.select("digest", "chunk", "part"), first, "digest binary, chunk binary")
    shared = stored(one.groupBy("digest").agg(F.first("chunk").alias("chunk")), "chunks")
    return both.where("row_id is not null").drop("digest", "chunk", "part"), shared


MEDIA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(record: bytes, parts: list[bytes]) -> tuple:
    """Values of a rebuilt payload from its stored form; raises if a chunk isn't what the list says."""
    if any((digest(p), len(p)) != x for x, p in zip(listed(record), parts, strict=True)):
        raise ValueError("a stored chunk differs from its digest")
    data = b"".join(parts)
    tally = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = tally[tally > 0] / len(data)
    feature = f"mean={(tally * np.arange(256)).sum() / len(data):.4f};entropy={-(share * np.log2(share)).sum():.4f};values={len(share)};chunks={len(parts)}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(record) + len(data), hashlib.sha256(record + data).hexdigest(), feature


def read_media(documents: DataFrame, shared: DataFrame) -> DataFrame:
    """Rebuild and verify every stored payload: (doc_id, n_bytes, payload_bytes, ..., feature)."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [f.split()[0] for f in MEDIA.split(", ")]

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for record, flags, own, others in zip(*(b.column(c) for c in ("list", "shared", "own", "others"))):
                record, own, at, parts, other = record.as_py(), own.as_py(), 0, [], iter(x["chunk"] for x in sorted(others.as_py() or [], key=lambda x: x["at"]))
                for (_, n), f in zip(listed(record), flags.as_py()):
                    if f:
                        parts.append(next(other))
                    else:
                        parts.append(own[at : at + n])
                        at += n
                out.append(describe(record, parts))
            keep = [c for c in ("doc_id", "n_bytes", "list_key") if c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds))], names=[*keep, *names])

    none = F.expr("cast(null as array<struct<at:int,chunk:binary>>)")
    plain = mapped(documents.where("n_shared = 0").select("doc_id", "n_bytes", "list", "shared", "own", none.alias("others")), rebuilt, f"doc_id long, n_bytes long, {MEDIA}")
    some = documents.where("n_shared > 0")
    first = some.groupBy("list_key").agg(F.min("row_id").alias("row_id")).select("row_id")
    place = F.posexplode("shared").alias("at", "yes")
    asked = first.join(some.select("row_id", "list", "shared"), "row_id").select("row_id", "list", place).where("yes").select("row_id", "at", F.expr("substring(list, 9 + 20 * at, 16)").alias("digest"))
    # Each text asks once, so that copies don't make a chunk popular; AQE splits what is left of skew.
    found = asked.join(shared, "digest").groupBy("row_id").agg(F.collect_list(F.struct("at", "chunk")).alias("others"))
    whole = some.select("row_id", "list_key", "list", "shared", "own").join(found, "row_id")
    each = stored(mapped(whole.select("list_key", "list", "shared", "own", "others"), rebuilt, f"list_key binary, {MEDIA}"), "rebuilt")
    return plain.union(popular_join(some.select("doc_id", "n_bytes", "list_key"), each, "list_key").select("doc_id", "n_bytes", *names))

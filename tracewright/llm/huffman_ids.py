"""Token ids in blocks of canonical, length-limited Huffman codes.

The code lengths come from the global counts of ids (a table bounded by the vocabulary) by package-merge. A file holds
blocks; a block holds whole documents in ascending id order, each starting at a byte, with the bit offset of every
``stride``-th id. Blocks and their checkpoints decode independently, by a table over the next ``limit`` bits, many
checkpoints in step.

Nulls: a null text is empty and has the end id alone; documents with a null id come first and keep it. Repeated ids
keep all their rows, ordered by content. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import stored, whole_text
from .words49k import by_rank, tokenizer_path, word_encoder

LIMIT, STRIDE, BLOCK_IDS, BLOCKS_AT_ONCE = 16, 512, 1 << 16, 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each id's code, 0 for ids that don't occur; the optimal ones of at most ``limit`` bits."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    items = counts[used].astype(np.float64)
    level, marks = items, []
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        merged = np.concatenate([items, level[0:even:2] + level[1:even:2]])
        order = np.argsort(merged, kind="stable")
        marks.append(order >= len(items))
        level = merged[order]
    take, length = 2 * len(items) - 2, np.zeros(len(items), np.int64)
    for packed in reversed(marks):
        packages = int(packed[:take].sum())
        length[: take - packages] += 1
        take = 2 * packages
    length[:take] += 1
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    step = 1 << (32 - lengths[order].astype(np.int64))
    codes[order] = ((np.cumsum(step) - step) >> (32 - lengths[order].astype(np.int64))).astype(np.uint32)
    return codes


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, per: np.ndarray | None = None, stride: int = STRIDE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of documents of ``per`` ids each (one document without it), every document from a byte border on.

    Returns the bytes, each document's bytes, the bit offsets of every stride-th id in its document, and how many of
    those each document has.
    """
    per = np.array([len(ids)]) if per is None else per
    n = lengths[ids].astype(np.int64)
    end = np.concatenate([[0], np.cumsum(n)])
    last = np.cumsum(per)
    first = last - per
    bits = end[last] - end[first]
    size = bits + 7 >> 3
    shift = (np.cumsum(size) - size) * 8 - end[first]
    start = end[:-1] + np.repeat(shift, per)
    word = codes[ids].astype(np.int64) << (24 - (start & 7) - n)
    total = int(size.sum())
    out = np.zeros(total + 2)
    for k in range(3):
        out += np.bincount((start >> 3) + k if k else start >> 3, weights=(word >> (16 - 8 * k)) & 255, minlength=total + 2)[: total + 2]
    marks = -(-per // stride)
    nth = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
    at = np.repeat(first, marks) + nth * stride
    return out[:total].astype(np.uint8).tobytes(), size, (end[at] - np.repeat(end[first], marks)).astype(np.int32), marks


def lookup(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length of every string of ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    times = 1 << (limit - lengths[order].astype(np.int64))
    pad = max(0, (1 << limit) - int(times.sum()))
    return np.pad(np.repeat(order, times), (0, pad)).astype(np.uint16), np.pad(np.repeat(lengths[order], times), (0, pad), constant_values=1).astype(np.int64)


def decode_ids(data: np.ndarray, at: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids of all streams, one after another: ``n`` of them from bit ``at`` of ``data``; streams decode in step."""
    ids, bits = table
    d = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
    order = np.argsort(-n, kind="stable")
    pos, left = at[order].astype(np.int64), n[order]
    to = (np.cumsum(n) - n)[order]
    out = np.empty(int(n.sum()), np.uint16)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for k, m in enumerate(active):
        p = pos[:m]
        code = (window[p >> 3] >> (32 - limit - (p & 7)).astype(np.uint32)) & ((1 << limit) - 1)
        out[to[:m] + k] = ids[code]
        p += bits[code]
    return out


def binaries(data: np.ndarray | bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column of consecutive stretches of ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, ids): every whole text's ids as little-endian 16-bit bytes, the end id last."""
    merged = by_rank(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, merged)
        for b in batches:
            at = 0
            for ids, n in encoder.encode_column(b.column(1)):
                data = np.insert(ids, np.cumsum(n), end_id).astype("<u2")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), binaries(data, 2 * (n + 1))], names=["doc_id", "ids"])
                at += len(n)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int = 1 << 16) -> np.ndarray:
    """Occurrences of each id; tasks send one row for each id that they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                n += np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in b.column(0).slice(k, 500)), "<u2"), minlength=vocabulary)
        seen = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for i, n in mapped(tokens.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n")).collect():  # at most the vocabulary
        out[i] = n
    return out


BLOCK = "range int, block int, start long, doc_ids array<long>, n_ids array<int>, doc_bytes array<int>, marks array<int>, bits binary"


def write_huffman(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> tuple[DataFrame, DataFrame]:
    """Encode every document, write the blocks, and return what was written: (blocks, code lengths)."""
    spark = docs.sparkSession
    tokens = stored(token_ids(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id), "ids")
    lengths = code_lengths(id_counts(tokens))
    code = spark.sparkContext.broadcast((lengths, canonical(lengths)))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.rdd.getNumPartitions())
    # Bounds of the id ranges: one number for each range.
    bounds = np.unique(np.array(tokens.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else [], np.float64)).astype(np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, codes = code.value
        for b in batches:
            if not b.num_rows:
                continue
            n = pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            bits, size, at, marks = encode_ids(np.frombuffer(b"".join(x.as_buffer() for x in b.column(1)), "<u2"), lens, codes, n)
            doc = b.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(marks)]).astype(np.int32), pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, doc, side="left"), pa.int32()), b.column(0), pa.array(n, pa.int32()), binaries(bits, size), lists], names=["range", "doc_id", "n", "bits", "marks"])

    coded = mapped(tokens, encode, "range int, doc_id long, n int, bits binary, marks array<int>")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"range": None, "block": 0, "start": 0}
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            n = [h[1] for h in held]
            row = [[state["range"]], [state["block"]], [state["start"]], [[h[0] for h in held]], [n], [[len(h[2]) for h in held]], [[m for h in held for m in h[3]]], [b"".join(h[2] for h in held)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            state["block"] += 1
            state["start"] += sum(n)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=[f.split()[0] for f in BLOCK.split(", ")])

        size = 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and (r[0] != state["range"] or size + r[2] > BLOCK_IDS):
                    yield flush()
                    size = 0
                if r[0] != state["range"]:
                    state.update(range=r[0], block=0, start=0)
                held.append(r[1:])
                size += r[2]
        if held:
            yield flush()

    blocks = mapped(coded.repartitionById(ranges, "range").sortWithinPartitions("range", "doc_id", "n", "bits"), block, BLOCK)
    lens = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.nonzero(lengths)[0]], "id int, bits int")
    return stored(blocks, "huffman", "uncompressed"), stored(lens.coalesce(1), "huffman-code")


Batches = Iterator[pa.RecordBatch]


def decoder(blocks: DataFrame, code: DataFrame) -> Callable[[Batches], Batches]:
    """A function from batches of blocks to batches of (doc_id, start, ids)."""
    sc = blocks.sparkSession.sparkContext
    lengths = np.zeros(1 << 16, np.uint8)
    for i, n in code.collect():  # at most the vocabulary
        lengths[i] = n
    before, at = {}, 0
    sizes = blocks.select("range", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("range").agg(F.sum("n")).collect()
    for r, n in sorted(sizes):  # one row for each range of ids
        before[r], at = at, at + n
    known = sc.broadcast((lengths, before))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, base = known.value
        table = lookup(lens)
        for b in batches:
            for k in range(0, b.num_rows, BLOCKS_AT_ONCE):
                part = b.slice(k, BLOCKS_AT_ONCE)
                n, size, marks = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n_ids", "doc_bytes", "marks"))
                docs = part.column("doc_ids").flatten()
                bits = b"".join(x.as_buffer() for x in part.column("bits"))
                per = -(-n // STRIDE)
                doc = np.repeat(np.arange(len(n)), per)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                ids = decode_ids(np.frombuffer(bits, np.uint8), (np.cumsum(size, dtype=np.int64) - size)[doc] * 8 + marks, np.minimum(STRIDE, n[doc] - nth * STRIDE).astype(np.int64), table)
                end = np.cumsum(n, dtype=np.int64)
                block = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column("n_ids")).to_numpy())
                first = np.array([base[r] + s for r, s in zip(part.column("range").to_pylist(), part.column("start").to_pylist())])
                began = np.zeros(part.num_rows, np.int64)
                np.add.at(began, block, n)
                start = first[block] + end - n - (np.cumsum(began) - began)[block]
                data = ids.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([docs, pa.array(start, pa.int64()), pa.array([data[2 * (e - c) : 2 * e] for e, c in zip(end.tolist(), n.tolist())], pa.binary())], names=["doc_id", "start", "ids"])

    return decode


def read_huffman(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """Documents of the blocks in file order: (doc_id, start, ids), ids as little-endian 16-bit bytes."""
    return mapped(blocks, decoder(blocks, code), "doc_id long, start long, ids binary")


def read_digests(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the blocks' documents, decoded and digested in one Python pass."""
    decode = decoder(blocks, code)

    def run(batches: Batches) -> Batches:
        for b in decode(batches):
            ids = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long")

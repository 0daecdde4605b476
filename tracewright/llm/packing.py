"""Best-fit sequence packing by minimum bin slack over the corpus's histogram of piece lengths.

A piece's place depends on nothing but its length, and lengths are whole numbers up to the capacity. So the packing is
planned on the histogram of lengths, which has at most ``capacity`` entries however large the corpus is: for a bin that
must hold the longest piece left, a bitset subset-sum dynamic programme over the available lengths (with their
multiplicities) finds the fullest feasible combination; that combination is removed as many times as the counts allow.
Pieces then take the planned places by their rank among the pieces of equal length. Ranks come from a count in each
partition and a running sum over partitions, never from one window over all rows of a length.

Nulls: a null text is empty, a null id stays null. An empty text has the end id alone. Repeated rows are packed each
for itself; ties in length are dealt in partition order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import stored, whole_text
from .words49k import by_rank, tokenizer_path, word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1) -> DataFrame:
    """Token pieces of every whole text, each with its rank among its partition's pieces of that length."""

    merged = by_rank(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = word_encoder(tokenizer, merged), TaskContext.get().partitionId(), {}
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]
        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for ids, per in encoder.encode_column(batch.column(1)):
                data = np.insert(ids, np.cumsum(per), end_id).astype("<u4")
                rows, begin = [], 0
                for m in (per + 1).tolist():
                    doc = next(docs)
                    for k, at in enumerate(range(0, m, capacity)):
                        n = min(capacity, m - at)
                        rank = seen[n] = seen.get(n, -1) + 1
                        rows.append((doc, k, at, n, zlib.crc32(data[begin + at : begin + at + n]), part, rank))
                    begin += m
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), cut, PIECES)


def fullest(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """Lengths (with multiplicities) of a bin that holds ``first`` and is as full as the available lengths allow."""
    room, reach, steps = capacity - first, 1, []
    mask, want = (1 << (room + 1)) - 1, 1 << room
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        unit = 1
        while left > 0 and not reach & want:
            use = min(unit, left)
            after = (reach | reach << length * use) & mask
            if after != reach:
                steps.append((length, use, reach))
                reach = after
            left -= use
            unit *= 2
        if reach & want:
            break
    fill, out = reach.bit_length() - 1, {first: 1}
    for length, use, before in reversed(steps):
        if not before >> fill & 1:
            fill -= length * use
            out[length] = out.get(length, 0) + use
    return out


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Places by length and rank, sorted by ``key`` = length << 44 | first rank.

    Ranks from the key on fill bins ``bin``, ``bin + 1``, ... with ``each`` pieces a bin, from ``offset`` on.
    Every removal uses up a length or leaves less of it than one bin's share, so the table is bounded by the capacity.
    """
    left, used, bins, rows = {n: c for n, c in counts.items() if c > 0}, dict.fromkeys(counts, 0), 0, []
    while left:
        combination = fullest(left, max(left), capacity)
        times = min(left[n] // m for n, m in combination.items())
        at = 0
        for n, m in sorted(combination.items(), reverse=True):
            rows.append((n << 44 | used[n], bins, m, at))
            used[n] += m * times
            left[n] -= m * times
            at += n * m
            if not left[n]:
                del left[n]
        bins += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": cols[:, 0], "bin": cols[:, 1], "each": cols[:, 2], "offset": cols[:, 3], "bins": np.array([bins])}


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), capacity), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    places = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank_in_part")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(p["key"], length << 44 | rank, side="right") - 1
            nth = rank - (p["key"][at] & ((1 << 44) - 1))
            each = p["each"][at]
            to = [pa.array(p["bin"][at] + nth // each), pa.array(p["offset"][at] + nth % each * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *to], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

A text's shingles are its runs of five words (lower case, letters, digits and underscores; a shorter text has one
shingle of all its words). Documents with one set of shingles form a class. Every class has a signature of
``trees`` x ``depth`` minimum hashes, 16 bits of each; in a tree's prefix trie, classes that share a prefix of ``k``
hashes are one node. The forest is searched from its leaves up: classes with equal full paths meet first, then the
prefixes are shortened by one hash at a time. A node whose members came together from one longer prefix has nothing
new; of the others only pairs that share no longer prefix in any tree are looked at. The similarities of the links
found tell how many links the prefixes of that length have missed (a pair of similarity s shares one in some tree with
probability 1 - (1 - s^k)^trees); shortening ends when the estimated recall, with one link at the threshold counted in
besides, reaches the target, or at the length at which every single pair at the threshold has it.

Nodes' members meet in units of bounded size, where each pair is verified exactly, in the first tree that has it at
that length; units return counts of links, roots of components and tallies of similarities, never pairs.

Nulls: a null or wordless text has no shingles and links with nothing, nor does a document with a null id. Rows that
repeat an id and a text count as copies of one document; rows that repeat an id with other shingles are documents of
their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import components, in_units, mix, parts_of, roots, runs, stored, whole_text

WORDS, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 24, 8, 0.9995
#: Shingles in a block of a unit, and documents up to which their ids are broadcast instead of joined.
BLOCK_SHINGLES, MOST_BROADCAST = 400_000, 1_000_000
#: Similarities from the threshold to 1 are tallied in so many bins.
BINS = 40
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORD: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []


def meets(similarity: np.ndarray | float, trees: int, prefix: int) -> np.ndarray | float:
    """Probability that a pair shares a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def shortest(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets with ``recall``; none is shortened further."""
    d = depth
    while d > 1 and meets(threshold, trees, d) < recall:
        d -= 1
    return d


def estimated_recall(tally: np.ndarray, threshold: float, trees: int, prefix: int) -> float:
    """Share of the links that prefixes of this length have found, by the similarities of those found (by bin)."""
    low = threshold + (1 - threshold) * np.arange(len(tally)) / len(tally)
    missed = (tally * (1 / meets(low, trees, prefix) - 1)).sum() + (1 / meets(threshold, trees, prefix) - 1)
    return float(tally.sum() / (tally.sum() + missed))


def is_word(codes: np.ndarray) -> np.ndarray:
    if not _WORD:
        _WORD.append(np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)]))
    return _WORD[0][codes]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, 2 * n)
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    inside = is_word(codes)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    n = min(words, len(word))
    many = len(word) - n + 1
    out = np.zeros(many, np.uint64)
    for k in range(n):
        out = out * np.uint64(STEP) + word[k : k + many]
    return np.unique(mix(out + np.uint64(n)))


def signature(marks: np.ndarray, trees: int, depth: int) -> bytes:
    """16 bits of each minimum hash, tree by tree."""
    rng = np.random.default_rng(20)
    a, b = (rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    x, least = (marks >> np.uint64(32)).astype(np.uint32), np.full(trees * depth, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(least, (x[k : k + 1024, None] * a + b).min(axis=0), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2").tobytes()


def path_hashes(signatures: np.ndarray, trees: int, prefix: int) -> np.ndarray:
    """A hash of each signature's prefix in each tree."""
    out = np.zeros((len(signatures), trees), np.uint64)
    for k in range(prefix):
        out = mix(out * np.uint64(STEP) + signatures.reshape(len(signatures), trees, -1)[:, :, k] + np.uint64(1))
    return out


def fingerprint(marks: np.ndarray) -> tuple[int, int]:
    """Two longs that name a set of shingles."""
    return tuple(np.frombuffer(hashlib.blake2b(marks.tobytes(), digest_size=16).digest(), "<i8").tolist())


def profiles(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(doc_id, text_key, fp1, fp2, n_marks, signature); a document without shingles has no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            names = [fingerprint(s) for s in sets]
            marks = [signature(s, trees, depth) if len(s) else None for s in sets]
            cols = [b.column(0), b.column(1), pa.array([f[0] for f in names], pa.int64()), pa.array([f[1] for f in names], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "fp1", "fp2", "n_marks", "signature"])

    return mapped(keyed(docs), run, "doc_id long, text_key long, fp1 long, fp2 long, n_marks int, signature binary")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): a hash of the text tells rows that share an id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))


def payloads(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, marks) of the classes in ``wanted`` (cid, id, text_key, fp1, fp2), from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "marks"])

    one = wanted.select("cid", F.col("id").alias("doc_id"), "text_key")
    few = one.count() <= MOST_BROADCAST  # 24 bytes each; more are joined by a shuffle
    chosen = keyed(docs).join(F.broadcast(one) if few else one, ["doc_id", "text_key"]).select("cid", "text")
    return mapped(chosen, run, "cid long, marks binary").groupBy("cid").agg(F.first("marks").alias("marks"))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, skip: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs with Jaccard similarity of at least the threshold, of those not in ``skip``, and their similarities.

    Without ``right``: pairs i < j of ``left``.
    """
    other = left if right is None else right
    size, n = np.array([len(x) for x in left]), np.array([len(x) for x in other])
    ids = np.unique(np.concatenate(left + (right or [])), return_inverse=True)[1]
    edge = np.concatenate([[0], np.cumsum(np.concatenate([size, n]) if right is not None else size)])
    mine = [ids[edge[i] : edge[i + 1]] for i in range(len(left))]
    theirs = mine if right is None else [ids[edge[len(left) + j] : edge[len(left) + j + 1]] for j in range(len(right))]
    flag, out_i, out_j, out_s = np.zeros(ids.max() + 1, np.int64), [], [], []
    for i, own in enumerate(mine):
        near = ~skip[i] & (np.minimum(size[i], n) >= threshold * np.maximum(size[i], n) - 1e-9)
        if right is None:
            near[: i + 1] = False
        js = np.nonzero(near)[0]
        if not len(js):
            continue
        flag[own] = 1
        begin = np.cumsum(n[js]) - n[js]
        both = np.add.reduceat(flag[np.concatenate([theirs[j] for j in js])], begin)
        flag[own] = 0
        good = both >= threshold * (size[i] + n[js] - both) - 1e-9
        out_s.append((both / (size[i] + n[js] - both))[good])
        out_i.append(np.full(int(good.sum()), i))
        out_j.append(js[good])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j]), np.concatenate([np.empty(0), *out_s])


def verified(units: DataFrame, threshold: float, trees: int, prefix: int) -> DataFrame:
    """(id, links, root): within each unit, weighted links of a member and the smallest member it is linked to.

    Rows without an id tell how many links (``links``) have a similarity of a bin (``root``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, "unit"):
            ids, copies, block = (unit.column(c).to_numpy() for c in ("cid", "copies", "block"))
            tree, b1, b2 = (unit.column(c)[0].as_py() for c in ("tree", "b1", "b2"))
            marks = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column("marks")]
            at = [np.nonzero(block == b)[0] for b in dict.fromkeys((b1, b2))]
            if not all(map(len, at)):
                continue
            a, z = at[0], at[-1]
            paths = np.frombuffer(b"".join(x.as_buffer() for x in unit.column("signature")), "<u2").reshape(len(ids), -1).astype(np.uint64)
            here, deeper = path_hashes(paths, trees, prefix)[:, :tree], path_hashes(paths, trees, prefix + 1) if prefix * trees < paths.shape[1] else np.empty((len(ids), 0), np.uint64)
            skip = np.zeros((len(a), len(z)), bool)
            for keys in (here, deeper):  # those pairs met in an earlier tree, or by a longer prefix
                for t in range(keys.shape[1]):
                    skip |= keys[a, t][:, None] == keys[z, t][None, :]
            i, j, similar = linked([marks[k] for k in a], None if b1 == b2 else [marks[k] for k in z], skip, threshold)
            if not len(i):
                continue
            i, j = a[i], z[j]
            links = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            root = ids[order][roots(len(ids), place[i], place[j])][place]
            some = links > 0
            bins = np.bincount(np.clip((similar - threshold) / (1 - threshold) * BINS, 0, BINS - 1).astype(np.int64) if threshold < 1 else np.full(len(similar), BINS - 1))
            seen = np.nonzero(bins)[0]
            yield pa.RecordBatch.from_arrays([pa.array([*ids[some].tolist(), *[None] * len(seen)], pa.int64()), pa.array(np.concatenate([links[some].astype(np.int64), bins[seen]])), pa.array(np.concatenate([root[some], seen]))], names=["id", "links", "root"])

    return mapped(units, run, "id long, links long, root long")


def nodes(classes: DataFrame, trees: int, depth: int, prefix: int) -> DataFrame:
    """(cid, weight, tree, path, longer): each class at its node of every tree, and the node below that it comes from."""
    at = [F.struct(F.lit(t).alias("tree"), F.substring("signature", 2 * depth * t + 1, 2 * prefix).alias("path"), F.substring("signature", 2 * depth * t + 1, 2 * prefix + 2).alias("longer")) for t in range(trees)]
    return classes.select("cid", F.col("n_marks").alias("weight"), F.explode(F.array(*at)).alias("_at")).select("cid", "weight", "_at.tree", "_at.path", "_at.longer" if prefix < depth else F.col("cid").cast("string").alias("longer"))


def all_links(docs: DataFrame, classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> tuple[DataFrame, int]:
    """(id, links, root) of the classes that link, in parts, and the prefix length that was reached."""
    last, parts = shortest(threshold, trees, depth, recall), parts_of(docs)
    # Only classes that share the shortest prefix with another have to be looked at.
    ends = nodes(classes, trees, depth, last)
    shared = ends.groupBy("tree", "path").agg(F.count("*").alias("n")).where("n > 1").select("tree", "path")
    wanted = stored(ends.join(shared, ["tree", "path"]).select("cid").distinct().join(classes, "cid"), "wanted")
    members = stored(wanted.join(payloads(docs, wanted), "cid").select("cid", "copies", "n_marks", "signature", "marks"), "members")
    tally, found, prefix = np.zeros(BINS), [], depth
    while True:
        units = in_units(nodes(members, trees, depth, prefix), "cid", ["tree", "path"], BLOCK_SHINGLES, parts, "longer")
        dealt = units.join(members.select("cid", "copies", "signature", "marks"), "cid").select("unit", "tree", "b1", "b2", "block", "cid", "copies", "signature", "marks").repartition(parts, "unit").sortWithinPartitions("unit")
        got = stored(verified(dealt, threshold, trees, prefix), "links")
        found.append(got.where("id is not null"))
        for b, n in got.where("id is null").groupBy("root").agg(F.sum("links")).collect():  # one row for each bin
            tally[b] += n
        if prefix <= last or estimated_recall(tally, threshold, trees, prefix) >= recall:
            break
        prefix -= 1
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out, prefix


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, component_id, kept, text_key) of every document.

    class_id is the smallest id with the same shingles, n_links the number of other documents at the threshold,
    component_id the smallest id reachable by links.
    """
    every = stored(profiles(docs, trees, depth), "profiles")
    some = every.where("signature is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "text_key"))
    classes = some.groupBy("fp1", "fp2").agg(first.alias("_first"), F.count("*").alias("copies"), F.first("n_marks").alias("n_marks"), F.first("signature").alias("signature"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), F.col("_first.doc_id").alias("id"), F.col("_first.text_key").alias("text_key"), "fp1", "fp2", "copies", "n_marks", "signature"), "classes")
    links, _ = all_links(docs, classes, threshold, trees, depth, recall)
    total = links.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "cid")
    group = components(links, "id", "root").join(classes.select(F.col("cid").alias("vertex"), "id"), "vertex")
    lowest = group.groupBy("component").agg(F.min("id").alias("component_id"))
    group = group.join(lowest, "component").select(F.col("vertex").alias("cid"), "component_id")
    named = classes.join(total, "cid", "left").join(group, "cid", "left").select(
        "fp1", "fp2", F.col("id").alias("class_id"), F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    )
    alone = every.where("signature is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_key")
    return some.select("doc_id", "text_key", "fp1", "fp2").join(named, ["fp1", "fp2"]).select("doc_id", "class_id", "n_copies", "n_links", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_key").union(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that link to one of a smaller id, directly or through others."""
    gone = stored(jaccard_join(docs).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct(), "gone")
    if gone.count() <= MOST_BROADCAST:  # 16 bytes each; more are joined by a shuffle
        gone = F.broadcast(gone)
    rows = docs.select(F.struct("*").alias("_row"))
    same = (F.col("_row.doc_id").cast("long") == F.col("_gone")) & (F.xxhash64(F.coalesce(F.col("_row.text"), F.lit(""))) == F.col("_key"))
    return rows.join(gone, same, "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])

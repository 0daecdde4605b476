"""Secret scans in DataFrame functions: three base patterns, and windows of high entropy in other long strings.

Positions of matches come from the lengths of the matches and of the gaps between them, in code points. A candidate for
the entropy rule is a maximal run of base-64 letters in what base spans and allow-listed words leave; a window of fixed
width slides over it, its letter counts and the sum of c log2 c change by one letter in and one out, and the run counts
if some window's Shannon entropy reaches the bound of the narrowest class that the run is made of. Runs on the
allow-list add nothing. The counts are bit fields of a few longs, so that a step costs the same in runs of any length.
Sums over spans and the cutting of texts go by blocks, so that many spans in one text cost about as much each as few.

Nulls: a null text is empty; an empty text has no spans. Repeated rows and null ids keep their rows. An empty table
gives an empty result. Other columns, of whatever names, are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Maximal runs that the entropy rule looks at, and how wide its window is.
RUN, WIDTH = "[A-Za-z0-9+/=_-]{20,}", 20
#: Bits a letter from which a window counts, by class; a window of 20 letters has log2(20) = 4.32 at most.
CLASSES = (("^[0-9a-fA-F-]+$", 3.1), ("^[a-z0-9]+$|^[A-Z0-9]+$", 3.6), ("", 3.7))
#: Runs that are no secrets: no digit or no letter, UUIDs, paths and joined words, examples and placeholders.
ALLOWED = (
    "^[^0-9]*$|^[^A-Za-z]*$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^[A-Za-z/_-]*[0-9]{0,8}[/_=-]*$",
    "(?i)example|placeholder|xxxx|0123456789|abcdefgh",
)

#: The words of the allow-list: they are no secret themselves, and what lies around them is looked at without them.
WORDS = ("example", "placeholder", "xxxx", "0123456789", "abcdefgh")


#: Items a block of running sums, and pieces a block of a text that is cut.
BLOCK, PIECES = 64, (1024, 32)


def let(value: Column, use) -> Column:
    """``use(value)``, the value being worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def in_blocks(items: Column, size: int) -> Column:
    last = F.floor((F.size(items) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * size + 1, F.lit(size)))


def running(items: Column, measure, add) -> Column:
    """What ``add`` makes, from 0 on, of the measures of all items before each: an array<int> as long as ``items``.

    Items are taken in blocks and the blocks' sums put end to end, so that no array of all items grows by one at a time.
    """
    none = F.expr("cast(array() as array<int>)")

    def before(values: Column, first: Column, size) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct(add(acc["at"], size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: add(acc, measure(x))))
        return F.flatten(F.zip_with(blocks, before(sums, F.lit(0), lambda x: x), lambda b, first: before(b, first, measure)))

    return let(in_blocks(items, BLOCK), joined)


def cut(text: Column, pieces: Column, origin: Column, blocks: tuple[int, ...] = PIECES) -> Column:
    """The letters from ``at`` to ``start`` of each of ascending ``pieces`` of ``text``, which starts at ``origin``.

    A piece is cut from its block's stretch of the text, not from the whole text, as finding a letter's place takes time
    in proportion to the letters before it.
    """
    if not blocks:
        return F.transform(pieces, lambda p: F.substring(text, p["at"] - origin + 1, p["start"] - p["at"]))

    def stretch(block: Column) -> Column:
        first, last = F.get(block, 0)["at"], F.get(block, F.size(block) - 1)["start"]
        part = F.struct(F.substring(text, first - origin + 1, last - first).alias("text"), first.alias("at"), block.alias("pieces"))
        return let(part, lambda v: cut(v["text"], v["pieces"], v["at"], blocks[1:]))

    return F.flatten(F.transform(in_blocks(pieces, blocks[0]), stretch))


def at_spans(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of all leftmost matches that ``valid`` accepts: array of (start, kind, end)."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))
    length = lambda p: p["g"] + F.coalesce(F.length(p["m"]), F.lit(0))

    def spans(p: Column) -> Column:
        placed = F.zip_with(p, running(p, length, lambda x, y: x + y), lambda x, at: F.struct(x["m"].alias("m"), (at + x["g"]).alias("at")))
        found = F.filter(placed, lambda x: x["m"].isNotNull() & valid(x["m"]))
        return F.transform(found, lambda x: F.struct(x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["m"])).alias("end")))

    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return F.when(text.rlike(pattern), let(pairs, spans)).otherwise(none)


#: Letters of runs are numbered from "+" on; a count of at most WIDTH takes 5 bits, 12 counts a long.
LOWEST, FIELD, FIELDS, LONGS = ord("+"), 5, 12, 7
#: c log2 c of counts c in whole 2**-32ths, so that sums are exact.
TERMS = [0] + [round(c * math.log2(c) * 2**32) for c in range(1, WIDTH + 1)]


def window_entropy(run: Column) -> Column:
    """Largest Shannon entropy, in bits, of a window of WIDTH letters of a run."""
    one = F.lit(1).cast("long")

    def place(c: Column) -> Column:
        """Which long has the letter's count, how far up, and a count of one there."""
        number = F.ascii(c) - LOWEST
        up = number % FIELDS * FIELD
        return F.struct(F.floor(number / FIELDS).cast("int").alias("word"), up.alias("up"), F.call_function("shiftleft", one, up).alias("unit"))

    letters = F.transform(F.split(run, ""), place)
    gone = F.concat(F.transform(F.array_repeat(F.lit(0), WIDTH), lambda _: F.struct(F.lit(None).cast("int").alias("word"), F.lit(None).cast("int").alias("up"), F.lit(0).cast("long").alias("unit"))), F.slice(letters, 1, F.size(letters) - WIDTH))
    pairs = F.arrays_zip(letters.alias("into"), gone.alias("out"))
    terms = F.array(*[F.lit(t).cast("long") for t in TERMS])
    none = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("seen"), F.lit(1 << 62).alias("low"))

    def count(acc: Column, letter: Column) -> Column:
        return F.call_function("shiftright", F.get(acc["n"], letter["word"]), letter["up"]).bitwiseAND(31).cast("int")

    def step(acc: Column, p: Column) -> Column:
        """First the letter that goes is taken off, then the other is counted."""
        came, left = p["into"], p["out"]
        n = F.transform(acc["n"], lambda x, j: F.when(j == came["word"], x + came["unit"]).otherwise(x) - F.when(j == left["word"], left["unit"]).otherwise(F.lit(0).cast("long")))
        old, new = count(acc, left), count(acc, came) - F.when(came["unit"].eqNullSafe(left["unit"]) & came["word"].eqNullSafe(left["word"]), 1).otherwise(0)
        total = acc["sum"] + F.coalesce(F.get(terms, old - 1) - F.get(terms, old), F.lit(0).cast("long")) + F.get(terms, new + 1) - F.get(terms, new)
        return F.struct(n.alias("n"), total.alias("sum"), (acc["seen"] + 1).alias("seen"), F.when((acc["seen"] >= WIDTH - 1) & (total < acc["low"]), total).otherwise(acc["low"]).alias("low"))

    return F.aggregate(pairs, none, step, lambda acc: F.lit(math.log2(WIDTH)) - acc["low"] / float(WIDTH << 32))


def suspicious(run: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | run.rlike(pattern)
    bound = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        bound = F.when(run.rlike(pattern), F.lit(bits)).otherwise(bound)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(run) >= bound)


def refilled(text: Column, spans: Column, fill, apart: bool) -> Column:
    """``text`` with ``fill(span)`` in place of each span, in order of start; overlapping ones are one span if ``apart``.

    ``fill`` gets the ``start`` and ``end`` of what a span holds beyond the spans before it.
    """

    def made(s: Column) -> Column:
        ends = running(s, lambda x: x["end"], F.greatest)
        placed = F.zip_with(s, ends, lambda x, at: F.struct(at.alias("at"), F.greatest(at, x["start"]).alias("start"), x["end"].alias("end"), (x["start"] >= at).alias("apart")))
        return let(F.filter(placed, lambda x: x["apart"]) if apart else placed, lambda pieces: F.zip_with(cut(text, pieces, F.lit(0)), pieces, lambda gap, x: F.concat(gap, fill(x))))

    tail = F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.array_join(F.concat(let(spans, made), F.array(tail)), "")).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces, as many as the letters were, in place of spans (in order of start) and allow-listed words."""
    out = refilled(text, spans, lambda x: F.repeat(F.lit(" "), F.greatest(x["end"] - x["start"], F.lit(0))), apart=False)
    for word in WORDS:
        out = F.regexp_replace(out, f"(?i){word}", " " * len(word))
    return out


def with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of (start, kind, end), in order of start, then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    always = lambda m: F.lit(True)
    base = F.array_sort(F.concat(at_spans(text, ASSIGN, 0, value), at_spans(text, ACCESS, 1, always), at_spans(text, HEX, 2, always)))
    df = docs.withColumn("_base", base).withColumn("_rest", F.when(text.rlike(RUN), blanked(text, F.col("_base"))).otherwise(F.lit("")))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", at_spans(F.col("_rest"), RUN, 3, suspicious)))).drop("_rest")


def as_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every whole text."""
    df = with_spans(docs.select(F.col("doc_id"), whole_text().alias("_text")), F.col("_text"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text("_base"), 256).alias("base_sha256"), as_text("_spans").alias("spans"), count(3).alias("n_entropy"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of a text, overlapping ones joined, replaced by ``mask``; ``n_chars`` follows if there."""
    row, text = F.col("_row"), F.col("_row.text")
    df = with_spans(docs.select(F.struct("*").alias("_row")), F.coalesce(text, F.lit("")))
    new = refilled(text, F.col("_spans"), lambda x: F.lit(mask), apart=True)
    df = df.select("_row", F.when(F.size("_spans") > 0, new).alias("_new"))
    changed = {"text": F.coalesce("_new", text)} | ({"n_chars": F.coalesce(F.length("_new").cast(dict(docs.dtypes)["n_chars"]), row["n_chars"])} if "n_chars" in docs.columns else {})
    return df.select(*[changed.get(c, row[c]).alias(c) for c in docs.columns])

"""Ranked lexical search: each item's best documents by integer scores of shared terms, over term-bucketed postings.

Postings (bucket, term, rid, doc_id, n, tf) of the items' terms are one stored table whose files are sorted by bucket
and term; hot terms lie spread over all files. A posting's ``impact`` doesn't depend on the item; a match is worth the
term's weight times the impact. For scoring, postings are dealt out by document, so that a document's matches are summed
where they arise and only each task's best ``k`` sums of an item are shuffled: matches and sums never are.

Items are taken in blocks of at most ``MOST_TERMS`` terms or so, whose terms are broadcast.

Nulls: a null text has no terms; an item or document without terms takes no part. A document with a null id is ranked
after the others of its score. Rows of ``documents`` that repeat an id are documents of their own; rows of the items
that repeat id and text are one item, those of one id and other texts have a ranking each. Empty tables give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, stored, whole_text

#: What parts terms: ASCII but digits and letters. Fixed value.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
K, BUCKETS, MOST_TERMS = 50, 256, 200_000


def words_of(text: str = "text") -> Column:
    """The text's terms in order, with repeats, in the letters' own cases."""
    return F.array_remove(F.split(whole_text(text), BETWEEN), "")


def lowered(term: str = "term") -> Column:
    """A term with small letters for A to Z; ``lower`` is the quick way for terms that are all ASCII."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, CAPITALS, CAPITALS.lower()))


def bucket_of(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(bucket, term, rid, doc_id, n, tf) of the terms in ``vocabulary`` (broadcast), and with the empty term one row of
    each document, whatever its terms, that tells its length ``n``."""
    # The array of one array: each text is split once, not for every use of its words.
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words_of())).alias("words"))
    each = words.select("rid", "doc_id", F.size("words").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term")).withColumn("term", lowered())
    wanted = F.broadcast(vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit(""))))
    tf = each.join(wanted, "term", "left_semi").groupBy("rid", "doc_id", "n", "term").agg(F.count("*").alias("tf"))
    return stored(tf.select(bucket_of().alias("bucket"), "term", "rid", "doc_id", "n", "tf").sortWithinPartitions("bucket", "term", "rid"), "postings")


def with_impact(table: DataFrame) -> DataFrame:
    """Postings with their ``impact``, by the documents' number and length; and each document's row gone."""
    totals = F.broadcast(table.where("term = '' and n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")))  # one row
    m = table.where("term <> ''").crossJoin(totals).withColumn("m", F.expr("50 + (50 * n * docs) div words"))
    return m.select("bucket", "term", "rid", "doc_id", "docs", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("impact"))


def weighed(table: DataFrame) -> DataFrame:
    """(bucket, term, df, w, top): each term's weight and the most that a match of it is worth."""
    t = table.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max("impact").alias("impact"), F.first("docs").alias("docs"))
    w = F.floor(1000 * F.log((2 * F.col("docs") + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    return t.select("bucket", "term", "df", w.alias("w"), (w * F.col("impact")).alias("top"))


def search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(iid, rank, doc_id, score) of the items with ``terms`` (iid, term)."""
    table = with_impact(postings(docs, terms.select("term").distinct()))
    known = stored(terms.join(weighed(table), "term").select("iid", "bucket", "term", "w").coalesce(1), "item-terms")  # MOST_TERMS rows or so
    matches = table.select("bucket", "term", "rid", "doc_id", "impact").repartition(parts_of(docs), "rid").join(F.broadcast(known), ["bucket", "term"])
    scores = matches.groupBy("iid", "rid", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")
    # Tasks' own best first, then those of 64 groups of tasks, so that no task gathers what all tasks have.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid"]
    for by in (["iid", "_group"], ["iid"]):
        scores = scores.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(64))) if "_group" in by else scores
        scores = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return scores.select("iid", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` best documents with a score above 0."""
    named = stored(items.select("item_id", "text").distinct().select(F.monotonically_increasing_id().alias("iid"), "item_id", words_of().alias("words")), "items")
    terms = named.select("iid", F.explode("words").alias("term")).select("iid", lowered().alias("term")).distinct()
    blocks = -(-terms.count() // most_terms) or 1
    found = [search_block(docs, terms.where(F.pmod(F.xxhash64("iid"), F.lit(blocks)) == b), k) for b in range(blocks)]
    return reduce(DataFrame.union, found).join(named.select("iid", "item_id"), "iid").select("item_id", "rank", "doc_id", "score")

"""The registered queries opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_forest, annulus_negatives, byte_bpe, chat, html_mincut, huffman_ids, lang_cnn, lattice_dedup, lexical, lsh_forest, media_chunks, packing, secret_scan, sql
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_lang_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_cnn.identify(table(spark, sf_dir, "documents"))


def op5_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.decode_ids(byte_bpe.encode_texts(table(spark, sf_dir, "documents"))))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.read_media(*media_chunks.write_media(table(spark, sf_dir, "documents")))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.read_digests(*huffman_ids.write_huffman(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")  # a key of the operator's own


def op11_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.neighbours(table(spark, sf_dir, "embeddings"))


def op12_annulus_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ALL = (
    op1_lattice_dedup, op2_best_fit_packing, op3_chat_collapse, op4_lang_cnn, op5_html_mincut,
    op6_secret_scan, op7_byte_bpe, op8_media_chunks, op9_huffman_ids, op10_jaccard_join,
    op11_ann_forest, op12_annulus_negatives, op13_lexical,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)

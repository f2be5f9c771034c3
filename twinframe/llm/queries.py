"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers

from . import oracles
from .byte_bpe import round_trip
from .centroids import cluster_report
from .chats import format_conversations, read_back, with_odd_one
from .common import table
from .extract import extract_pages
from .minhash import near_duplicates
from .packing import pack
from .phrases import phrases
from .quality import quality_rules
from .sharding import assign_shards
from .tokens import token_counts
from .toxicity import toxicity
from .vectors import near_vectors
from .warc import archive_round_trip

#: Bytes of text in a shard, at most.
SHARD_BYTES = 1 << 20


def op1_grouping_genetic_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_adaptive_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_heap_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_product_quantised_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc_round_trip(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_extendible_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_line_block_extraction(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_byte_bpe_round_trip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_positive_unlabelled_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_odd_sketch_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_best_first_phrases(spark, sf_dir):
    return phrases(table(spark, sf_dir, "documents"))


def op12_grammar_round_trip_chats(spark, sf_dir):
    return read_back(format_conversations(with_odd_one(table(spark, sf_dir, "conversations"))))


def op13_rotated_centroid_clusters(spark, sf_dir):
    return cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_grouping_genetic_packing, op2_adaptive_quality_rules, op3_heap_token_counts, op4_product_quantised_near_vectors, op5_warc_round_trip, op6_extendible_sharding, op7_line_block_extraction, op8_byte_bpe_round_trip, op9_positive_unlabelled_toxicity, op10_odd_sketch_near_duplicates, op11_best_first_phrases, op12_grammar_round_trip_chats, op13_rotated_centroid_clusters)}

#: Tokens, packings, extracted texts and scores have no SQL; their tests hold them against the libraries or brute force.
ORACLE_SQL: dict[str, str] = {
    op2_adaptive_quality_rules.__name__: oracles.quality(),
    op4_product_quantised_near_vectors.__name__: oracles.vectors(),
    op5_warc_round_trip.__name__: oracles.archives(),
    op6_extendible_sharding.__name__: oracles.shards(SHARD_BYTES),
    op10_odd_sketch_near_duplicates.__name__: oracles.near_copies(),
    op11_best_first_phrases.__name__: oracles.phrases(),
    op12_grammar_round_trip_chats.__name__: oracles.chats(),
    op13_rotated_centroid_clusters.__name__: oracles.clusters(),
}

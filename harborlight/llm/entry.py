"""Queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harborlight.llm import exact_dedup, jaccard_join, licences, media, packing, periodic, quality, ranked_search, repeats, sentence_pieces, shards, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1,
        "op2_media": media.op2,
        "op3_exact_dedup": exact_dedup.op3,
        "op4_ngram_jaccard": jaccard_join.op4,
        "op5_shards": shards.op5,
        "op6_sentence_pieces": sentence_pieces.op6,
        "op7_repeats": repeats.op7,
        "op8_toxicity": toxicity.op8,
        "op9_licences": licences.op9,
        "op10_packing": packing.op10,
        "op11_periodic_runs": periodic.op11,
        "op12_ranked_search": ranked_search.op12,
        "op13_simhash": simhash.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.SQL, "op4_ngram_jaccard": jaccard_join.SQL, "op7_repeats": repeats.SQL,
        "op9_licences": licences.sql(), "op12_ranked_search": ranked_search.SQL,
    }

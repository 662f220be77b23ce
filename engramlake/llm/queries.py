"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from engramlake.llm import decontaminate, lang_id, line_dedup, lm, packing, phrases, sharding, simhash, topk, url_filter
from engramlake.session import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


QUERIES = {
    q.__name__: _shipped(q)
    for q in (
        lm.op1_lm,
        phrases.op2_phrases,
        url_filter.op3_url_filters,
        simhash.op4_simhash,
        topk.op5_topk,
        line_dedup.op6_line_dedup,
        packing.op7_packing,
        decontaminate.op8_decontaminate,
        lang_id.op9_language_id,
        sharding.op10_sharding,
    )
}

ORACLES = {
    "op2_phrases": phrases.oracle,
    "op3_url_filters": url_filter.oracle,
    "op5_topk": topk.oracle,
    "op6_line_dedup": line_dedup.oracle,
    "op8_decontaminate": decontaminate.oracle,
    "op10_sharding": sharding.oracle,
}

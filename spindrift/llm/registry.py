"""Queries of the training-data operators."""

from __future__ import annotations

import functools

from spindrift.llm import _text, ann, decontaminate, html_extract, jaccard_join, lang_id, licenses, sentencepiece_codec, suffix_dedup, token_counts, warc


def _prepared(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        _text.prepare(spark)
        return query(spark, sf_dir)

    return run


_ALL = (
    decontaminate.op1_decontaminate,
    licenses.op2_license_scan,
    warc.op3_warc,
    ann.op4_nearest_neighbours,
    token_counts.op5_token_counts,
    html_extract.op6_html_text,
    sentencepiece_codec.op7_sentencepiece,
    suffix_dedup.op8_suffix_dedup,
    jaccard_join.op9_jaccard_join,
    lang_id.op10_language_id,
)
QUERIES = {f.__name__: _prepared(f) for f in _ALL}
ORACLES: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op8_suffix_dedup": suffix_dedup.OP8_SQL, "op9_jaccard_join": jaccard_join.OP9_SQL}

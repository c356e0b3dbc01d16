"""Operators of a training-data pipeline; their queries and SQL."""

from __future__ import annotations

from pyspark import cloudpickle

from punctua import session
from punctua.llm import (
    decontaminate, html, jaccard, language, licences, lookups, negatives, neighbours, packing,
    quality, recompression, recurrent, runs, suffixes, trie, words,
)

for _module in (decontaminate, html, jaccard, language, licences, lookups, negatives, neighbours,
                packing, quality, recompression, recurrent, runs, session, suffixes, trie, words):
    # Task functions travel with the job, so that workers need no copy of this package.
    cloudpickle.register_pickle_by_value(_module)

QUERIES = {
    "op1_suffixes": suffixes.op1_suffixes,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_language": language.op3_language,
    "op4_licences": licences.op4_licences,
    "op5_recompression": recompression.op5_recompression,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_html": html.op9_html,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_trie": trie.op11_trie,
    "op12_negatives": negatives.op12_negatives,
    "op13_recurrent": recurrent.op13_recurrent,
}
ORACLES = {
    "op2_jaccard": jaccard.ORACLE,
    "op4_licences": licences.oracle(),
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_trie": trie.ORACLE,
    "op12_negatives": negatives.ORACLE,
}

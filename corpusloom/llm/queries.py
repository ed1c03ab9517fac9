"""Registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import (
    decontam,
    fillmiddle,
    jaccard,
    langcrf,
    linededup,
    lmscore,
    packing,
    quality,
    search,
    secretscan,
    urlfilter,
    warc,
    whitening,
)

QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op2_langcrf": langcrf.op2_langcrf,
    "op3_decontam": decontam.op3_decontam,
    "op4_quality": quality.op4_quality,
    "op5_search": search.op5_search,
    "op6_packing": packing.op6_packing,
    "op7_warc": warc.op7_warc,
    "op8_secretscan": secretscan.op8_secretscan,
    "op9_lmscore": lmscore.op9_lmscore,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_urlfilter": urlfilter.op11_urlfilter,
    "op12_whitening": whitening.op12_whitening,
    "op13_fillmiddle": fillmiddle.op13_fillmiddle,
}
ORACLE = {
    "op1_linededup": linededup.OP1_SQL,
    "op7_warc": warc.OP7_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
    "op11_urlfilter": urlfilter.OP11_SQL,
    "op13_fillmiddle": fillmiddle.OP13_SQL,
}

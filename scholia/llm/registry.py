"""The queries of the training-data operators."""

from __future__ import annotations

from scholia.llm import ann, clusters, decontam, lmscore, maintext, merkle, mixing, neardup, pii, quality, substrings, tokencount, toxicity

MODULES = (mixing, tokencount, substrings, toxicity, lmscore, ann, pii, neardup, quality, decontam, merkle, clusters, maintext)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

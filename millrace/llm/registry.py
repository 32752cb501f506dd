"""The queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import q_decontam, q_html, q_langid, q_licenses, q_mixing, q_near_dup, q_packing, q_quality, q_toxicity, q_warc

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (q_decontam, q_html, q_langid, q_licenses, q_mixing, q_near_dup, q_packing, q_quality, q_toxicity, q_warc):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))

"""The registered queries of this subpackage."""

from __future__ import annotations

from . import chat, decontamination, fingerprints, jaccard, licenses, mixing, pii, ranked, spelling, topk, toxicity, urls, warc

QUERIES = {"op1_chat": chat.op1_chat, "op2_jaccard": jaccard.op2_jaccard, "op3_urls": urls.op3_urls, "op4_fingerprints": fingerprints.op4_fingerprints, "op5_warc": warc.op5_warc, "op6_mixing": mixing.op6_mixing, "op7_toxicity": toxicity.op7_toxicity, "op8_pii": pii.op8_pii, "op9_decontamination": decontamination.op9_decontamination, "op10_licenses": licenses.op10_licenses, "op11_spelling": spelling.op11_spelling, "op12_topk": topk.op12_topk, "op13_ranked": ranked.op13_ranked}
ORACLE_SQL = {"op1_chat": chat.OP1_SQL, "op2_jaccard": jaccard.OP2_SQL, "op5_warc": warc.OP5_SQL, "op11_spelling": spelling.OP11_SQL, "op12_topk": topk.OP12_SQL, "op13_ranked": ranked.OP13_SQL}

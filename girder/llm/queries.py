"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from girder.llm import ann, bpe, centroids, chat, dedup, infill, licenses, mixing, quality, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_exact_dedup": dedup.query,
    "op3_warc_salvage": warc.query,
    "op4_simhash": simhash.query,
    "op5_chat_format": chat.query,
    "op6_bpe": bpe.query,
    "op7_toxicity": toxicity.query,
    "op8_secret_scan": secrets.query,
    "op9_quality": quality.query,
    "op10_ann": ann.query,
    "op11_infill": infill.query,
    "op12_centroids": centroids.query,
    "op13_licenses": licenses.query,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_exact_dedup": dedup.ORACLE,
    "op3_warc_salvage": warc.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op11_infill": infill.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_licenses": licenses.ORACLE,
}

"""The queries of this subpackage, opN_<name>, each over its whole tables, and their SQL."""

from __future__ import annotations

from . import bpe, chat, clusters, embedding, html, langid, licenses, mixing, negatives, pii, quality, simhash, toxicity
from .common import table

QUERIES = {
    "op1_quality_rules": lambda s, d: quality.op1(table(s, d, "documents"), table(s, d, "labels")),
    "op2_language_id": lambda s, d: langid.op2(table(s, d, "documents")),
    "op3_simhash": lambda s, d: simhash.op3(table(s, d, "documents")),
    "op4_embeddings": lambda s, d: embedding.op4(table(s, d, "embeddings")),
    "op5_chat_perspectives": lambda s, d: chat.op5(table(s, d, "conversations")),
    "op6_pii": lambda s, d: pii.op6(table(s, d, "documents")),
    "op7_toxicity": lambda s, d: toxicity.op7(table(s, d, "documents"), table(s, d, "labels")),
    "op8_html_consensus": lambda s, d: html.op8(table(s, d, "pages")),
    "op9_mixing": lambda s, d: mixing.op9(table(s, d, "documents")),
    "op10_byte_bpe": lambda s, d: bpe.op10(table(s, d, "documents")),
    "op11_license_scans": lambda s, d: licenses.op11(table(s, d, "documents")),
    "op12_centroid_clusters": lambda s, d: clusters.op12(table(s, d, "embeddings")),
    "op13_hard_negatives": lambda s, d: negatives.op13(table(s, d, "embeddings")),
}

SQL = {"op5_chat_perspectives": chat.SQL, "op11_license_scans": licenses.SQL, "op12_centroid_clusters": clusters.SQL, "op13_hard_negatives": negatives.SQL}

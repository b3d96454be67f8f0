"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quillon.llm import bpe, html_extract, langid, lm_scoring, media, ngram_join, packing, pii, quality, secrets, trie, warc, whitening


def queries() -> dict:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_quality": quality.op3_quality,
        "op4_langid": langid.op4_langid,
        "op5_bpe": bpe.op5_bpe,
        "op6_media": media.op6_media,
        "op7_warc": warc.op7_warc,
        "op8_pii": pii.op8_pii,
        "op9_packing": packing.op9_packing,
        "op10_secrets": secrets.op10_secrets,
        "op11_whitening": whitening.op11_whitening,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_html": html_extract.op13_html,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc": warc.OP7_SQL,
        "op12_prefix_trie": trie.OP12_SQL,
        "op13_html": html_extract.OP13_SQL,
    }

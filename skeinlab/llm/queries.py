"""The queries of this subpackage and the SQL that gives the same rows, for __spark_entry__."""

from __future__ import annotations

from skeinlab.llm import align, bpe, exact_dedup, fingerprints, html_text, langid, merkle, mixing, ngram_join, phrases, revisits, token_store, transcripts

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_revisits": revisits.op3_revisits,
    "op4_language_id": langid.op4_language_id,
    "op5_html_text": html_text.op5_html_text,
    "op6_transcripts": transcripts.op6_transcripts,
    "op7_token_store": token_store.op7_token_store,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_align": align.op11_align,
    "op12_merkle": merkle.op12_merkle,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES = {
    "op3_revisits": revisits.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_align": align.op11_align,
    "op12_merkle": merkle.ORACLE,
}

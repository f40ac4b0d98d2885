"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from rankwell.llm import bpe, collocations, conversation_trie, exact_dedup, html_crf, language_id, lexicon_bpe, mixing, near_vectors, passages, simhash, toxicity, warc_zip

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language_id": language_id.op2_language_id,
    "op3_html_text": html_crf.op3_html_text,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_passages": passages.op7_passages,
    "op8_near_vectors": near_vectors.op8_near_vectors,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_warc": warc_zip.op10_warc,
    "op11_lexicon_bpe": lexicon_bpe.op11_lexicon_bpe,
    "op12_collocations": collocations.op12_collocations,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_near_vectors": near_vectors.ORACLE,
    "op10_warc": warc_zip.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}

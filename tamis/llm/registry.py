"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from tamis.llm import chat, context_mixing, embeddings, fingerprints, language_id, licenses, mixing, sentencepiece, simhash, token_files

QUERIES = {f.__name__: f for f in (
    language_id.op1_language_id, simhash.op2_simhash, sentencepiece.op3_sentencepiece, mixing.op4_mixing, chat.op5_chat_format,
    embeddings.op6_embedding_dedup, context_mixing.op7_context_mixing, fingerprints.op8_fingerprints, token_files.op9_token_files,
    licenses.op10_license_scan)}

ORACLES = {"op4_mixing": mixing.OP4_SQL, "op5_chat_format": chat.OP5_SQL, "op6_embedding_dedup": embeddings.OP6_SQL}

"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from . import bpe, conversations, decontaminate, embeddings, licenses, secrets, sharding, simhash, spelling, token_counts, token_store, toxicity, warc


def queries() -> dict:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_warc": warc.op2_warc,
        "op3_licenses": licenses.op3_licenses,
        "op4_embedding_dedup": embeddings.op4_embedding_dedup,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_secrets": secrets.op8_secrets,
        "op9_simhash": simhash.op9_simhash,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_spelling": spelling.op11_spelling,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.OP2_SQL,
        "op3_licenses": licenses.oracle(),
        "op4_embedding_dedup": embeddings.OP4_SQL,
        "op8_secrets": secrets.OP8_SQL,
        "op10_token_counts": token_counts.OP10_SQL,
        "op11_spelling": spelling.OP11_SQL,
        "op12_conversation_repair": conversations.OP12_SQL,
        "op13_sharding": sharding.OP13_SQL,
    }

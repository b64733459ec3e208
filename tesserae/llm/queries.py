"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, langid, lm, quality, secrets, simhash, token_counts, toxicity

QUERIES = {
    "op8_lm": lm.op8_lm,
    "op2_langid": langid.op2_langid,
    "op6_toxicity": toxicity.op6_toxicity,
    "op1_secrets": secrets.op1_secrets,
    "op7_quality": quality.op7_quality,
    "op3_chat": chat.op3_chat,
    "op4_token_counts": token_counts.op4_token_counts,
    "op9_bpe": bpe.op9_bpe,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op10_simhash": simhash.op10_simhash,
}

#: Further results of these operators, registered beside them.
MORE = {"op5_near": decontaminate.op5_near}

ORACLES: dict[str, str] = {"op3_chat": chat.OP3_SQL, "op5_decontaminate": decontaminate.OP5_SQL}

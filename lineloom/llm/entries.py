"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, licenses, neardup, packing, quality, search, secrets, sharding, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_sharding": sharding.op2_sharding,
    "op3_licenses": licenses.op3_licenses,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_packing": packing.op5_packing,
    "op6_search": search.op6_search,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": neardup.op8_simhash,
    "op9_secrets": secrets.op9_secrets,
    "op10_chat": chat.op10_chat,
}

SQL: dict[str, str] = {"op3_licenses": licenses.SQL, "op4_decontaminate": decontaminate.SQL, "op10_chat": chat.SQL}

"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import chat, codes, decontaminate, embeddings, language_model, lines, minhash, mixing, packing, ranking, secret_scan, toxicity, urls


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_chat": chat.op2_chat,
        "op3_url_filter": urls.op3_url_filter,
        "op4_embeddings": embeddings.op4_embeddings,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_secrets": secret_scan.op8_secrets,
        "op9_minhash": minhash.op9_minhash,
        "op10_language_model": language_model.op10_language_model,
        "op11_ranking": ranking.op11_ranking,
        "op12_packing": packing.op12_packing,
        "op13_codes": codes.op13_codes,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express over whole tables at a bearable cost."""
    by_name = {"op2_chat": chat, "op3_url_filter": urls, "op4_embeddings": embeddings, "op5_decontaminate": decontaminate, "op6_line_dedup": lines, "op7_mixing": mixing, "op9_minhash": minhash, "op11_ranking": ranking, "op13_codes": codes}
    return {name: module.SQL for name, module in by_name.items()}

"""Driver queries of this subpackage and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_text, licenses, lines, merkle, pii, quality, simhash, spelling, substring, tokens

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_token_output": tokens.op2_token_output,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_chat_tool_calls": chat.op5_chat_tool_calls,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_pii": pii.op12_pii,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op5_chat_tool_calls": chat.OP5_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_substring_dedup": substring.OP9_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}

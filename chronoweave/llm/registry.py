"""The ten operators' queries and the SQL for those that SQL can express."""

from . import decontaminate, html_text, oracles, packing, pii, quality_model, quality_rules, secrets, simhash, substrings, token_binary

QUERIES = {
    "op1_token_files": token_binary.op1_token_files,
    "op2_pii": pii.op2_pii,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_secrets": secrets.op5_secrets,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_substrings": substrings.op8_substrings,
    "op9_packing": packing.op9_packing,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES: dict[str, str] = {"op3_quality_rules": oracles.QUALITY_RULES, "op4_decontaminate": oracles.DECONTAMINATE}

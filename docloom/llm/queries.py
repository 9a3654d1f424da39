"""The opN_<name> queries and, where SQL can express one on whole tables, its DuckDB SQL."""

from docloom.llm import audio, bpe, chat, jaccard, langid, packing, quality, secrets, substring, toxicity

QUERIES = {f.__name__: f for f in (audio.op1_audio_fingerprint, bpe.op2_bpe, secrets.op3_secret_scan, packing.op4_packing, langid.op5_language_id, quality.op6_quality_rules, toxicity.op7_toxicity, substring.op8_substring_dedup, chat.op9_chat_format, jaccard.op10_jaccard_join)}
ORACLES = {
    "op6_quality_rules": quality.ORACLE,
    "op8_substring_dedup": substring.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op10_jaccard_join": jaccard.ORACLE,
}

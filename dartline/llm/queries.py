"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from dartline.llm import decontaminate, jaccard, katz, langid, licenses, media, mixing, sharding, tokencount, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_language_id": langid.op2_language_id,
    "op3_media_columns": media.op3_media_columns,
    "op4_sharding": sharding.op4_sharding,
    "op5_lm_scoring": katz.op5_lm_scoring,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {
    "op1_ngram_jaccard_join": jaccard.OP1_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_license_scan": licenses.OP9_SQL,
}

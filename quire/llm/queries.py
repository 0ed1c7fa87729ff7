"""The registered query of each operator, and its SQL where there is one."""

from . import decontamination, jaccard, language, line_dedup, media, mixing, pii, secrets, sharding, toxicity, trie, vector_codes, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_sharding": sharding.op2_sharding,
    "op3_secrets": secrets.op3_secrets,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_language": language.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_media": media.op9_media,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_trie": trie.op11_trie,
    "op12_warc": warc.op12_warc,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op11_trie": trie.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}

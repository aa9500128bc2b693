"""The operators' queries over the tables of a folder, and SQL for those that it can express."""

from . import language, media, mixture, packing, pii, quality, simhash, substrings, topk, toxicity

QUERIES = {
    "op1_temperature_mixture": mixture.query,
    "op2_best_fit_packing": packing.query,
    "op3_cross_parsing_language": language.query,
    "op4_random_field_personal_data": pii.query,
    "op5_threshold_top_k": topk.query,
    "op6_simhash_bk_trees": simhash.query,
    "op7_local_descriptors": media.query,
    "op8_merged_transforms": substrings.query,
    "op9_boosted_toxicity": toxicity.query,
    "op10_random_indexing_quality": quality.query,
}
SQL = {"op1_temperature_mixture": mixture.SQL, "op5_threshold_top_k": topk.SQL}

"""The queries of this subpackage, and their SQL where SQL can express them."""

import corpus_pipeline

from . import bitplanes, decontaminate, exact_dedup, jaccard_join, language, mixing, packing, periodic, ppm, secrets, sharding, vector_codes, winnowing


def queries() -> dict:
    return {
        "op1_bit_planes": bitplanes.op1_bit_planes,
        "op2_pfair_mix": mixing.op2_pfair_mix,
        "op3_packing": packing.op3_packing,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_winnowing": winnowing.op5_winnowing,
        "op6_slots": sharding.op6_slots,
        "op7_ppm": ppm.op7_ppm,
        "op8_language_id": language.op8_language_id,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_decontaminate": decontaminate.op11_decontaminate,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_vector_codes": vector_codes.op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": exact_dedup.OP9_SQL, "op11_decontaminate": decontaminate.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}

"""Queries of this subpackage and their DuckDB SQL."""

from . import centroids, exact_dedup, filter_audit, fingerprint, language_id, mixing, near_join, near_vectors, packing, substring, toxicity, url_filter, warc


def queries():
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_mixing": mixing.op2_mixing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_substring": substring.op4_substring,
        "op5_warc": warc.op5_warc,
        "op6_near_join": near_join.op6_near_join,
        "op7_fingerprint": fingerprint.op7_fingerprint,
        "op8_language_id": language_id.op8_language_id,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_packing": packing.op10_packing,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_centroids": centroids.op12_centroids,
        "op13_near_vectors": near_vectors.op13_near_vectors,
    }


def oracle_sql():
    return {"op1_url_filter": url_filter.ORACLE, "op2_mixing": mixing.ORACLE, "op5_warc": warc.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_centroids": centroids.ORACLE, "op13_near_vectors": near_vectors.ORACLE}

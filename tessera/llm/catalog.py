"""Registered queries of the training-data operators."""
import corpus_pipeline

from . import bpe, decontaminate, exact_dedup, language_id, licenses, line_dedup, lm_score, near_dedup, secrets, token_counts


def queries():
    return {
        "op1_near_dedup": near_dedup.query,
        "op2_licenses": licenses.query,
        "op3_decontaminate": decontaminate.query,
        "op4_lm_score": lm_score.query,
        "op5_bpe": bpe.query,
        "op6_line_dedup": line_dedup.query,
        "op7_secrets": secrets.query,
        "op8_language_id": language_id.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_token_counts": token_counts.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op1_near_dedup": near_dedup.SQL, "op2_licenses": licenses.sql(), "op6_line_dedup": line_dedup.SQL, "op7_secrets": secrets.sql(), "op9_exact_dedup": exact_dedup.SQL}

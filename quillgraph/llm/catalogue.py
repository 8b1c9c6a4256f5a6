"""Queries and oracle SQL of the training-text operators."""

from __future__ import annotations

import corpus_pipeline
from quillgraph.llm import archive, bpe, exact, lines, lm, mixing, neardup, pii, quality, secrets

QUERIES = {
    "op1_warc_archives": archive.op1_warc_archives,
    "op2_pii_disclosure": pii.op2_pii_disclosure,
    "op3_lm_scores": lm.op3_lm_scores,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_quality_rules": quality.op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_warc_archives": archive.OP1_SQL,
    "op4_source_mix": mixing.OP4_SQL,
    "op6_exact_dedup": exact.OP6_SQL,
    "op8_near_duplicates": neardup.OP8_SQL,
    "op10_quality_rules": quality.OP10_SQL,
}

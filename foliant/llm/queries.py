"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from foliant.llm import op2_decontaminate, op3_warc, op5_secrets, op10_substring
from foliant.llm.op1_quality import op1_quality_classifier
from foliant.llm.op4_rules import op4_quality_rules
from foliant.llm.op6_bpe import op6_bpe
from foliant.llm.op7_toxicity import op7_toxicity
from foliant.llm.op8_lm import op8_lm_scoring
from foliant.llm.op9_jaccard import op9_jaccard_join

QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_decontaminate.op2_decontamination, op3_warc.op3_warc, op4_quality_rules, op5_secrets.op5_secret_scan, op6_bpe, op7_toxicity, op8_lm_scoring, op9_jaccard_join, op10_substring.op10_substring_dedup)
}
ORACLE: dict[str, str] = {"op2_decontamination": op2_decontaminate.SQL, "op3_warc": op3_warc.SQL, "op5_secret_scan": op5_secrets.sql(), "op10_substring_dedup": op10_substring.SQL}

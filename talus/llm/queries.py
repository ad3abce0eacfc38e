"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from talus.llm import decontamination, importance, mixing, neardup, negatives, phrases, secrets
from talus.llm.fingerprint import op7_fingerprint
from talus.llm.language import op4_language
from talus.llm.licenses import op6_license
from talus.llm.quality import op5_quality
from talus.llm.rules import op11_rules
from talus.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": secrets.op2_secrets,
    "op3_phrases": phrases.op3_phrases,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_license": op6_license,
    "op7_fingerprint": op7_fingerprint,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_neardup": neardup.op10_neardup,
    "op11_rules": op11_rules,
    "op12_importance": importance.op12_importance,
    "op13_negatives": negatives.op13_negatives,
}

SQL: dict[str, str] = {
    "op2_secrets": secrets.SQL,
    "op3_phrases": phrases.SQL,
    "op8_mixing": mixing.SQL,
    "op9_decontamination": decontamination.SQL,
    "op10_neardup": neardup.SQL,
    "op12_importance": importance.SQL,
    "op13_negatives": negatives.SQL,
}

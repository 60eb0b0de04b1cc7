"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import sql
from .cotraining import op10_quality_classifier
from .licenses import op3_licenses
from .media import op7_media
from .pieces import op5_sentencepiece
from .pii import op1_pii
from .quality_rules import op8_quality_rules
from .resampling import op13_importance_resampling
from .simhash import op2_simhash
from .spelling import op11_spelling_variants
from .token_files import op12_token_files
from .tokens import op6_best_fit_packing, op9_token_counts
from .toxicity import op4_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_media": op7_media,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_files": op12_token_files,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": sql.SPELLING_VARIANTS, "op13_importance_resampling": sql.IMPORTANCE_RESAMPLING}

"""Scalar column functions."""
from cohortlens.functions.scalars import (  # noqa: F401
    clean_numeric, encode_level, extract_level, nan_to_null, risk_tier,
    round_record_value, safe_float, strip_accents_upper, trend_label,
)

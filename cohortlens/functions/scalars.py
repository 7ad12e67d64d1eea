"""Scalar column functions (survey section 2.C).

All are native Catalyst expressions -- no Python UDFs -- so they stay inside
whole-stage codegen and work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as K

ColumnOrName = Column | str

# Upper-case accented letters folded to plain ASCII when matching level names.
_ACCENTED_UPPER = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
_PLAIN_UPPER = "AAAAAEEEEIIIIOOOOOUUUUCN"
_NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN -> NULL (Spark orders NaN above every number and averages it in)."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def strip_accents_upper(c: ColumnOrName) -> Column:
    """Upper-case and fold accents (precomposed and combining marks)."""
    up = F.upper(_c(c))
    return F.translate(F.regexp_replace(up, "[̀-ͯ]", ""), _ACCENTED_UPPER, _PLAIN_UPPER)


def extract_level(c: ColumnOrName) -> Column:
    """First of the four level names contained in the text, else NULL."""
    norm = strip_accents_upper(F.trim(_c(c)))
    expr = None
    for name in K.LEVEL_NAMES:
        key = name.upper().translate(str.maketrans(_ACCENTED_UPPER, _PLAIN_UPPER))
        cond = norm.contains(key)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def encode_level(c: ColumnOrName) -> Column:
    """Exact level name -> 0.0..3.0; anything else NULL."""
    c = _c(c)
    expr = None
    for name, code in K.LEVEL_CODES.items():
        cond = c == F.lit(name)
        val = F.lit(float(code))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def clean_numeric(c: ColumnOrName) -> Column:
    """C4: text with decimal comma -> double; unparsable -> NULL.

    Strict number pattern first, because Spark's cast also accepts forms
    such as '7.5d' that a plain number parser rejects.
    """
    s = F.replace(F.trim(_c(c).cast("string")), F.lit(","), F.lit("."))
    return nan_to_null(F.when(s.rlike(_NUMBER_RE), s.try_cast("double")))


def risk_tier(p: ColumnOrName) -> Column:
    """Probability -> ALTO / MEDIO / BAIXO."""
    p = _c(p)
    high, mid, low = K.RISK_LABELS
    return (F.when(p >= K.RISK_THRESHOLD_HIGH, F.lit(high))
            .when(p >= K.RISK_THRESHOLD_MEDIUM, F.lit(mid))
            .when(p.isNotNull(), F.lit(low)))


def trend_label(x: ColumnOrName) -> Column:
    """Slope -> crescendo / decrescendo / estável (NULL counts as 0)."""
    v = F.coalesce(_c(x).cast("double"), F.lit(0.0))
    up, down, flat = K.TREND_LABELS
    return (F.when(v > K.TREND_THRESHOLD, F.lit(up))
            .when(v < -K.TREND_THRESHOLD, F.lit(down))
            .otherwise(F.lit(flat)))


def safe_float(c: ColumnOrName, default: float = 0.0) -> Column:
    """NULL / unparsable -> default."""
    return F.coalesce(nan_to_null(_c(c).try_cast("double")), F.lit(float(default)))


def round_record_value(c: ColumnOrName, digits: int = 2) -> Column:
    """NaN and +/-Inf -> NULL, finite doubles rounded to ``digits``."""
    c = _c(c)
    finite = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(finite, F.round(c, digits))

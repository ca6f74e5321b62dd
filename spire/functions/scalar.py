"""Column-level numeric functions (F13, F15) and rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used by the reference's formulas.
MINMAX_EPS = 1e-8
L2_EPS = 1e-9
SCORE_DIGITS = 6


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def activation(logit, mask=None) -> Column:
    """``log(1 + relu(logit)) * mask``, in double precision."""
    out = F.log1p(F.greatest(_c(logit).cast("double"), F.lit(0.0)))
    return out if mask is None else out * _c(mask).cast("double")


def minmax_rescale(score, t_min, t_max, s_min, s_max, eps: float = MINMAX_EPS) -> Column:
    """map a teacher score onto the student's range of the same query."""
    return ((_c(score) - _c(t_min)) / (_c(t_max) - _c(t_min) + F.lit(eps))) \
        * (_c(s_max) - _c(s_min) + F.lit(eps)) + _c(s_min)


def rounded(col, digits: int = SCORE_DIGITS) -> Column:
    """Scores are compared and ordered on 6 decimals so float summation
    order never changes a rank.  Computed as ``round(x * 10^d) / 10^d`` on
    the binary value: ``round(x, d)`` would round the shortest decimal
    string of x half-up, which differs from SQL engines that scale first
    whenever x sits on a tie (e.g. 32.0415625)."""
    scale = float(10 ** digits)
    return F.round(_c(col).cast("double") * F.lit(scale)) / F.lit(scale)

"""Numeric column functions: rounding, squashing, units and guarded casts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors.
PSI_PER_FT_PER_PPG = 0.0518894
PSI_PER_FT_PER_SG = 0.433
PPG_PER_SG = 8.345
FEET_PER_METRE = 3.28084
BAR_PER_PSI = 0.0689476
LBFT_PER_KNM = 737.56
EULER_GAMMA = 0.5772156649


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def round_half_up(x, digits: int = 0) -> Column:
    """Decimal rounding with halves going up (towards +inf), unlike `round`, which sends -2.5 to -3."""
    p = float(10**digits)
    return F.floor(_c(x).cast("double") * p + F.lit(0.5)) / F.lit(p)


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def sigmoid(x) -> Column:
    """Logistic function. `exp` overflowing to infinity gives the right limit, so one branch serves both signs."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def log_loss(p, y) -> Column:
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), _c(p)))
    return F.when(_c(y) == 1, -F.log(p)).otherwise(-F.log(1 - p))


def finite(x) -> Column:
    """Null for null, NaN and the two infinities."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def number_or(text, default: float) -> Column:
    """Numeric cast; blank, unparsable or non-finite text gives the default."""
    return F.coalesce(finite(F.trim(_c(text)).try_cast("double")), F.lit(float(default)))


def parse_fraction(text) -> Column:
    """`9 5/8` -> 9.625; plain numbers pass through; anything else is null."""
    text = _c(text)
    pat = r"^(\d+)\s+(\d+)\s*/\s*(\d+)"
    whole, num, den = (F.regexp_extract(text, pat, i) for i in (1, 2, 3))
    mixed = whole.cast("double") + num.cast("double") / den.cast("double")
    return F.when(text.rlike(pat), mixed).otherwise(F.trim(text).try_cast("double"))


def circular(deg) -> tuple[Column, Column]:
    """Sine and cosine of an angle given in degrees."""
    rad = _c(deg) * F.lit(math.pi) / 180
    return F.sin(rad), F.cos(rad)


def average_path_length(n) -> Column:
    """Expected depth of an unsuccessful binary-tree search over n points."""
    n = _c(n).cast("double")
    return (
        F.when(n <= 1, F.lit(0.0))
        .when(n == 2, F.lit(1.0))
        .otherwise(2 * (F.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n)
    )


def gradient_to_ppg(psi_per_ft) -> Column:
    return _c(psi_per_ft) / PSI_PER_FT_PER_PPG


def ppg_to_gradient(ppg) -> Column:
    return _c(ppg) * PSI_PER_FT_PER_PPG


def gradient_to_sg(psi_per_ft) -> Column:
    return _c(psi_per_ft) / PSI_PER_FT_PER_SG


def ppg_to_psi(ppg, depth_ft) -> Column:
    return _c(ppg) * PSI_PER_FT_PER_PPG * _c(depth_ft)


def psi_to_ppg(psi, depth_ft) -> Column:
    d = _c(depth_ft)
    return F.when(d > 0, _c(psi) / (d * PSI_PER_FT_PER_PPG)).otherwise(F.lit(0.0))


def ppg_to_sg(ppg) -> Column:
    return _c(ppg) / PPG_PER_SG


def sg_to_ppg(sg) -> Column:
    return _c(sg) * PPG_PER_SG


def metres_to_feet(m) -> Column:
    return _c(m) * FEET_PER_METRE


def feet_to_metres(ft) -> Column:
    return _c(ft) / FEET_PER_METRE


def psi_to_bar(psi) -> Column:
    return _c(psi) * BAR_PER_PSI


def knm_to_lbft(knm) -> Column:
    return _c(knm) * LBFT_PER_KNM


def psi_at_depth(ppg, depth_m) -> Column:
    return ppg_to_psi(ppg, metres_to_feet(depth_m))

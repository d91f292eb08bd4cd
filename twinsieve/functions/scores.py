"""Column arithmetic on detector scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN becomes NULL, so that a missing score is never the largest one."""
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def suspicion(p_safe: Column) -> Column:
    return F.lit(1.0) - p_safe


def logit_gap(logp_benign: Column, logp_injection: Column) -> Column:
    return logp_benign - logp_injection


def sigmoid(z: Column) -> Column:
    """Logistic function that never overflows."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(small / (F.lit(1.0) + small))


def injection_nll(z: Column, label: Column, temperature: Column | float) -> Column:
    """Binary log loss of the injection class at a temperature, per row."""
    x = -z / temperature
    softplus = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return softplus - label * x


def check_thresholds(theta_safe: float, theta_unsafe: float) -> None:
    if not 0.0 <= theta_unsafe < theta_safe <= 1.0:
        raise ValueError(
            f"thresholds must satisfy 0 <= unsafe < safe <= 1, got {theta_unsafe} and {theta_safe}"
        )


def route(p_safe: Column, theta_safe: float, theta_unsafe: float) -> Column:
    """``pass`` at or above the safe bound, ``block`` at or below the unsafe one, else ``escalate``."""
    check_thresholds(theta_safe, theta_unsafe)
    return (
        F.when(p_safe >= F.lit(theta_safe), "pass")
        .when(p_safe <= F.lit(theta_unsafe), "block")
        .otherwise("escalate")
    )


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def int_label(raw: Column) -> Column:
    """Three spellings of the label to 0 or 1; anything else stops the job."""
    text = raw.cast("string")
    return (
        F.when(text.isin("safe", "benign", "0"), F.lit(0))
        .when(text.isin("unsafe", "injection", "injected", "1"), F.lit(1))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(text, F.lit("null")))).cast("int"))
        .cast("long")
    )

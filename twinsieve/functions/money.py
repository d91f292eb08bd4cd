"""Cost expressions: GPU time, dollars, memory and compute of a detector, and the cascade's cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GPU_HOURLY_USD = 1.20
SECONDS_PER_HOUR = 3600.0
VRAM_OVERHEAD = 1.2

# Parameters, number type and bytes per parameter of the known detectors.
PROFILES = [
    ("promptguard2_86m", 86_000_000, "fp32", 4.0),
    ("protectai_deberta_v2", 184_000_000, "fp32", 4.0),
    ("datasentinel_7b", 7_240_000_000, "nf4", 0.55),
    ("qwen2.5-1.5b", 1_540_000_000, "bf16", 2.0),
    ("llama3.2-1b", 1_240_000_000, "bf16", 2.0),
    ("granite-guardian-2b", 2_530_000_000, "bf16", 2.0),
]


def not_negative(x: Column, name: str) -> Column:
    """The value itself; a negative one stops the job and a missing one stays missing."""
    return F.when(x < 0, F.raise_error(F.lit(f"{name} must not be negative")).cast("double")).otherwise(x)


def gpu_seconds_per_1k(ms: Column) -> Column:
    return not_negative(ms, "latency").cast("double")


def usd_per_million(ms: Column, hourly: float = GPU_HOURLY_USD) -> Column:
    if hourly < 0:
        raise ValueError("the hourly price must not be negative")
    return not_negative(ms, "latency") / F.lit(1000.0) * F.lit(1e6) / F.lit(SECONDS_PER_HOUR) * F.lit(hourly)


def vram_gb(params: Column, bytes_per_param: Column) -> Column:
    return params * bytes_per_param * F.lit(VRAM_OVERHEAD) / F.lit(1e9)


def flops(params: Column, tokens: int) -> Column:
    return F.lit(2.0) * params * F.lit(tokens)


def expected_ms(k1: Column, k2: Column, e: Column) -> Column:
    """Per-request cost ``k1 + e * k2``; the share must lie in [0, 1]."""
    share = F.when((e < 0) | (e > 1), F.raise_error(F.lit("escalation rate outside [0, 1]")).cast("double")).otherwise(e)
    return not_negative(k1, "k1") + share * not_negative(k2, "k2")


def break_even(k1: Column, k2: Column) -> Column:
    return F.lit(1.0) - F.try_divide(k1, k2)


def reduction(k1: Column, k2: Column, e: Column) -> Column:
    return F.lit(1.0) - F.try_divide(expected_ms(k1, k2, e), k2)

"""Uniform numbers from md5: equal at any partitioning, and in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F


def uniform(seed: int, step: int | str, id_col="id"):
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int, step: int | str, col: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{step}:' || {col}), 1, 8) AS BIGINT) / 4294967296.0)"


def ceil3(load: int, cap: int) -> float:
    """load / cap rounded up to three decimals, in whole numbers."""
    return (-(-1000 * load // cap) / 1000.0) if cap > 0 else 0.0


def ceil3_decimal(load: int, cap: int) -> float:
    """The same on the exact binary value of the quotient."""
    from decimal import ROUND_CEILING, Decimal

    return float(Decimal(load / cap).quantize(Decimal("0.001"), rounding=ROUND_CEILING)) if cap > 0 else 0.0

"""Rates, scores and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part, whole, digits: int = 4) -> Column:
    """part / whole, rounded; null where whole is 0 or null."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.round(F.when(whole != 0, part.cast("double") / whole.cast("double")), digits)


def percentage(part, whole) -> Column:
    """Whole percent, halves to the even neighbour; null where whole is 0."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.bround(F.when(whole != 0, part.cast("double") * 100.0 / whole.cast("double")), 0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def wilson_low(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval of a rate; 0 without trials."""
    n = trials.cast("double")
    p = successes.cast("double") / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n))).otherwise(F.lit(0.0))


def shrunken_rate(successes: Column, trials: Column, prior: float = 0.5, strength: float = 2.0) -> Column:
    """Rate pulled to ``prior`` by ``strength`` imaginary trials."""
    return (successes.cast("double") + prior * strength) / (trials.cast("double") + strength)


def reliability(failures: Column, successes: Column, penalty: float = 0.2, recovery: float = 0.025, floor: float = 0.2) -> Column:
    return clamp(1.0 - penalty * failures.cast("double") + recovery * successes.cast("double"), floor, 1.0)


def priced(requests: Column, free: int, unit: int, price: float) -> Column:
    """Cost of what goes beyond a free allowance, in started units; null usage stays null."""
    return F.when(requests.isNotNull(), F.ceil(F.greatest(requests - free, F.lit(0)) / unit).cast("double") * price)


def failing(*conditions: tuple[Column, str]) -> Column:
    """The reasons whose conditions hold, in order; an empty array means ready.  A null condition fails closed."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(reason)) for c, reason in conditions]))

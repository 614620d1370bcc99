"""Scalar expressions over bars: shapes, clocks, classes, costs, paths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0
CLASSES = ["down", "neutral", "up"]

def price(name: str) -> Column:
    return F.col(f"bid_{name}")


def shapes() -> dict[str, Column]:
    O, H, L, C = (price(x) for x in ("open", "high", "low", "close"))  # noqa: E741, N806
    return {
        "candle_body_bps": BPS * (C - O) / O,
        "candle_range_bps": BPS * (H - L) / O,
        "upper_wick_bps": BPS * (H - F.greatest(O, C)) / O,
        "lower_wick_bps": BPS * (F.least(O, C) - L) / O,
        "close_position": F.coalesce(F.try_divide(C - L, H - L), F.lit(0.5)),
    }


def cyclic(name: str, value: Column, period: float) -> dict[str, Column]:
    angle = value * (2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def clock(ts: Column) -> dict[str, Column]:
    """Hour of the day with minutes, and weekday from Monday."""
    return cyclic("hour", F.hour(ts) + F.minute(ts) / 60.0, 24) | cyclic("weekday", F.weekday(ts).cast("double"), 7)


def sessions(ts: Column) -> dict[str, Column]:
    """Month and minute as angles, and flags of overlapping trading sessions by UTC hour."""
    hour = F.hour(ts)
    # fixed values: UTC hours of the sessions
    spans = {"asia": (0, 8), "europe": (7, 16), "us": (13, 22), "overlap": (13, 16)}
    flags = {f"session_{k}": ((hour >= a) & (hour < b)).cast("double") for k, (a, b) in spans.items()}
    return cyclic("month", (F.month(ts) - 1).cast("double"), 12) | cyclic("minute", F.minute(ts).cast("double"), 60) | flags


def session_bucket(ts: Column) -> Column:
    """Disjoint buckets by UTC hour, for trades; their bounds and names are fixed values."""
    hour = F.hour(ts)
    return F.when(hour < 7, "00-07_UTC").when(hour < 13, "07-13_UTC").when(hour < 21, "13-21_UTC").otherwise("21-24_UTC")


def return_class(bps: Column, threshold: float) -> Column:
    return F.when(bps < -threshold, "down").when(bps > threshold, "up").when(bps.isNotNull(), "neutral")


def class_id(c: Column) -> Column:
    return F.when(c == "down", 0).when(c == "neutral", 1).when(c == "up", 2)


def likeliest(down: Column, neutral: Column, up: Column) -> Column:
    """The class of the largest probability; ties go down, neutral, up."""
    return F.when((down >= neutral) & (down >= up), "down").when(neutral >= up, "neutral").otherwise("up")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function from elementary functions, to about 1.5e-7."""
    # fixed values: the coefficients of the rational approximation of the error function
    t = 1 / (1 + 0.3275911 * F.abs(x) / math.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x / 2)
    return F.when(x >= 0, 1 - half).otherwise(half)


def class_probabilities(mean: Column, sigma: float, threshold_bps: float) -> dict[str, Column]:
    """Class probabilities of a normal arithmetic return (bps) with bounds that match log-return thresholds."""
    low, high = (math.expm1(s * threshold_bps / BPS) * BPS for s in (-1, 1))
    down, up = normal_cdf((F.lit(low) - mean) / sigma), 1 - normal_cdf((F.lit(high) - mean) / sigma)
    raw = [F.greatest(p, F.lit(1e-12)) for p in (down, 1 - down - up, up)]
    total = raw[0] + raw[1] + raw[2]
    return {f"p_{c}": p / total for c, p in zip(CLASSES, raw, strict=True)}


def pinball(q: float, error: Column) -> Column:
    return F.greatest((q - 1) * error, q * error)


def huber(error: Column, delta: float) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))


def path_parts(previous_close: Column, o: Column, h: Column, low: Column, c: Column) -> list[Column]:
    """Gap, body, upper and lower wick of a bar in log bps."""
    ln = F.log
    return [BPS * (ln(o) - ln(previous_close)), BPS * (ln(c) - ln(o)), F.greatest(BPS * (ln(h) - ln(F.greatest(o, c))), F.lit(0.0)), F.greatest(BPS * (ln(F.least(o, c)) - ln(low)), F.lit(0.0))]


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rebuilt_bar(previous_close: Column, gap: Column, body: Column, upper: Column, lower: Column, clip: float = 5000.0) -> tuple[Column, Column, Column, Column]:
    """Open, high, low, close from log-bps parts, each clipped."""
    o = previous_close * F.exp(clipped(gap, -clip, clip) / BPS)
    c = o * F.exp(clipped(body, -clip, clip) / BPS)
    return o, F.greatest(o, c) * F.exp(clipped(upper, 0.0, clip) / BPS), F.least(o, c) * F.exp(-clipped(lower, 0.0, clip) / BPS), c

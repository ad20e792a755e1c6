"""Nice bin edges as in the public Vega documentation of its ``bin`` transform."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Bins:
    start: float
    stop: float
    step: float


def nice_bins(low: float, high: float, maxbins: int = 40) -> Bins:
    """At most ``maxbins`` equal steps of 1, 2 or 5 times a power of ten that cover ``[low, high]``."""
    span = (high - low) or abs(low) or 1.0
    step = 10.0 ** (math.floor(math.log10(span) + 0.5) - math.ceil(math.log10(maxbins)))
    while math.ceil(span / step) > maxbins:
        step *= 10.0
    for divisor in (5, 2):
        if span / (step / divisor) <= maxbins:
            step /= divisor
    decimals = 0 if step >= 1 else int(-math.log10(step)) + 1
    edge = math.floor(low / step + 10.0 ** (-decimals - 1)) * step
    start = edge - step if low < edge else edge
    stop = math.ceil(high / step) * step
    return Bins(start, stop if stop > start else start + step, step)

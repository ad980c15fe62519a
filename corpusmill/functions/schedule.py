"""Learning rate as a column of the optimizer step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_cosine(step: Column, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear rise over ``warmup`` steps, then half a cosine down to ``floor`` at ``total``."""
    share = (step - F.lit(warmup)) / F.lit(float(max(total - warmup, 1)))
    falling = F.lit(floor) + (F.cos(share * math.pi) + 1.0) * (0.5 * (peak - floor))
    rate = F.when(step >= total, F.lit(float(floor))).otherwise(falling)
    if warmup <= 0:
        return rate
    return F.when(step < warmup, F.lit(float(peak)) * (step + 1) / F.lit(float(warmup))).otherwise(rate)

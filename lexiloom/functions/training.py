"""Closed formulas of the training layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, steps: int, warmup: int, peak: float, least_ratio: float) -> Column:
    """Linear warmup to the peak at step ``warmup``, then a cosine down to ``least_ratio`` of it at step ``steps``."""
    up = F.lit(peak) * step / F.lit(max(warmup, 1))
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(steps - warmup, 1))))
    down = F.lit(peak) * (F.lit(least_ratio) + F.lit(1 - least_ratio) * (1 + F.cos(F.pi() * progress)) / 2)
    return F.when((F.lit(warmup) > 0) & (step < warmup), up).otherwise(down)


def parameter_count(vocabulary: int, width: int, layers: int, heads: int, kv_heads: int, inner: int) -> int:
    """Parameters of a decoder with tied embeddings, grouped attention, gated feed-forward and two norms a layer."""
    if heads <= 0 or kv_heads <= 0 or width % heads or heads % kv_heads:
        raise ValueError("the width must be a multiple of the heads, and the heads of the key-value heads")
    kv = width // heads * kv_heads
    return vocabulary * width + layers * (2 * width * width + 2 * width * kv + 3 * width * inner + 2 * width) + width


def clip_scale(norm: Column, maximum: float) -> Column:
    """What gradients are scaled by so that their global norm is at most ``maximum``; null for a norm that isn't finite."""
    fine = norm.isNotNull() & ~F.isnan(norm) & (norm != float("inf"))
    return F.when(fine, F.when(norm > maximum, F.lit(float(maximum)) / (norm + 1e-12)).otherwise(1.0))


def accepts(initial_f: Column, current_web: Column, current_f: Column, next_web: Column, next_f: Column, gain: float = 1e-4, slack: float = 1.02) -> Column:
    """Whether a candidate replaces the current model: better on web text, no worse than ``slack`` on the foundation.

    Scores that are null, NaN or infinite are not accepted.
    """
    finite = F.lit(True)
    for c in (initial_f, current_web, current_f, next_web, next_f):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    better = (next_web + gain < current_web) & (next_f <= current_f * slack) & (next_f <= initial_f * slack)
    return F.coalesce(finite & better, F.lit(False))

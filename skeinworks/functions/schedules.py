"""What changes in the course of training: progress, ratios, rates, weights of objectives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the objectives and the progress between which some are phased in (fixed values).
BASE_WEIGHTS = {
    "next_action": 0.15, "next_observation": 0.20, "future_from_past": 0.10, "full_completion": 0.10, "inverse_dynamics": 0.15,
    "retrodiction": 0.10, "intermediate_imputation": 0.10, "observation_denoising": 0.05, "goal_conditioned_action": 0.05,
}
WARMUP = {"inverse_dynamics": (0.1, 0.4), "retrodiction": (0.2, 0.5), "intermediate_imputation": (0.2, 0.5), "observation_denoising": (0.3, 0.6)}


def progress(step: Column, steps: int) -> Column:
    return step / F.lit(float(max(1, steps - 1)))


def target_ratio(p: Column, start: float = 0.10, end: float = 0.60) -> Column:
    """The curriculum: from ``start`` to ``end``, progress held within 0 and 1."""
    return F.lit(start) + F.lit(end - start) * F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def mask_rate(p: Column, start: float, end: float | None = None) -> Column:
    """A constant rate, or one that changes with progress, which is not held within bounds."""
    return F.lit(start) if end is None else F.lit(start) + F.lit(end - start) * p


def gate(p: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high`` on, linear between."""
    return F.when(p <= low, 0.0).when(p >= high, 1.0).otherwise((p - F.lit(low)) / F.lit(high - low))


def objective_weights(p: Column) -> dict[str, Column]:
    return {name: F.lit(w) * gate(p, *WARMUP[name]) if name in WARMUP else F.lit(w) for name, w in BASE_WEIGHTS.items()}


def drawn_objective(p: Column, u: Column) -> Column:
    """The first objective at which the running total of the weights reaches ``u`` times their sum."""
    weights = objective_weights(p)
    total = sum(weights.values(), F.lit(0.0))
    upto, found, sums = F.lit(0.0), F.lit(None).cast("string"), []
    for name, w in weights.items():
        upto = upto + w
        sums.append((name, upto))
    for name, upto in reversed(sums):
        found = F.when(u * total <= upto, F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(sums[-1][0]))


def loss_weight(t: Column) -> Column:
    return F.least(F.lit(50.0), F.lit(1.0) / F.greatest(t, F.lit(0.01)))


def noise_level(u: Column) -> Column:
    return F.lit(0.001) + u * F.lit(0.998)

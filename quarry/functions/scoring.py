"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import schemas


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def structural(relationship, confidence, depth) -> Column:
    """Weight of the relationship, halved for each level beyond the first."""
    weight = F.lit(0.5)
    for name, w in schemas.RELATIONSHIPS.items():
        weight = F.when(_c(relationship) == name, w).otherwise(weight)
    return clamp(weight * _c(confidence) / F.pow(F.lit(2.0), _c(depth) - 1))


def semantic(distance) -> Column:
    return clamp(1 - _c(distance))


def evolutionary(frequency, recency, most: int = schemas.MAX_FREQUENCY) -> Column:
    value = 0.75 * F.least(_c(frequency) / most, F.lit(1.0)) + 0.25 * clamp(recency)
    return F.when(F.coalesce(_c(frequency), F.lit(0)) <= 0, 0.0).otherwise(value)


def fuse(s, m, e, weights: dict[str, float] = schemas.WEIGHTS) -> Column:
    """Weighted sum; without an evolutionary signal the other weights are scaled up."""
    ws, wm, we = weights["structural"], weights["semantic"], weights["evolutionary"]
    two = (ws * _c(s) + wm * _c(m)) / (ws + wm) if ws + wm else F.lit(0.0)
    return clamp(F.when(F.abs(_c(e)) < 1e-9, two).otherwise(ws * _c(s) + wm * _c(m) + we * _c(e)))


def rrf(rank) -> Column:
    """rank counts from 0."""
    return 1.0 / (schemas.RRF + _c(rank))


def kind_boost(kind) -> Column:
    k = _c(kind)
    return F.when(k.isin("function", "class"), 1.5).when(k == "method", 1.3).when(k == "variable", 0.5).otherwise(1.0)


def match_weight(match) -> Column:
    return F.when(_c(match) == "exact", 3.0).when(_c(match) == "method_suffix", 2.2).otherwise(0.45)


def line_weight(match, symbol_weight) -> Column:
    return F.greatest(_c(symbol_weight), F.lit(1.0)) * F.when(_c(match) == "exact_phrase", 2.0).when(_c(match) == "ordered_tokens", 1.4).otherwise(1.0)


def normalised(score, most) -> Column:
    """Divided by the best score, or by the least one that counts as good."""
    floor = 1.5 / schemas.RRF + 1.0 / schemas.RRF
    return F.when(_c(most) <= 0, _c(score)).otherwise(F.least(_c(score) / F.greatest(_c(most), F.lit(floor)), F.lit(1.0)))


def generic_target(name) -> Column:
    return F.element_at(F.split(_c(name), "\\."), -1).isin(*schemas.GENERIC_TARGETS)

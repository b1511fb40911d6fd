"""Scalar maps as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def forgetting(score: Column, least: float, most: float, sensitivity: float, scale: float = 1.0) -> Column:
    """Memory factor that falls from most to least as a score rises."""
    return clip(least + (most - least) * F.exp(-sensitivity * score / scale), least, most)


def excess_forgetting(score: Column, threshold: float, least: float, most: float, sensitivity: float) -> Column:
    """The same, of what a score has above its threshold."""
    return forgetting(F.greatest(F.lit(0.0), score - threshold), least, most, sensitivity)


def position(prediction: Column, scale: float = 1.0, limit: float = 1.0) -> Column:
    return clip(prediction / scale, -limit, limit)


def _sides(split: float, above: bool = True):
    """-1 or 1 by where a number stands; a number at the split counts as above, or below."""
    return lambda x: F.when(x < split if above else x <= split, -1.0).otherwise(1.0)


def _chances(x: Column) -> Column:
    """Labels of 0 and 1 as sides, probabilities between as twice their distance from one half, anything else as it is."""
    return F.when((x > 0) & (x < 1), 2 * x - 1).when(x.isin(0.0, 1.0), 2 * x - 1).otherwise(x)


#: How a number is read under each mode, by the kind of the training labels' classes; as it is where nothing is said.
_READINGS = {
    ("label", "binary"): lambda classes: _sides(0.5),
    ("label", "signed"): lambda classes: F.signum,
    ("label", "pair"): lambda classes: _sides(min(classes), above=False),
    ("label", "none"): lambda classes: F.signum,
    ("auto", "binary"): lambda classes: _chances,
    ("auto", "signed"): lambda classes: F.signum,
}
_CLASSES = {(0.0, 1.0): "binary", (-1.0, 1.0): "signed"}
MODES = ("auto", "position", "signal", "label", "raw")


def mapped_position(raw: Column, mode: str = "auto", classes: tuple[float, ...] | None = None, most: float = 1.0, short: bool = True) -> Column:
    """A prediction as a position under one of five modes, see _READINGS; null, NaN and infinity stand for no position."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    kind = "none" if classes is None else _CLASSES.get(tuple(sorted(classes)), "pair" if len(classes) == 2 else "many")
    read = _READINGS.get((mode, kind), lambda classes: lambda x: x)(classes)
    known = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    return F.when(known, clip(read(raw), -abs(most) if short else 0.0, abs(most))).otherwise(0.0)


def cost_rate(transaction: float = 0.0, slippage: float = 0.0, basis_points: float = 0.0) -> float:
    return transaction + slippage + basis_points / 1e4


def signature_dimension(d: int, depth: int) -> int:
    return sum(d**k for k in range(depth + 1))


def transport_weight(displacement: Column, least: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(1.0), F.exp(-displacement)))


def radius(score: Column, floor: float, slope: float, most: float) -> Column:
    return clip(floor + slope * score, floor, most)


def spectral_entropy(values: Column, floor: float = 1e-15) -> Column:
    """Entropy of the positive values' shares over its maximum, for an array column."""
    live = F.filter(values, lambda v: v > floor)
    total = F.aggregate(live, F.lit(0.0), lambda a, v: a + v)
    raw = F.aggregate(live, F.lit(0.0), lambda a, v: a - v / total * F.log(v / total))
    return F.when(F.size(live) < 2, 0.0).otherwise(clip(raw / F.log(F.size(live)), 0.0, 1.0))


def score_difference(challenger: Column, incumbent: Column, bound: float) -> Column:
    """Bounded score in [-1, 1] of two utilities; where both overflow the same way they are equal."""
    gap = F.when(challenger == incumbent, 0.0).otherwise(challenger - incumbent)
    return clip(gap, -bound, bound) / bound

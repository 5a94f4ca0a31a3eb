"""Column expressions on positions. Positions are voxels, distances micrometres."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
#: Micrometres of a voxel along z, y, x.
SCALE = {"z": 1.625, "y": 0.40625, "x": 0.40625}


def um(a: str, b: str, axis: str) -> Column:
    """Component from point a to point b; points are column prefixes."""
    return (F.col(f"{b}{axis}") - F.col(f"{a}{axis}")) * SCALE[axis]


def distance(a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [um(a, b, c) * um(a, b, c) for c in AXES]))


def dot(a: str, p: str, b: str) -> Column:
    return reduce(lambda s, t: s + t, [um(p, a, c) * um(p, b, c) for c in AXES])


def angle(a: str, p: str, b: str) -> Column:
    """Degrees at p between a and b; null where an arm has no length."""
    norms = distance(p, a) * distance(p, b)
    return F.when(norms > 1e-8, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, p, b) / norms)))))


def mirror_distance(p: str, d1: str, d2: str) -> Column:
    """Distance of d2 from the mirror image of d1 at p."""
    parts = [(F.col(f"{d2}{c}") - (F.lit(2.0) * F.col(f"{p}{c}") - F.col(f"{d1}{c}"))) * SCALE[c] for c in AXES]
    return F.sqrt(reduce(lambda s, t: s + t, [d * d for d in parts]))


def clean_probability(p: Column) -> Column:
    """A learned score as a probability: null and NaN are 0, values outside [0, 1] are logits."""
    logit = 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), p))))
    return F.when(p.isNull() | F.isnan(p), 0.0).when((p < 0) | (p > 1), logit).otherwise(p)


def written(c: Column) -> Column:
    """A coordinate as it is written: half to even, never negative."""
    return F.greatest(F.lit(0), F.bround(c).cast("long"))

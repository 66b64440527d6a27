"""The colour gate as an expression over two (h, s, v) triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import STRICT_D, Gate


def hue_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def gate(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], tolerance: Gate) -> Column:
    """Whether two mean colours are alike; pairs of low saturation are compared by brightness."""
    (h1, s1, v1), (h2, s2, v2) = a, b
    gray = (
        (F.abs(v1 - v2) <= tolerance.value)
        & (F.abs(v1 * (1.0 - s1) - v2 * (1.0 - s2)) <= tolerance.achroma)
        & (F.abs(s1 - s2) <= tolerance.low_saturation_step)
    )
    colour = (hue_difference(h1, h2) <= tolerance.hue) & (F.abs(s1 - s2) <= tolerance.saturation)
    return F.when(F.greatest(s1, s2) < tolerance.low_saturation, gray).otherwise(colour)


def passes(hsv_a: Column, hsv_b: Column, d_p: Column, rescue: Column, tolerance: Gate, missing_fails: bool = False) -> Column:
    """The funnel's colour stage: strict matches pass, rescued ones need similar brightness, others the gate.

    A missing colour counts as black, or fails where ``missing_fails``.
    """
    zero = F.lit(0.0)
    a, b = (tuple(F.coalesce(x[c].cast("double"), zero) for c in "hsv") for x in (hsv_a, hsv_b))
    alike = F.when(rescue, F.abs(a[2] - b[2]) <= tolerance.rescue_value).otherwise(gate(a, b, tolerance))
    known = hsv_a.isNotNull() & hsv_b.isNotNull() if missing_fails else F.lit(True)
    return (d_p <= STRICT_D) | (known & alike)

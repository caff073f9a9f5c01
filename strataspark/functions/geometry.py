"""Column functions for orientations, rounding and colour classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of fracture classes, their order of preference, and colours (blue, green, red).
CLASSES = ("filled", "unfilled", "cemented", "halffilled")
COLOURS = {
    "filled": ((0, 0, 128), (0, 0, 255)),
    "unfilled": ((0, 128, 0), (0, 255, 0)),
    "cemented": ((0, 128, 128), (0, 255, 255)),
    "halffilled": ((128, 0, 0), (255, 0, 0)),
}
COLOUR_TOLERANCE = 10


def normal_of(azimuth_deg: Column, dip_deg: Column) -> tuple[Column, Column, Column]:
    """Unit normal (east, north, up) of a plane that dips `dip` towards `azimuth`; -0 becomes 0."""
    a, i = F.radians(azimuth_deg), F.radians(dip_deg)
    return F.sin(i) * F.sin(a) + 0.0, F.sin(i) * F.cos(a) + 0.0, F.cos(i) + 0.0


def orientation_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(azimuth in [0, 360], dip in [0, 90]) of a unit normal; azimuth is null for a horizontal plane.

    A normal that points down is turned up. From the axis to the west the azimuth is 360 - acos(north),
    so due north may come out as 360.
    """
    s = F.when(z < 0, -1.0).otherwise(1.0)
    flat = F.sqrt(x * x + y * y)
    north = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s * y / flat))
    azimuth = F.when(s * x > 0, F.degrees(F.acos(north))).otherwise(360.0 - F.degrees(F.acos(north)))
    dip = F.degrees(F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * z))))
    return F.when(flat > 1e-12, azimuth), dip


def colour_class(b: Column, g: Column, r: Column) -> Column:
    """Class of a colour within the tolerance of its dark or bright form, or null."""
    out = F.lit(None).cast("string")
    for name in reversed(CLASSES):
        hit = F.lit(False)
        for box in COLOURS[name]:
            near = F.lit(True)
            for c, v in zip((b, g, r), box, strict=True):
                near = near & c.between(v - COLOUR_TOLERANCE, v + COLOUR_TOLERANCE)
            hit = hit | near
        out = F.when(hit, name).otherwise(out)
    return out


def pair_coefficient(a: Column, b: Column) -> Column:
    """How far two classes widen a threshold: equal known 1.2, one cemented 0.6, filled with unfilled 0.8, else 1."""
    both = F.array_sort(F.array(a, b))
    return (
        F.when((a == b) & (a != "unknown"), 1.2)
        .when((a == "cemented") != (b == "cemented"), 0.6)
        .when(both == F.array(F.lit("filled"), F.lit("unfilled")), 0.8)
        .otherwise(1.0)
    )


def pair_weight(a: str, b: str) -> float:
    """pair_coefficient of two names, for use within tasks."""
    if a == b and a != "unknown":
        return 1.2
    if (a == "cemented") != (b == "cemented"):
        return 0.6
    return 0.8 if {a, b} == {"filled", "unfilled"} else 1.0


def half_even(x: Column) -> Column:
    """Round to a whole number, halves to the even one."""
    return F.rint(x).cast("long")


def truncated(x: Column) -> Column:
    """Whole part towards zero."""
    return x.cast("long")

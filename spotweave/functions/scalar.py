"""Column expressions: rounding, names, portable random numbers, densities, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(c: Column, digits: int = 4) -> Column:
    """Rounded half to even to so many significant digits; 0 and null stay."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when((c == 0) | F.isnan(c), c).otherwise(F.bround(c / power) * power)


def split_list(c: Column) -> Column:
    """The trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def cell_name(cell: Column, run_id: str, letter: str = "C") -> Column:
    """C<run>-<id>, empty for noise."""
    return F.when(cell > 0, F.concat(F.lit(f"{letter}{run_id}-"), cell.cast("string"))).otherwise("")


def is_noise(cell: Column, dtype: str) -> Column:
    """0, the empty name, and nothing are noise."""
    empty = cell == ("" if dtype == "string" else 0)
    return F.coalesce(empty, F.lit(True))


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 32 bits of an MD5."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(*parts) -> Column:
    """A standard normal number by Box and Muller, likewise."""
    u, v = uniform(*parts, "a"), uniform(*parts, "b")
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(2.0**-33)))) * F.cos(2 * math.pi * v)


def normal_pdf(x: Column, mean, sd) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (F.lit(math.sqrt(2 * math.pi)) * sd)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


# The D65 white point and the linear sRGB matrix for XYZ.
D65 = (0.95047, 1.0, 1.08883)
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def lab_to_hex(l: Column, a: Column, b: Column) -> Column:
    """#RRGGBB of a CIE-Lab colour, clipped to what a screen shows."""
    fy = (l + 16) / 116
    parts = (fy + a / 500, fy, fy - b / 200)
    xyz = [w * F.when(f > 6 / 29, F.pow(f, F.lit(3))).otherwise(3 * (6 / 29) ** 2 * (f - 4 / 29)) for w, f in zip(D65, parts)]
    channels = []
    for row in XYZ_TO_RGB:
        v = sum((m * c for m, c in zip(row, xyz)), F.lit(0.0))
        v = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        channels.append(F.lpad(F.hex(F.bround(clamp(v, 0, 1) * 255).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), *channels)

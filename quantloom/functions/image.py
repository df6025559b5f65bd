"""Doubles as whole numbers in the same order, so that they can be counted digit by digit.

The image of x is the 63-bit pattern of |x| (exponent, then mantissa) with the sign of x: equal doubles have equal images, larger ones larger images,
and -0.0 is 0.0. Both ways are exact arithmetic in column expressions: powers of two divide and multiply without rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52
_UNIT = float(1 << _BITS)
_LEAST, _MOST = -1022, 1023  # exponents of the normal doubles
_LARGEST = (2.0 - 2.0**-52) * 2.0**_MOST


def image(x: Column) -> Column:
    """Whole number in the order of the doubles ``x``; NULL for NULL and NaN."""
    x = F.nanvl(x, F.lit(None).cast("double"))
    two, a = F.lit(2.0), F.least(F.abs(x), F.lit(_LARGEST))
    rough = F.least(F.greatest(F.floor(F.log2(a)).cast("int"), F.lit(_LEAST)), F.lit(_MOST))
    # the logarithm is rounded, so next to a power of two it can be one off; subnormal numbers share the least exponent
    off = (a >= F.pow(two, rough + 1)).cast("int") - (a < F.pow(two, rough)).cast("int")
    e = F.greatest(rough + off, F.lit(_LEAST))
    size = (e + _MOST).cast("long") * F.lit(1 << _BITS) + ((a / F.pow(two, e) - 1) * _UNIT).cast("long") + (F.abs(x) > _LARGEST).cast("long")
    return size * (F.lit(1) - 2 * (x < 0).cast("int"))


def from_image(n: Column) -> Column:
    """The double whose image is ``n``."""
    b = F.abs(n)
    e, m = F.shiftrightunsigned(b, _BITS).cast("int"), b.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("double")
    size = (m / _UNIT + (e > 0).cast("int")) * F.pow(F.lit(2.0), F.greatest(e, F.lit(1)) - _MOST)
    return size * (F.lit(1) - 2 * (n < 0).cast("int"))

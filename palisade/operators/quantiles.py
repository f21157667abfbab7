"""Exact percentiles of a column, by one method at all sizes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import stored

#: Bits of a digit; a pass counts as many groups as a digit has values, so 65,536.
DIGIT = 16
_SIGN = -(2**63)


def ordered_image(value: Column) -> Column:
    """A whole number per double, in the same order when read without a sign; NaN comes last.

    The bits of a double grow with its size, so positive ones only get the sign bit set, and negative
    ones are turned over as a whole. Both zeros have one image."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseOR(F.lit(_SIGN)))


def _value_of(image: int) -> float:
    bits = image & (2**63 - 1) if image >> 63 else ~image & (2**64 - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _selected(images: DataFrame, rank: int) -> tuple[int, int]:
    """The image with this rank (from 0), and the rank after its last repetition."""
    known, below = 0, 0
    for place in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("u", place).bitwiseAND(F.lit(2**DIGIT - 1))
        inside = images
        if place + DIGIT < 64:
            inside = images.where(F.shiftrightunsigned("u", place + DIGIT) == known)
        counts = sorted(inside.groupBy(digit.alias("digit")).count().collect())
        for value, rows in counts:  # at most 65,536
            if below + rows > rank:
                known, upto = known << DIGIT | value, below + rows
                break
            below += rows
    return known, upto


def percentile(frame: DataFrame, value: Column | str, share: float) -> float | None:
    """The interpolated percentile; None without values.

    Radix selection over the order-preserving image of a double: a pass counts the rows by their next
    16 bits, the digit that holds the wanted rank is fixed, and after four passes one value is left.
    Each pass is a count with a partial aggregation, and what reaches the driver is a count per digit,
    whatever the size of the table and however its values are spread or repeated.
    """
    column = F.col(value) if isinstance(value, str) else value
    values = frame.select(column.cast("double").alias("v")).where("v is not null")
    images = stored(values.select(ordered_image(F.col("v")).alias("u")), "percentile")
    count = images.count()
    if not count:
        return None
    wanted = share * (count - 1)
    rank = int(wanted)
    first, upto = _selected(images, rank)
    second = first
    if upto <= rank + 1 < count:
        second, _ = _selected(images, rank + 1)
    low, high = _value_of(first), _value_of(second)
    return low if low == high else low + (high - low) * (wanted - rank)

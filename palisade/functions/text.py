"""Number formatting."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def three_decimals(value: Column) -> Column:
    """A double in [0, 1] with three decimals, rounded half to even on its exact binary value.

    ``format_string('%.3f')`` rounds the shortest decimal form instead, which differs near ties.
    Here the value is scaled by a power of two to an integer below 2^53, of which 1000 times
    still fits a BIGINT. Values below 2^-11 print as 0.000 whatever their last bits are.
    """
    halvings = reduce(add, [(value < 2.0**-n).cast("int") for n in range(1, 11)])
    bits = halvings + 53
    scaled = F.floor(value * F.pow(F.lit(2.0), bits)).cast("bigint") * 1000
    thousandths = F.call_function("shiftright", scaled, bits)
    half = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits - 1)
    rest = scaled - F.when(bits < 63, F.call_function("shiftleft", thousandths, bits)).otherwise(0)
    up = (rest > half) | ((rest == half) & (thousandths % 2 == 1))
    rounded = thousandths + up.cast("bigint")
    return F.format_string("%d.%03d", F.floor(rounded / 1000).cast("bigint"), rounded % 1000)

"""Sums of doubles that do not depend on the order of rows.

A double is cut at fixed binary places into limbs of 30 bits, which are summed as integers and put together at the end.
Integers add up the same in any order and in any number of partitions, so results are equal to the last bit; the cut
loses nothing of values from 2**-52 to below 2**45. Of smaller ones, what lies below 2**-105 is left out, in every row alike;
larger and infinite ones are added as they come. Limbs hold for more than 2**32 rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary place above the highest limb, bits of a limb, number of limbs.
TOP, BITS, LIMBS = 45, 30, 5


def _prefix(x: Column, place: int) -> Column:
    """x in units of 2 ** place without its fraction; exact, as a double has no more than 53 digits."""
    scaled = x * float(2.0**-place)
    return F.when(F.abs(scaled) < float(2**53), scaled.cast("long").cast("double")).otherwise(scaled)


def exact_sum(x: Column) -> Column:
    """The sum of ``x`` as an aggregate; NULL without any value, NaN with one."""
    small = F.abs(x) < float(2**TOP)
    kept = F.when(small, x)
    above, total = F.lit(0.0), None
    for i in range(LIMBS):
        place = TOP - BITS * (i + 1)
        prefix = _prefix(kept, place)
        limb = F.sum((prefix - above * float(2**BITS)).cast("long")).cast("double") * float(2.0**place)
        above = prefix
        total = limb if total is None else limb + total
    large = F.sum(F.when(~small, x))
    return F.when(F.count(x) > 0, F.coalesce(total, F.lit(0.0)) + F.coalesce(large, F.lit(0.0)))


def exact_mean(x: Column) -> Column:
    """The mean of the values of ``x`` that are not NULL."""
    return exact_sum(x) / F.count(x)

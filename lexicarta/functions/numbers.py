"""Functions of numbers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """A double at so many decimals as SQL engines round it: what it is as a binary number, shifted, goes to the nearest whole number.

    Spark's own round() takes a double's shortest decimal form instead, so 1.2345 at three decimals may differ in the last, and a
    zero there has no sign: here what is rounded to zero keeps its own.
    """
    scale = float(10**digits)
    shifted = x * scale
    whole = F.round(shifted, 0)
    signed = F.when(whole == 0, shifted * 0.0).otherwise(whole)
    return F.when(F.isnan(shifted) | (F.abs(shifted) == float("inf")), x).otherwise(signed / scale)

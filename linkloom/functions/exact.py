"""Rounding of doubles by their exact decimal value, half to even, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.urls import let

#: Beyond this size of the product, a double's neighbours lie further off than the digit asked for; a product with this factor splits a double into two halves of its digits.
WHOLE, SPLIT = 2.0**53, 134217729.0


def exact_round(value: Column, digits: int = 0) -> Column:
    """value rounded to so many decimal digits (0 to 22): to the nearest, and of two equally near the even one.

    What counts is the double's own value, not its shortest writing: 2.675 lies below the middle and becomes 2.67, and
    0.5 becomes 0. The product with the power of ten is kept exactly, as a double and its error, so no middle is taken
    for one that is none. Null, NaN and infinite values stay, and so do zeros' signs.
    """
    scale = F.lit(10.0**digits)

    def halves(x: Column) -> Column:
        high = lambda v: let(v * SPLIT, lambda c: c - (c - v))
        return let(high(x), lambda h: F.struct(x.alias("x"), (x * scale).alias("p"), h.alias("h"), (x - h).alias("l")))

    # the power of ten in two halves, by the same split
    c = 10.0**digits * SPLIT
    s_high = c - (c - 10.0**digits)
    s_low = 10.0**digits - s_high

    def rounded(v: Column) -> Column:
        error = v["l"] * s_low - (((v["p"] - v["h"] * s_high) - v["l"] * s_high) - v["h"] * s_low)
        below = F.floor(v["p"]).cast("double")
        return let(F.struct(v["x"].alias("x"), below.alias("below"), ((v["p"] - below - 0.5) + error).alias("side")), nearest)

    def nearest(v: Column) -> Column:
        even = v["below"] % 2 == 0
        # the error reaches half a unit where the product is odd and large
        n = F.when((v["side"] > 0) | ((v["side"] == 0) & ~even), v["below"] + 1).when((v["side"] == -1) & ~even, v["below"] - 1).otherwise(v["below"])
        return F.when(n == 0, v["x"] * 0.0).otherwise(n / scale)

    own = value.cast("double")
    small = ~F.isnan(own) & (F.abs(own) < WHOLE) & (F.abs(own * scale) < WHOLE)
    return F.when(small, let(own, lambda x: let(halves(x), rounded))).otherwise(own)

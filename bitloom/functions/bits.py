"""Integer and bit arithmetic as columns."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def covers(mask: Column, value: Column, minterm: Column) -> Column:
    """A cube (mask of fixed bits, their values) covers a minterm."""
    return minterm.bitwiseAND(mask) == value


def contains_cube(a_mask: Column, a_value: Column, b_mask: Column, b_value: Column) -> Column:
    """Cube a covers all of cube b."""
    return (a_mask.bitwiseAND(b_mask) == a_mask) & (b_value.bitwiseAND(a_mask) == a_value)


def bit_length(x: Column) -> Column:
    """Binary digits of a non-negative integer; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def ceil_log2(x: Column) -> Column:
    return F.when(x <= 1, 0).otherwise(bit_length(x - 1)).cast("int")


def bits_for_count(k: Column) -> Column:
    """Bits of an id among k symbols; one at least."""
    return F.greatest(F.lit(1), ceil_log2(k)).cast("int")


def trailing_zeros(x: Column) -> Column:
    """Trailing zero bits of a positive integer."""
    return F.bit_count(x.bitwiseAND(-x) - 1)


def zigzag(d: Column) -> Column:
    """Signed integers as unsigned ones: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.when(d >= 0, d * 2).otherwise(-d * 2 - 1)


def varint_length(x: Column) -> Column:
    """Bytes of a non-negative integer in 7-bit groups."""
    return F.greatest(F.lit(1), F.floor((bit_length(x) + 6) / 7)).cast("int")


@pandas_udf(StringType())
def float_bits(x: pd.Series) -> pd.Series:
    """The 32 bits of a single-precision number, sign first; null stays null."""
    bits = np.unpackbits(x.to_numpy(dtype=">f4", na_value=np.nan).view(np.uint8).reshape(-1, 4), axis=1) + ord("0")
    out = pd.Series(np.ascontiguousarray(bits).view("S32").ravel().astype(str), index=x.index)
    return out.where(x.notna(), None)

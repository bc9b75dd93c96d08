"""A fixed-size bitmap of hashed keys: a filter before a shuffle join.

It may let other keys pass, never drops one that is in it, and has BITS bits however many keys there are; when it
fills up, joins only get more rows to drop themselves. It is gathered as at most BITS / 64 rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def slot(hashed: Column) -> Column:
    """The place of a key that is a hash already."""
    return hashed.bitwiseAND(F.lit(BITS - 1))


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, df: DataFrame, hashed: Column) -> Bitmap:
        at = slot(hashed)
        rows = df.filter(hashed.isNotNull()).select(at.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
        got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(BITS // 64, np.uint64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def fill(self) -> float:
        """Share of bits set: about the share of other keys that pass."""
        return float(np.bitwise_count(self.words).sum()) / BITS

    def has(self, hashed: np.ndarray) -> np.ndarray:
        at = hashed.astype(np.int64, copy=False).view(np.uint64) & np.uint64(BITS - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def maybe_in(df: DataFrame, hashed: Column, bitmap: Bitmap) -> tuple[DataFrame, DataFrame]:
    """Splits df into the rows whose key may be in the bitmap and those whose key (null included) surely isn't."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap.words)

    @F.arrow_udf("boolean")
    def test(keys: pa.Array) -> pa.Array:
        return pa.array(Bitmap(shared.value).has(keys.to_numpy(zero_copy_only=False)))

    flag = F.coalesce(test(F.coalesce(hashed, F.lit(0))), F.lit(False)) & hashed.isNotNull()
    return df.filter(flag), df.filter(~flag)

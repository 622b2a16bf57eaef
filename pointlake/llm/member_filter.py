"""A bitmap of fixed size that says of a key "not among them" or "perhaps", to spare rows a shuffle.

It is built by a sum over words of 64 bits, so driver and executors hold at most BITS / 8 bytes however many keys there
are; beyond some 10 million keys it spares less and less, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pointlake.llm.common import tidy

BITS = 1 << 25


class MemberFilter:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def build(cls, keys: DataFrame, key: str, bits: int = BITS) -> MemberFilter:
        """keys: long values of a column, null ones left out."""
        at = F.pmod(F.xxhash64(key), F.lit(bits))
        placed = keys.where(F.col(key).isNotNull()).select(F.shiftright(at, 6).cast("int").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("k"))
        rows = placed.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, k))").alias("b"))
        got = rows.toPandas()  # a row for each word of the bitmap at most
        out = np.zeros(bits // 64, np.uint64)
        out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
        del got
        tidy()
        return cls(out)

    def perhaps(self, key: Column) -> Column:
        """An expression: false where the key is surely not among the keys."""
        bits = self.bits

        @arrow_udf("boolean")
        def test(at: pa.Array) -> pa.Array:
            x = at.to_numpy(zero_copy_only=False).astype(np.int64)
            return pa.array((bits[x >> 6] >> (x & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

        return test(F.pmod(F.xxhash64(key), F.lit(len(bits) * 64)))

"""A bounded bit set of keys, to leave rows out before a shuffle that a join would drop after it.

The set may only say "maybe" for a key that is not in it; the join that follows decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the set: 16 a key, within these bounds (128 KB to 32 MB). With more keys it just leaves out fewer rows.
LEAST_BITS, MOST_BITS = 20, 28
_BLOCK = 32_768


class KeySet:
    def __init__(self, bits: np.ndarray, mask: int):
        self.bits, self.mask = bits, mask

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Which of the 64-bit keys may be in the set."""
        at = keys.view(np.int64) & self.mask
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def key_set(keys: DataFrame, column: str) -> KeySet:
    """The set of a column of well mixed 64-bit hashes; the driver gets its bits, never the keys."""
    n = keys.count()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(size - 1)) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in blocks.toLocalIterator():
        part = np.frombuffer(row.bits, np.uint8)
        begin = (row.b - 1) * _BLOCK // 8
        out[begin:begin + len(part)] = part
    return KeySet(out, size - 1)

"""A filter of a fixed size for keys that a scan should pass on.

It lets through every key it was built from, and some others: whatever passes is
checked by an exact join later. Its size is a parameter, not a function of the
data, so it may be broadcast; with very many keys it passes more rows, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.text import mix

BITS = 1 << 26
_PROBES = 3


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(_PROBES)])


def passing(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be among those the filter was built from."""
    out = np.ones(len(keys), bool)
    for place in _places(keys, len(words) * 64):
        out &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def key_filter(keys: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """A broadcast array of ``bits`` (a power of two) bits built from a long column without nulls.

    The bits are set in the tasks and joined by a grouped OR: at most ``bits / 64`` rows reach the driver.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_places(batch.column(0).to_numpy(), bits))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            bit = np.uint64(1) << (place & np.uint64(63))
            set_bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(set_bits.view(np.int64))], ["word", "bits"])

    rows = keys.select(column).mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)

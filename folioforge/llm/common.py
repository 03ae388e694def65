"""What the training-data operators share: tables in the shared folder, word hashing, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.components import connected_components  # noqa: F401
from ..plans.shared import forget, new_path, save, shared_dir  # noqa: F401

BATCH_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spread(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session from now on hands Python batches of about BATCH_BYTES, unless it has a bound of its own.

    Spark's bound is 10,000 rows, which for long texts are many times as many bytes, twice: in the JVM and in Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def fresh(df: DataFrame, stem: str) -> str:
    """A column name based on ``stem`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


# --------------------------------------------------------------------------- hashing of words
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_RADIX = 0x9E3779B97F4A7C1B  # odd, and 3 modulo 8
_INVERSE = pow(_RADIX, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    v[65:91] = v[97:123]  # A-Z as a-z
    return v


BYTE_VALUES = _byte_values()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 17  # bytes hashed together
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, r in enumerate((_RADIX, _INVERSE)):
            p = np.full(n + 1, r, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """Words (runs of bytes other than white space) of some texts: 64-bit hash, first byte, end, and for each text
    the range of its words."""

    __slots__ = ("hash", "start", "end", "bounds", "data")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        word = ~SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        last = np.zeros(n + 1, bool)
        last[offsets[1:]] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        self.data = data
        self.start = np.flatnonzero(word & (~before | first[:n]))
        self.end = np.flatnonzero(word & (~after | last[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(self.start):  # whole words of PIECE bytes together, or one longer word
            low = int(self.start[a])
            b = max(a + 1, int(np.searchsorted(self.end, low + PIECE, "right")))
            high = int(self.end[b - 1])
            p, q = powers(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data[low:high]] * p[: high - low], out=sums[1:])
            at = self.start[a:b] - low
            self.hash[a:b] = mix((sums[self.end[a:b] - low] - sums[at]) * q[at])
            a = b


def row_bounds(column: pa.Array, most: int) -> list[int]:
    """Where to cut the rows of a string column into runs of about ``most`` bytes; a longer text is a run of its own."""
    n = len(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0]
    while cuts[-1] < n:
        a = cuts[-1]
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))
        cuts.append(min(max(b, a + 1), n))
    return cuts


def text_blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of about ``most`` bytes of a string column;
    null counts as empty.  A longer text is a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for a, b in itertools.pairwise(row_bounds(column, most)):
        part = column.slice(a, b - a).fill_null("").cast(pa.large_string())
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        yield a, b, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_fields(df: DataFrame, fields: str) -> StructType:
    """The schema of ``df`` and further fields."""
    return StructType([*df.schema.fields, *_parse_datatype_string(fields).fields])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

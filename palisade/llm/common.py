"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An odd multiplier, its inverse modulo 2**64, and a second multiplier.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % modulus


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name in any case."""
    taken = {name.lower() for name in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_fields(docs: DataFrame, **fields: T.DataType) -> T.StructType:
    """The schema of ``docs`` with more fields, which may be null."""
    return T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in fields.items())])


def slices(texts: pa.Array, size: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each and of ``rows`` rows at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, side="right")))
        end = min(end, begin + rows)
        yield begin, end
        begin = end


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and each text's length."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), size


def letter_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of numbers, one by one."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    return (mixed ^ (mixed >> np.uint64(31))) * BASE


def powers(count: int, base: np.uint64 = BASE) -> np.ndarray:
    power = np.full(count, base, np.uint64)
    power[:1] = 1
    return np.multiply.accumulate(power, dtype=np.uint64)


def segment_hashes(codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each segment ``codes[at : at + size]``: differences of running sums, moved to a
    common power."""
    if not len(at):
        return np.zeros(0, np.uint64)
    letters = letter_hashes(codes) * powers(len(codes))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters, dtype=np.uint64)])
    value = (running[at + size] - running[at]) * powers(len(codes), INVERSE)[at]
    return letter_hashes(value + size.astype(np.uint64) * MIX)

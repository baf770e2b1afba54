"""Shuffles of numbers in pieces: one row of Spark carries the numbers of some hundred rows.

Rows are put in order of a 64-bit hash; the first bits of the hash are the bucket that a
piece belongs to.  The side that receives them sees one bucket after the other, so it holds
no more than one, and the number of buckets follows the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a piece at most, so that a batch of pieces stays small.
PIECE = 512


def bucket_bits(rows: int, each: int = 200_000, least: int = 64) -> int:
    """Bits of the bucket number for ``rows`` numbers, so that a bucket has about ``each``; at least one."""
    return max(least - 1, rows // each).bit_length()


def pieces(hashes: np.ndarray, columns: Sequence[np.ndarray], bits: int) -> tuple[pa.Array, pa.Array]:
    """The rows as (bucket, data): for each piece the bytes of one column after the other, by ascending hash."""
    by = np.argsort(hashes)
    buckets = (hashes[by] >> np.uint64(64 - bits)).astype(np.int32)
    own = [np.ascontiguousarray(c[by]) for c in columns]
    firsts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(by) else by
    inside = np.arange(len(by)) - np.repeat(firsts, np.diff(firsts, append=len(by)))
    starts = np.flatnonzero(inside % PIECE == 0)
    ends = np.append(starts[1:], len(by))
    data = [b"".join(c[a:b].tobytes() for c in own) for a, b in zip(starts.tolist(), ends.tolist())]
    return pa.array(buckets[starts], pa.int32()), pa.array(data, pa.binary())


#: Six bytes of a hash, those after the bits that its bucket's number has.
SHORT = "V6"


def short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits after the first ``bits``; within a bucket their order is the order of the hashes."""
    rest = (hashes << np.uint64(bits) >> np.uint64(16)).astype("<u8")
    return np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :6]).view(SHORT).reshape(-1)


def whole(shorts: np.ndarray) -> np.ndarray:
    """``short`` hashes as whole numbers."""
    out = np.zeros((len(shorts), 8), np.uint8)
    out[:, :6] = np.ascontiguousarray(shorts).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def opened(data: Sequence[bytes], kinds: Sequence[str]) -> list[np.ndarray]:
    """The columns of pieces, one after the other."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for piece in data:
        n, at = len(piece) // sum(sizes), 0
        for part, kind, size in zip(parts, kinds, sizes):
            part.append(np.frombuffer(piece, kind, n, at))
            at += n * size
    return [np.concatenate(p) for p in parts]


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """The pieces of a bucket in one partition, one bucket after the other."""
    return df.repartition("bucket").sortWithinPartitions("bucket", *order)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Of rows (bucket, data) in order: each bucket with its pieces."""
    now, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(data)
    if held:
        yield now, held

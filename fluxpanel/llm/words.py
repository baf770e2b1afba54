"""Words of many texts at once, as hashes in arrays: no object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are cut into words at once.
SLICE = 1 << 20
#: Words of more bytes are hashed one by one.
LONGEST = 256
_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Keeps the first k of eight little-endian bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _ended(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _MIX[2]
    return x ^ x >> _U(29)


def word_keys(starts: np.ndarray, sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word; ``data`` goes on for eight bytes at least after the last word."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    a, b = sizes.astype(np.uint64) * _MIX[1], sizes.astype(np.uint64) * _MIX[3]
    at, k = np.flatnonzero(sizes <= LONGEST), 0
    while len(at):
        x = eight[starts[at] + k] & _FIRST[np.minimum(sizes[at] - k, 8)]
        y = (a[at] ^ x) * _MIX[0]
        a[at] = y ^ y >> _U(29)
        y = (b[at] ^ x) * _MIX[1]
        b[at] = y ^ y >> _U(31)
        k += 8
        at = at[sizes[at] > k]
    a, b = _ended(a), _ended(b)
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        word = data[starts[i] : starts[i] + sizes[i]]
        a[i], b[i] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)
    return a, b


_END = tuple(int(x[0]) for x in word_keys(np.zeros(1, np.int64), np.zeros(1, np.int64), b" " * 8))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of ``texts``, lower-cased (A-Z) and between ASCII white space: the number of each text, and two hashes of each word."""
    data = (b" ".join(texts) + b" " * 9).translate(_LOWER)
    upto = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    gaps = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8)])
    starts = np.concatenate(([0], gaps[:-1] + 1))
    sizes = gaps - starts
    starts, sizes = starts[sizes > 0], sizes[sizes > 0]
    each = np.diff(np.searchsorted(starts, upto), prepend=0)
    return each, *word_keys(starts, sizes, data)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of ``texts`` in order, with one end after each text: the row, and the two hashes."""
    each, *keys = words(texts)
    rows, n = np.repeat(np.arange(len(each)), each), len(each)
    place, ends, out = np.arange(len(rows)) + rows, np.cumsum(each) + np.arange(n), []
    for own, end in zip(keys, _END):
        out.append(np.empty(len(rows) + n, np.uint64))
        out[-1][place], out[-1][ends] = own, _U(end)
    return np.repeat(np.arange(n), each + 1), *out


def mixed(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    x = (prefix ^ prefix >> _U(31)) * _MIX[0] + suffix * _MIX[1]
    x = (x ^ x >> _U(29)) * _MIX[2]
    return x ^ x >> _U(32)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text after text, and where each text's begin (with the end of all).

    A text of fewer words has one shingle, all its words; a text without a word has none.
    """
    each, keys, _ = words(texts)
    first = np.cumsum(each) - each
    counts = np.where(each > 0, np.maximum(each - width + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first, counts)  # where each shingle begins
    size = np.repeat(np.minimum(each, width), counts)
    out = keys[at]
    for k in range(1, width):
        longer = size > k
        if longer.all():
            out = mixed(out, keys[at + k])
        else:
            out[longer] = mixed(out[longer], keys[at[longer] + k])
    return out, bounds


def blocks(column: pa.Array, most: int = 1 << 15) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about ``SLICE`` bytes and ``most`` texts at most, each with its place; a null is empty."""
    raw = column.cast(pa.binary())
    upto = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = sorted({0, *(np.flatnonzero(np.diff(upto // SLICE)) + 1).tolist(), *range(0, len(raw), most), len(raw)})
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, [t or b"" for t in raw.slice(a, b - a).to_pylist()]

"""Word and shingle hashes of whole Arrow batches, without a Python step per word.

Texts of a batch are joined into one byte buffer, separators become NUL, and words are the runs
between NULs.  A word's hash is a polynomial over mixed bytes, summed by ``reduceat``.  Buffers
are worked off in slices cut between words, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
ARROW_BYTES = 16 << 20

_MULT = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def word_table() -> bytes:
    """Byte map: A-Z lower-cased, digits, a-z and all non-ASCII bytes kept, the rest a separator."""
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table = bytearray(256)
    for byte in keep:
        table[byte] = byte
    for byte in range(0x41, 0x5B):
        table[byte] = byte + 32
    return bytes(table)


def space_table() -> bytes:
    """Byte map: A-Z lower-cased, only space and 09-0D separate words; NUL counts as a letter."""
    table = bytearray(range(256))
    for byte in range(0x41, 0x5B):
        table[byte] = byte + 32
    for byte in (0x20, 9, 10, 11, 12, 13):
        table[byte] = 0
    table[0] = 1  # NUL itself is no separator here; it shares the place of 01, also in the hashes
    return bytes(table)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs only give equal outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    at, end = 0, len(data)
    while at < end:
        cut = min(at + size, end)
        if cut < end:
            back = data.rfind(b"\0", at, cut)
            cut = back + 1 if back >= 0 else ((data.find(b"\0", cut) + 1) or end)
        yield data[at:cut]
        at = cut


def hash_words(texts: list[bytes], table: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Words of all texts in order: index of the text, 64-bit hash, then a hash of each byte prefix."""
    data = b"\0".join(t.translate(table) for t in texts) + b"\0"
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    bounds = np.cumsum(lengths + 1)
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
    powers = np.cumprod(np.full(64, _STEP, np.uint64))
    at, found = 0, []
    for piece in _slices(data, SLICE_BYTES):
        buf = np.frombuffer(piece, np.uint8)
        inside = np.empty(len(buf) + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.not_equal(buf, 0, out=inside[1:-1].view(bool))
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        if len(starts):
            size = ends - starts
            if size.max() > len(powers):
                powers = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
            first = np.cumsum(size) - size
            place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
            value = codes[buf[buf != 0]] * powers[place]
            hashes = [mix(np.add.reduceat(value, first))]
            for k in prefixes:
                hashes.append(mix(np.add.reduceat(np.where(place < k, value, np.uint64(0)), first) + np.uint64(k)))
            found.append((np.searchsorted(bounds, starts + at, side="right"), *hashes))
        at += len(piece)
    if not found:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(1 + len(prefixes))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shingle_sets(texts: list[bytes], width: int, table: bytes) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles per text.

    A text with fewer words gives its whole sequence as one shingle, a text without words none.
    """
    of, words = hash_words(texts, table)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = (rolled * np.uint64(_STEP)) + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for at in range(a, b):
                whole = whole * np.uint64(_MULT) + words[at : at + 1]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts sum to about ``limit`` bytes."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.binary())), 0)
    part = np.cumsum(np.asarray(size, np.int64)) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, since a text may be as long as it likes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df.mapInArrow(work, schema)

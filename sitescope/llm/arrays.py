"""Vectorised work on the text column of Arrow batches, used inside tasks.

Texts are handled as the UTF-8 bytes of a chunk of rows: word bounds come from
a byte table, word and n-gram hashes from prefix sums of a polynomial modulo
2**64. A chunk holds about ``CHUNK_BYTES`` of text (or one longer document), so
memory stays bounded whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xD6E8FEB86659FD93 | 1}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

# ASCII but digits and letters
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        at, rows = 0, batch.num_rows
        while at < rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(rows, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[at:at + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-separator bytes within a row."""
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    inside = ~separators[raw]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, stops, rows


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, _BASE[kind], dtype=np.uint64)
        down = np.full(size, pow(_BASE[kind], -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[kind] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over 64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, kind: str) -> np.ndarray:
    """Prefix sums of value[i] * base**i; spans and deletions are hashed from them."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(kind, len(values))[0][:len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, kind: str, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, stop) of the values behind ``sums``."""
    down = powers(kind, len(sums))[1]
    h = (sums[stops] - sums[starts]) * down[starts]
    return mix(h + (stops - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    return span_hash(prefix_sums(raw.astype(np.uint64) + np.uint64(1), "byte"), "byte", starts, stops)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: the unit that packed exchanges move."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype=np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *dtypes: object) -> list[np.ndarray]:
    at, out = 8 * (len(dtypes) + 1), []
    sizes = np.frombuffer(blob, dtype=np.int64, count=len(dtypes) + 1)[1:]
    for dtype, size in zip(dtypes, sizes, strict=True):
        out.append(np.frombuffer(blob, dtype=dtype, count=int(size) // np.dtype(dtype).itemsize, offset=at))
        at += int(size)
    return out


def unpack_all(batches: Iterator[pa.RecordBatch], *dtypes: object) -> list[np.ndarray]:
    """All blobs of a partition, joined per array."""
    parts = [unpack(blob.as_py(), *dtypes) for batch in batches for blob in batch.column("blob")]
    if not parts:
        return [np.zeros(0, dtype=d) for d in dtypes]
    return [np.concatenate(column) for column in zip(*parts, strict=True)]


def unpack_kinds(batches: Iterator[pa.RecordBatch], *kinds: tuple) -> list[list[np.ndarray]]:
    """All blobs of a partition that holds blobs of several kinds, told apart by their number of arrays."""
    parts: dict[int, list] = {len(k): [] for k in kinds}
    for batch in batches:
        for blob in batch.column("blob"):
            blob = blob.as_py()
            n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
            parts[n].append(unpack(blob, *next(k for k in kinds if len(k) == n)))
    return [[np.concatenate(c) for c in zip(*parts[len(k)], strict=True)] if parts[len(k)]
            else [np.zeros(0, dtype=d) for d in k] for k in kinds]


def bucket_rows(bucket: np.ndarray, n_buckets: int, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(bucket, blob) rows: entries of ``arrays`` grouped by bucket number."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    arrays = [a[order] for a in arrays]
    ids = [b for b in range(n_buckets) if cuts[b + 1] > cuts[b]]
    for at in range(0, len(ids), 64):
        some = ids[at:at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()),
             pa.array([pack(*(a[cuts[b]:cuts[b + 1]] for a in arrays)) for b in some], pa.binary())],
            names=["bucket", "blob"])


BUCKET_SCHEMA = "bucket int, blob binary"


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """True at each position of sorted ``keys`` where a new run begins."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def differ(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Where any of the arrays ``a`` differs from its partner in ``b``."""
    out = np.zeros(len(a[0]), dtype=bool)
    for x, y in zip(a, b, strict=True):
        out |= x != y
    return out


def flushes(parts: Iterator[list[np.ndarray]], size: int) -> Iterator[list[np.ndarray]]:
    """Lists of arrays, joined until the first holds about ``size`` entries."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]

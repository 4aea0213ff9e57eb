"""Arrow text columns as byte arrays, and key lists packed into small blobs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hand memory that a task has freed back to the system; idle workers keep little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Only glibc has it.
        pass


def tidy(run: Run) -> Run:
    """A function over batches that gives memory back when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 12

_codec = None


def _zstd() -> pa.Codec:
    global _codec
    if _codec is None:
        _codec = pa.Codec("zstd")
    return _codec


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row bounds in them (rows + 1 numbers)."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(
    batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES, rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows, at most ``rows``, with about ``limit`` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, bounds = bytes_of(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows)
        yield batch.slice(first, last - first)
        first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as compressed differences, byte planes apart."""
    keys = keys.astype(np.uint64)
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(8, "little") + _zstd().compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack_keys(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = _zstd().decompress(blob[8:], n * 8, asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers of one type, compressed."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + _zstd().compress(raw, asbytes=True)


def unpack_numbers(blob: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(_zstd().decompress(blob[8:], size, asbytes=True) if size else b"", dtype)


#: An odd multiplier and its inverse modulo 2**64, for hashes of byte ranges.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, _INVERSE):
            steps = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def pack_table(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of one length as a compressed Arrow message."""
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_table(blob: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all()
    return {name: table.column(name).to_numpy() for name in table.column_names}


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)

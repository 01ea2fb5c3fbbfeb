"""Vectorised text kernels over Arrow string buffers: words, shingles, MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are maximal runs of bytes other than space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)

CHUNK_BYTES = 2 << 20
#: Hashes whose minima are taken at a time.
CACHED = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and each text's start in them (one more for the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers, n = column.buffers(), len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and each text's first word (one more for the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = starts[:-1]
    edges = edges[edges < n]
    first[edges] = solid[edges]
    begin = np.flatnonzero(first)
    if len(begin) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    kept = data[solid]
    rank = np.cumsum(solid) - 1
    at = rank[begin]
    sizes = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, sizes)
    values = BYTE_CODE[kept] * powers(WORD_BASE, int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(values, at) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(begin, starts)


def word_shingles(words: np.ndarray, firsts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text (a shorter text with words has one, of all its words), and each text's first."""
    m = np.diff(firsts)
    number = np.where(m >= size, m - size + 1, np.minimum(m, 1))
    ends = np.concatenate([[0], np.cumsum(number)])
    total = int(ends[-1])
    if total == 0:
        return np.zeros(0, np.uint64), ends
    at = np.arange(total) + np.repeat(firsts[:-1] - ends[:-1], number)
    here = np.repeat(m, number)
    acc = np.zeros(total, np.uint64)
    for k in range(size):
        w = words[np.minimum(at + k, len(words) - 1)]
        acc = acc * SHINGLE_BASE + np.where(k < here, w, np.uint64(0))
    return mix(acc), ends


def _rolled(points: np.ndarray, doublings: int) -> np.ndarray:
    """Polynomial hashes of all runs of 2**doublings code points, by doubling."""
    h = points.astype(np.uint64)
    h += np.uint64(0x1F123BB5)
    base = SHINGLE_BASE
    with np.errstate(over="ignore"):
        for d in range(doublings):
            step = 1 << d
            if len(h) <= step:
                return np.zeros(0, np.uint64)
            g = h[:-step] * base
            g += h[step:]
            h, base = g, base * base
    return h


def _places(firsts: np.ndarray, lasts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of `size` in the spans [first, last) begins, and each span's first run."""
    number = np.maximum(lasts - firsts - size + 1, 0)
    ends = np.concatenate([[0], np.cumsum(number)])
    return np.arange(int(ends[-1])) + np.repeat(firsts - ends[:-1], number), ends


def char_shingles(points: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, doublings: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of 2**doublings code points of the spans [first, last), and each span's first."""
    at, ends = _places(firsts, lasts, 1 << doublings)
    return (mix(_rolled(points, doublings)[at]) if len(at) else np.zeros(0, np.uint64)), ends


def char_hashes(points: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, doublings: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """As char_shingles, in 32 bits: enough for signatures."""
    at, ends = _places(firsts, lasts, 1 << doublings)
    if not len(at):
        return np.zeros(0, np.uint32), ends
    h = _rolled(points, doublings)
    h *= WORD_BASE
    x = (h >> np.uint64(32)).astype(np.uint32)[at]
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    return x, ends


class MinHasher:
    """MinHash signatures of 16-bit values; a band of four values is one 64-bit key."""

    def __init__(self, values: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.values = values
        self.a = r.integers(0, 2**32, values, dtype=np.uint32) | np.uint32(1)
        self.b = r.integers(0, 2**32, values, dtype=np.uint32)

    def signatures(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row for each set; rows of empty sets are zero. Runs of sets that fit the processor's cache are hashed at a time."""
        x = hashes if hashes.dtype == np.uint32 else (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(ends) - 1, self.values), np.uint16)
        full = np.flatnonzero(np.diff(ends) > 0)
        first, last = ends[:-1][full], ends[1:][full]
        i = 0
        while i < len(full):
            j = max(i + 1, int(np.searchsorted(last, first[i] + CACHED, "right")))
            part, at = x[first[i] : last[j - 1]], first[i:j] - first[i]
            buffer, least = np.empty_like(part), np.empty((self.values, j - i), np.uint32)
            for k in range(self.values):
                np.multiply(part, self.a[k], out=buffer)
                np.add(buffer, self.b[k], out=buffer)
                np.minimum.reduceat(buffer, at, out=least[k])
            least *= np.uint32(0x9E3779B1)
            out[full[i:j]] = (least >> np.uint32(16)).T
            i = j
        return out

    @staticmethod
    def band_keys(signatures: np.ndarray) -> np.ndarray:
        """(sets, bands) keys; the band's number is part of the key."""
        rows = np.ascontiguousarray(signatures).view(np.uint64)
        band = mix(np.arange(1, rows.shape[1] + 1, dtype=np.uint64))
        return mix(rows ^ band[None, :]).view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one key after another from batches sorted by keys; a run that spans batches is put together."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = table.column(k).combine_chunks()
            if batch.num_rows > 1:
                change[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            key = tuple(table.column(k)[i].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(i, j - i))
            last = key
    if held:
        yield pa.concat_tables(held)


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows that differ in a key from the one before; the first does."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for k in keys:
        col = table.column(k).combine_chunks()
        if table.num_rows > 1:
            out[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches sorted by keys: about so many rows or bytes, more only if one run has more."""
    held: list[pa.Table] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(pa.Table.from_batches([batch.slice(at, rows)]))
            if sum(t.num_rows for t in held) < rows and sum(t.nbytes for t in held) < size:
                continue
            table = pa.concat_tables(held)
            last = int(np.flatnonzero(changes(table, keys))[-1])
            if last:
                yield table.slice(0, last)
            held = [table.slice(last)]
    if held:
        yield pa.concat_tables(held)

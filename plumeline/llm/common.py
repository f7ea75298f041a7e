"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import SparkSession

from ..operators.graph import shared_dir, written  # noqa: F401  operators take both from here

#: Odd multiplier of the rolling fingerprints and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release() -> None:
    """Gives memory that this worker has freed back to the system: the next stage's workers are the same processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, which calls release() at its end. Within `run` itself that would come too early, as its variables still hold their memory."""

    @wraps(run)
    def task(frames: Iterator) -> Iterator:
        yield from run(frames)
        release()

    return task


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "u8"), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """64-bit xxHash of words, remembered; forgets everything beyond `limit` words, so that memory stays bounded."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Longer words are hashed one by one, shorter ones of many texts together, eight bytes a round.
TOGETHER = 64
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spans_of(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, where each word begins in it, the words' sizes, and how many each text has."""
    blob = b" ".join([b"", *texts, b" " * 8]).translate(table)
    inner = np.frombuffer(blob, np.uint8) != 32
    edges = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = 1 + np.cumsum(np.array([len(t) for t in texts], np.int64) + 1)
    return blob, starts, sizes, np.diff(np.searchsorted(starts, ends), prepend=0)


def hashes_of(blob: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    eights = np.ndarray(len(blob) - 7, "<u8", blob, strides=(1,))  # at each byte
    out = mix((eights[starts] & LOW[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * BASE))
    more, k = np.flatnonzero((sizes > 8) & (sizes <= TOGETHER)), 8
    while len(more):
        out[more] = mix(out[more] ^ (eights[starts[more] + k] & LOW[np.minimum(sizes[more] - k, 8)]))
        k += 8
        more = more[sizes[more] > k]
    for i in np.flatnonzero(sizes > TOGETHER):
        out[i] = xxhash.xxh3_64_intdigest(blob[starts[i] : starts[i] + sizes[i]])
    return out


def hash_words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and how many each text has. `table` gives each byte's own value, 32 for
    what separates words."""
    blob, starts, sizes, counts = spans_of(texts, table)
    return hashes_of(blob, starts, sizes), counts


def distinct_words(texts: list[bytes], table: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of all texts by their hashes, which of them each word is, one after the other, and how many words each text has."""
    blob, starts, sizes, counts = spans_of(texts, table)
    hashes = hashes_of(blob, starts, sizes)
    order = stable_order(hashes)
    hashes = hashes[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return [blob[a : a + n].decode() for a, n in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)], which, counts


def together(texts: Iterable[bytes], size: int) -> Iterator[list[bytes]]:
    """Texts of about `size` bytes, or one, at once."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def stable_order(values: np.ndarray) -> np.ndarray:
    """np.argsort(values, kind="stable") of unsigned 64-bit integers, quicker where they are hashes: their places take the lowest bits and
    the whole is sorted by value. The few that differ in those bits alone are sorted again."""
    low = np.uint64((1 << len(values).bit_length()) - 1)
    keyed = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    keyed.sort()
    order = (keyed & low).astype(np.int64)
    own = values[order]
    other = own[1:] ^ own[:-1]
    wrong = np.flatnonzero((other != 0) & (other <= low))
    if len(wrong):
        keyed &= ~low
        run = np.cumsum(np.concatenate([[0], keyed[1:] != keyed[:-1]]))
        again = np.zeros(run[-1] + 1, bool)
        again[run[wrong]] = True
        at = np.flatnonzero(again[run])
        order[at] = order[at[np.argsort(own[at], kind="stable")]]
    return order


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of `size` values: a polynomial in BASE modulo 2**64, scrambled."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers, inverses = _powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values) * powers[: len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * inverses[:n])


_POWERS: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, BASE_INVERSE)]
    return _POWERS

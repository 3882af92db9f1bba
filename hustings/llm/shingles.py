"""Word shingles of UTF-8 buffers as 64-bit hashes, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

_WEIGHT = np.uint64(0x9E3779B97F4A7C15)
#: Primes below 2^31, a base for each, and the base's inverse: sums of 2^25 bytes times a power fit 64 bits.
_FIELDS = tuple((p, base, pow(base, -1, p)) for p, base in ((2147483647, 1_580_030_173), (2147483629, 1_128_889_081)))
#: Bytes of a slice up to which the tables of powers are kept.
KEPT = 1 << 19
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base ** k modulo prime for k below n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse; those of usual slices are kept, longer ones are made for a text."""
    if n <= KEPT and _powers:
        return _powers
    size = max(n, KEPT)
    made = [(_power_table(base, p, size), _power_table(inverse, p, size)) for p, base, inverse in _FIELDS]
    if n <= KEPT:
        _powers[:] = made
    return made


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes: its polynomials in two prime fields and its length, mixed.

    Two different spans of n bytes share it with a chance of about n^2 / 2^62; where even that would matter, bytes
    are compared.
    """
    out = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    wide = raw.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(raw) + 1, np.uint64)
    for (p, _, _), (power, inverse), shift in zip(_FIELDS, _tables(len(raw)), (31, 0)):
        np.cumsum(wide * power[: len(raw)], out=total[1:])
        prime = np.uint64(p)
        out ^= mix(((total[end] - total[start]) % prime * inverse[start] % prime << np.uint64(shift)) + np.uint64(shift))
    return mix(out)


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word [^\\x20\\x09-\\x0D]+, with A-Z lower-cased."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = spans(low, start, end)
    return hashes, np.searchsorted(offs, start, side="right") - 1


def sets(raw: np.ndarray, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of `size` words, sorted; of fewer words, the sequence as one; of none, empty."""
    hashes, owner = words(raw, offs)
    count = np.bincount(owner, minlength=len(offs) - 1)
    ends = np.cumsum(count)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * _WEIGHT) | np.uint64(1)
    m = max(0, len(hashes) - size + 1)
    made = np.zeros(m, np.uint64)
    for j in range(size):
        made += hashes[j : j + m] * weights[j]
    made = mix(made)
    out = []
    for end, n in zip(ends.tolist(), count.tolist()):
        start = end - n
        if n >= size:
            out.append(np.unique(made[start : end - size + 1]))
        elif n:
            out.append(mix((hashes[start:end] * weights[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def of_batch(batch: pa.RecordBatch, column: str, size: int = 5, most_bytes: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the shingle sets of their texts."""
    for part in common.pieces(batch, column, most_bytes):
        yield part, sets(*common.text_buffers(part.column(column)), size)

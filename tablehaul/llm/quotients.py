"""Counting quotient filters: sets of long keys with exact counts, each key as a place and a remainder.

A key is permuted by a Feistel network, which can be turned round, so its bits are spread evenly and none is lost. The
first bits are its quotient: they are not stored but follow from the place in the filter, by one bit a quotient (is it
occupied?) and one bit a slot (does the run of its quotient end here?). The slot holds all other bits, the remainder.
Slots are sorted and without gaps, as a filter is built once from all its keys; filters of one range of the permuted keys
are merged in their order. Counts of one need a bit, up to 254 a byte more, and others eight.
"""

from __future__ import annotations

import numpy as np

_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mixed(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    out = (values ^ np.uint64(salt >> 1)) * np.uint64(salt)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out >> np.uint64(64 - bits)


class Layout:
    """How the ids of ``length`` words, of ``bits`` bits each, are packed into columns of up to 63 bits, and permuted."""

    def __init__(self, length: int, bits: int):
        if not 1 <= bits <= 63:
            raise ValueError(f"ids of {bits} bits")
        each = max(1, min(63 // bits, -(-length // 2)))
        self.words = [min(each, length - i) for i in range(0, length, each)]
        self.bits = bits
        self.widths = [n * bits for n in self.words]
        # Columns that fit into one are joined, so that keys sort as plain numbers.
        self.joined = sum(self.widths) <= 63
        self.width = sum(self.widths) if self.joined else self.widths[0]
        self.tails = [] if self.joined else self.widths[1:]

    def keys(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The permuted keys, as a head and tails, of n-grams whose words' ids are given word by word."""
        columns, at = [], 0
        for n in self.words:
            column = np.zeros(len(ids[0]), np.uint64)
            for word in ids[at : at + n]:
                column = column << np.uint64(self.bits) | word.astype(np.uint64)
            columns.append(column)
            at += n
        for salt in _ROUNDS:
            for i in range(len(columns)):
                columns[i] = columns[i] ^ self._others(columns, i, salt)
        if not self.joined:
            return columns
        head = columns[0]
        for column, width in zip(columns[1:], self.widths[1:]):
            head = head << np.uint64(width) | column
        return [head]

    def ids(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """The words' ids again."""
        columns = list(keys)
        if self.joined:
            rest, columns = keys[0], []
            for width in self.widths[:0:-1]:
                columns.insert(0, rest & np.uint64((1 << width) - 1))
                rest = rest >> np.uint64(width)
            columns.insert(0, rest)
        for salt in _ROUNDS[::-1]:
            for i in reversed(range(len(columns))):
                columns[i] = columns[i] ^ self._others(columns, i, salt)
        out = []
        for column, n in zip(columns, self.words):
            out += [column >> np.uint64(self.bits * (n - 1 - j)) & np.uint64((1 << self.bits) - 1) for j in range(n)]
        return out

    def _others(self, columns: list[np.ndarray], i: int, salt: int) -> np.ndarray:
        held = np.zeros(len(columns[0]), np.uint64)
        for j, column in enumerate(columns):
            if j != i:
                held ^= _mixed(column + np.uint64(j), salt, 64)
        return _mixed(held, salt, self.widths[i])

    def range_bits(self, bits: int) -> int:
        return min(bits, self.width)


class Hashes:
    """Keys that are the first ``bits`` bits of a hash of 64."""

    tails: list[int] = []

    def __init__(self, bits: int):
        self.width = bits

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.width)

    def range_bits(self, bits: int) -> int:
        return min(bits, self.width)


def counted(keys: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(sorted distinct keys, their counts, for each given key its place among them)."""
    if len(keys) == 1:
        order = np.argsort(keys[0], kind="stable")
    else:
        order = np.lexsort(keys[::-1])
    held = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in held], axis=0)
    begins = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(begins, len(order)))
    else:
        sums = np.add.reduceat(counts[order], begins) if len(order) else counts[:0]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [k[begins] for k in held], sums, place


def _bytes_of(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _values_of(held: bytes, at: int, n: int, size: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    if size:
        out[:, :size] = np.frombuffer(held, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").reshape(n).astype(np.uint64), at + n * size


def _bits_of(held: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = -(-n // 8)
    return np.unpackbits(np.frombuffer(held, np.uint8, size, at), count=n).astype(bool), at + size


def encoded(keys: list[np.ndarray], counts: np.ndarray, width: int, tails: list[int]) -> bytes:
    """A filter of sorted distinct keys, whose heads have ``width`` bits."""
    n = len(counts)
    size = max(0, -(-(width - n.bit_length()) // 8))
    quotient_bits = max(0, width - 8 * size)
    rest = np.uint64(width - quotient_bits)
    quotients = (keys[0] >> rest).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    ends = np.append(quotients[1:] != quotients[:-1], True)
    remainders = keys[0] & ((np.uint64(1) << rest) - np.uint64(1))
    more = counts > 1
    several = counts[more]
    return b"".join([
        n.to_bytes(8, "little"), bytes([quotient_bits, size]), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        _bytes_of(remainders, size), *(_bytes_of(k, -(-t // 8)) for k, t in zip(keys[1:], tails)),
        np.packbits(more).tobytes(), np.minimum(several, 255).astype(np.uint8).tobytes(), several[several >= 255].astype("<i8").tobytes(),
    ])


def decoded(held: bytes, width: int, tails: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys and counts of a filter."""
    n, quotient_bits, size = int.from_bytes(held[:8], "little"), held[8], held[9]
    occupied, at = _bits_of(held, 10, 1 << quotient_bits)
    ends, at = _bits_of(held, at, n)
    run = np.cumsum(ends) - ends
    remainders, at = _values_of(held, at, n, size)
    keys = [np.flatnonzero(occupied).astype(np.uint64)[run] << np.uint64(width - quotient_bits) | remainders]
    for t in tails:
        key, at = _values_of(held, at, n, -(-t // 8))
        keys.append(key)
    more, at = _bits_of(held, at, n)
    counts = np.ones(n, np.int64)
    several = np.frombuffer(held, np.uint8, int(more.sum()), at).astype(np.int64)
    large = several == 255
    several[large] = np.frombuffer(held, "<i8", int(large.sum()), at + len(several))
    counts[more] = several
    return keys, counts

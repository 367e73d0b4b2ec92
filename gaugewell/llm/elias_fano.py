"""Elias-Fano sequences in numpy: compact monotone numbers with vectorised access and successor search."""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np

_ONE, _63, _6 = np.uint64(1), np.uint64(63), np.uint64(6)
#: Place of the k-th set bit of a byte, at 8 * byte + k.
_SELECT = np.array([[p for p in range(8) if b >> p & 1] + [8] * (8 - b.bit_count()) for b in range(256)], np.uint8).reshape(-1)
_LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_M55, _M33, _M0F, _FF = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0xFF))
_2, _4, _8, _3, _56 = (np.uint64(x) for x in (2, 4, 8, 3, 56))


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each 64-bit word: byte sums at once, then a table for the byte."""
    k = k.astype(np.uint64)
    s = word - (word >> _ONE & _M55)
    s = (s & _M33) + (s >> _2 & _M33)
    s = ((s + (s >> _4)) & _M0F) * _LOW  # byte i: set bits of bytes 0 to i
    place = np.bitwise_count((k * _LOW | _HIGH) - s & _HIGH).astype(np.uint64) << _3
    rank = k - (s << _8 >> place & _FF)
    return (place + _SELECT[((word >> place & _FF) << _3 | rank).astype(np.int64)]).astype(np.int64)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(values) * bits >> 6) + 2, np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, off = (at >> _6).astype(np.int64), at & _63
        np.bitwise_or.at(out, word, values << off)
        over = off + np.uint64(bits) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - off[over]))
    return out


class EliasFano:
    """n numbers that never fall, each in about 2 + log2(universe / n) bits, with a quarter of a bit per high bit for the directory."""

    def __init__(self, arrays: Mapping[str, np.ndarray], name: str) -> None:
        self.n, self.bits = (int(x) for x in arrays[f"{name}.head"])
        self.low, self.high = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self.ones = arrays[f"{name}.ones"]

    @staticmethod
    def build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((((top >> bits) + n + 1) >> 6) + 2, np.uint64)
        np.bitwise_or.at(high, (ones >> _6).astype(np.int64), _ONE << (ones & _63))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return {f"{name}.head": np.array([n, bits], np.int64), f"{name}.low": _pack(values & np.uint64((1 << bits) - 1), bits), f"{name}.high": high, f"{name}.ones": before}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> _6).astype(np.int64), at & _63
        over = (self.low[word + 1] << _ONE) << (_63 - off)
        return (self.low[word] >> off | over) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        place = (word << 6) + _select_in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return (place - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def _start(self, bucket: np.ndarray) -> np.ndarray:
        """How many numbers have high bits below bucket."""
        k = bucket - 1
        if not hasattr(self, "zeros"):
            self.zeros = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones.astype(np.int64)
        safe = np.minimum(np.maximum(k, 0), self.zeros[-1] - 1)
        word = np.searchsorted(self.zeros, safe, side="right") - 1
        place = (word << 6) + _select_in_word(~self.high[word], safe - self.zeros[word])
        return np.where(k < 0, 0, np.minimum(place - safe, self.n))

    def _search(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place not below target, end of target's bucket, target's low bits)."""
        target = target.astype(np.uint64)
        bucket = (target >> np.uint64(self.bits)).astype(np.int64)
        lo, end = self._start(bucket), self._start(bucket + 1)
        want = target & np.uint64((1 << self.bits) - 1)
        live = np.flatnonzero(lo < end)
        hi = end.copy()
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo, end, want

    def successor(self, target: np.ndarray) -> np.ndarray:
        """Place of the first number that is at least target; n where there is none."""
        return self._search(target)[0]

    def find(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(successor's place, whether it is target itself)."""
        lo, end, want = self._search(target)
        ok = lo < end
        ok[ok] = self._low(lo[ok]) == want[ok]
        return lo, ok


def to_file(arrays: Mapping[str, np.ndarray]) -> bytes:
    """Arrays in one block: a length, a JSON index, then each array from a multiple of 8 bytes on."""
    at, index, parts = 0, {}, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        index[name] = (a.dtype.str, len(a), at)
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    return np.array([len(head)], "<u8").tobytes() + head + b"".join(parts)


def from_buffer(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a block of bytes, which may be memory-mapped, without copying."""
    size = int(data[:8].view("<u8")[0])
    index = json.loads(bytes(data[8 : 8 + size]))
    body = data[8 + size :]
    return {name: body[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in index.items()}

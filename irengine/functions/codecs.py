"""Posting-list codecs in numpy over many lists at once, with Arrow UDF wrappers.

``varbyte`` puts the most significant group first and flags the first byte of a
number; ``leb128`` puts the least significant group first and flags all bytes but
the last; ``simple9`` packs as many equal-width numbers as fit in 28 bits of a word;
``fibonacci`` writes Zeckendorf sums, each ended by two one bits.

Lists lie end to end: list i has the places ``first[i]`` to before ``first[i + 1]``, in numbers
as in bytes. Every list is coded by itself, from a byte of its own on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 17  # numbers or bytes that are coded at once, so that memory is bounded by them or by the longest list


def _firsts(size: np.ndarray) -> np.ndarray:
    """Places at which spans of these sizes begin, with the total at the end."""
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out


# ---------------------------------------------------------------- byte codes
def _groups(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of 7-bit groups, least significant first; number of groups of each value)."""
    if len(v) and v.min() < 0:
        raise ValueError("negative value")
    low = (v[:, None] >> (7 * np.arange(9))) & 127
    return low.astype(np.uint8), 1 + np.sum(v[:, None] >> (7 * np.arange(1, 9)) > 0, axis=1)


def varbyte_encode_many(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, n = _groups(v)
    place = np.arange(9)[None]
    use = place < n[:, None]
    # most significant group first: group n - 1 - k stands at place k
    out = np.take_along_axis(low, np.where(use, n[:, None] - 1 - place, 0), 1)
    out[:, 0] |= 128
    return out[use], _firsts(n)[first]


def varbyte_decode_many(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if np.any(b[first[:-1][np.diff(first) > 0]] < 128):
        raise ValueError("first byte carries no flag")
    start = np.flatnonzero(b & 128)
    size = np.diff(np.append(start, len(b)))
    up = np.repeat(start + size, size) - 1 - np.arange(len(b))
    return _joined(b, up, start), np.searchsorted(start, first)


def _joined(b: np.ndarray, up: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers from groups that begin at ``start``, each shifted by ``up`` places of 7 bits."""
    if not len(b):
        return np.zeros(0, np.int64)
    if up.max() > 8:
        raise ValueError("value out of range")
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * up), start)


def leb128_encode_many(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, n = _groups(v)
    place = np.arange(9)[None]
    more = (place < n[:, None] - 1) * np.uint8(128)
    return (low | more)[place < n[:, None]], _firsts(n)[first]


def leb128_decode_many(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.flatnonzero(b < 128)
    # a number begins after the one before it, in its own list; groups after a list's last end say nothing
    start = np.maximum(np.append(0, end + 1)[:-1], first[np.searchsorted(first, end, "right") - 1])
    begins = _firsts(end - start + 1)
    up = np.arange(begins[-1]) - np.repeat(begins[:-1], np.diff(begins))
    return _joined(b[np.repeat(start, np.diff(begins)) + up], up, begins[:-1]), np.searchsorted(end, first)


# ---------------------------------------------------------------- simple9
WIDTHS = (1, 2, 3, 4, 5, 7, 9, 14, 28)
SELECTORS = dict(zip(WIDTHS, (1, 2, 3, 4, 5, 7, 9, 14, 15), strict=True))
_SELECTOR = np.array([SELECTORS.get(w, 0) for w in range(29)])
_WIDTH = np.array([next((w for w, s in SELECTORS.items() if s == k), 0) for k in range(16)])


def simple9_encode_many(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy packing: the width of a word grows to its widest number while all still fit."""
    if np.any(np.diff(first) == 0) or len(v) and (v.min() < 1 or v.max() >= 1 << 28):
        raise ValueError("simple9 takes a non-empty list of values from 1 to 2**28 - 1")
    # of every place: how many numbers a word that begins there holds, and their width
    need = np.array(WIDTHS)[np.searchsorted(np.left_shift(1, WIDTHS), v, "right")]
    stop = np.repeat(first[1:], np.diff(first))
    wide, count, grown = need.copy(), np.ones(len(v), np.int64), np.arange(len(v))
    for n in range(2, 29):
        grown = grown[grown + n <= stop[grown]]
        w = np.maximum(wide[grown], need[grown + n - 1])
        fits = n * w <= 28
        grown = grown[fits]
        if not len(grown):
            break
        wide[grown], count[grown] = w[fits], n
    following, begins, at = (np.arange(len(v)) + count).tolist(), [], 0
    while at < len(v):
        begins.append(at)
        at = following[at]
    s = np.array(begins, np.int64)
    words, size, width = _SELECTOR[wide[s]], count[s], wide[s]
    for k in range(int(size.max(initial=0))):
        held = size > k
        words[held] |= v[s[held] + k] << (4 + k * width[held])
    return words.astype("<u4").view(np.uint8), 4 * np.searchsorted(s, first)


def simple9_decode_many(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if np.any(first % 4):
        raise ValueError("simple9 takes whole words")
    words = np.ascontiguousarray(b).view("<u4").astype(np.int64)
    width, k = _WIDTH[words & 15], np.arange(28)
    if np.any(width == 0):
        raise ValueError("unknown selector")
    found, size = [], [np.zeros(0, np.int64)]
    for lo in range(0, len(words), 1 << 14):
        w = width[lo : lo + (1 << 14), None]
        x = (words[lo : lo + (1 << 14), None] >> np.minimum(4 + k * w, 62)) & ((1 << w) - 1)
        use = np.logical_and.accumulate((x > 0) & (k < 28 // w), axis=1)  # a word's numbers end at its first zero
        found.append(x[use])
        size.append(use.sum(1))
    return np.concatenate([np.zeros(0, np.int64), *found]), _firsts(np.concatenate(size))[first // 4]


# ---------------------------------------------------------------- fibonacci
def _base() -> list[int]:
    base = [1, 2]
    while base[-1] <= 1 << 28:
        base.append(base[-1] + base[-2])
    return base


FIBONACCI = _base()
_FIB = np.array(FIBONACCI, np.int64)


class BitWriter:
    """Bits, most significant first; the last byte is filled with zeros."""

    def __init__(self) -> None:
        self.done, self.word, self.held = bytearray(), 0, 0

    def add(self, bit: int) -> None:
        self.word = self.word << 1 | bit
        self.held += 1
        if self.held == 64:
            self.done += self.word.to_bytes(8, "big")
            self.word = self.held = 0

    def getvalue(self) -> bytes:
        size = (self.held + 7) // 8
        return bytes(self.done) + (self.word << (8 * size - self.held)).to_bytes(size, "big")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def finished(self) -> bool:
        return self.at >= 8 * len(self.data)

    def get(self) -> int:
        bit = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return bit


def fibonacci_encode_many(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code lists of numbers from 1 on."""
    if len(v) and (v.min() < 1 or v.max() > FIBONACCI[-1]):
        raise ValueError("value out of range")
    top = np.searchsorted(_FIB, v, "right") - 1
    ends = _firsts(top + 2)
    size = (ends[first[1:]] - ends[first[:-1]] + 7) // 8  # bytes; the last one of a list is filled with zeros
    bytes_ = _firsts(size)
    at = ends[:-1] + np.repeat(8 * bytes_[:-1] - ends[first[:-1]], np.diff(first))
    bits = np.zeros(8 * int(bytes_[-1]), np.uint8)
    bits[at + top + 1] = 1
    rest = v.copy()
    for k in range(int(top.max(initial=-1)), -1, -1):
        picked = np.flatnonzero(rest >= _FIB[k])
        rest[picked] -= _FIB[k]
        bits[at[picked] + k] = 1
    return np.packbits(bits), bytes_


def fibonacci_decode_many(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ones, edges = np.flatnonzero(np.unpackbits(b)), 8 * first
    own, k = np.searchsorted(edges, ones, "right") - 1, np.arange(len(ones))
    # in a run of ones every second one ends a number
    new = np.append(True, (np.diff(ones) > 1) | (np.diff(own) > 0))[: len(ones)]
    last = (k - np.maximum.accumulate(np.where(new, k, 0))) % 2 == 1
    end, end_own, number = ones[last], own[last], np.cumsum(last) - last
    place = ones - np.maximum(np.append(0, end + 1)[number], edges[own])
    # ones after a list's last number belong to none
    part = ~last & (np.append(end_own, -1)[number] == own)
    return np.bincount(number[part], _FIB[place[part]], len(end)).astype(np.int64), np.searchsorted(end, edges)


def gaps(increasing) -> list[int]:
    last, out = 0, []
    for v in increasing:
        out.append(v - last)
        last = v
    return out


def ungap(deltas) -> list[int]:
    total, out = 0, []
    for d in deltas:
        total += d
        out.append(total)
    return out


MANY = {
    "varbyte": (varbyte_encode_many, varbyte_decode_many), "leb128": (leb128_encode_many, leb128_decode_many),
    "simple9": (simple9_encode_many, simple9_decode_many), "fibonacci": (fibonacci_encode_many, fibonacci_decode_many),
}


def _single(codec: str) -> tuple:
    """(encode, decode) of one list."""
    pack, unpack = MANY[codec]

    def encode_one(values) -> bytes:
        v = np.array(list(values), np.int64).reshape(-1)
        return pack(v, np.array([0, len(v)]))[0].tobytes()

    def decode_one(data: bytes) -> list[int]:
        return unpack(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()

    return encode_one, decode_one


CODECS = {codec: _single(codec) for codec in MANY}
varbyte_encode, varbyte_decode = CODECS["varbyte"]
leb128_encode, leb128_decode = CODECS["leb128"]
simple9_encode, simple9_decode = CODECS["simple9"]
fibonacci_encode, fibonacci_decode = CODECS["fibonacci"]


# ---------------------------------------------------------------- Arrow
def _chunks(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists with at most CHUNK items together (a longer list stands alone)."""
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def _by_chunk(run, items: np.ndarray, first: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """``run`` (items, firsts) -> (items, firsts) over all lists, a chunk at a time."""
    out, firsts, done = [np.zeros(0, kind)], [np.zeros(1, np.int64)], 0
    for lo, hi in _chunks(first):
        x, own = run(items[first[lo] : first[hi]], first[lo : hi + 1] - first[lo])
        out.append(x)
        firsts.append(own[1:] + done)
        done += len(x)
    return np.concatenate(out), np.concatenate(firsts)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(items, firsts) of lists of numbers without nulls."""
    items = lists.flatten()
    if items.null_count:
        raise ValueError("null value")
    return items.cast(pa.int64()).to_numpy(), _firsts(pc.list_value_length(lists).to_numpy())


def _list_array(items: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(items, pa.int64()))


def _with_nulls(col: pa.Array, run) -> pa.Array:
    """``run`` over the values that are there, nulls where they were."""
    if not col.null_count:
        return run(col)
    there = col.is_valid().to_numpy(zero_copy_only=False)
    return run(col.drop_null()).take(pa.array(np.cumsum(there) - 1, pa.int64(), mask=~there))


def encode(values: Column, codec: str) -> Column:
    """array<long> of gaps -> binary."""
    pack = MANY[codec][0]

    def packed(lists: pa.Array) -> pa.Array:
        data, first = _by_chunk(pack, *_flat(lists), np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(data)])

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return _with_nulls(batch, packed)

    return run(values)


def decode(data: Column, codec: str, running: bool = False) -> Column:
    """binary -> array<long> of gaps, or of their running sums."""
    unpack = MANY[codec][1]

    def unpacked(col: pa.Array) -> pa.Array:
        size = pc.binary_length(col).to_numpy()
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        low = int(np.frombuffer(col.buffers()[1], np.int32, 1, 4 * col.offset)[0]) if len(col) else 0
        items, first = _by_chunk(unpack, raw[low:], _firsts(size), np.int64)
        return _list_array(_running(items, first) if running else items, first)

    @F.arrow_udf("array<long>")
    def run(batch: pa.Array) -> pa.Array:
        return _with_nulls(batch.cast(pa.binary()), unpacked)

    return run(data)


def _running(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums up to each place of its list."""
    total = _firsts(items)
    return total[1:] - np.repeat(total[first[:-1]], np.diff(first))


@F.arrow_udf(T.ArrayType(T.LongType()))
def running_sums(values: pa.Array) -> pa.Array:
    """array<long> -> the sum up to each of its places."""

    def run(lists: pa.Array) -> pa.Array:
        items, first = _flat(lists)
        return _list_array(_running(items, first), first)

    return _with_nulls(values, run)


def varbyte_size(value: Column) -> Column:
    """Bytes that either byte code needs for one number."""
    size = F.lit(1)
    for k in range(1, 9):
        size = F.when(value >= 1 << (7 * k), k + 1).otherwise(size)
    return size

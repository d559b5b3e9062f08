"""Hashed shingles of many texts at once, with numpy instead of a loop over characters."""

from __future__ import annotations

import numpy as np

#: 0 separates, 1 belongs to a run (Latin letters and digits), 2 is a token of its own (kana, Han).
_CLASS = np.zeros(65536, np.uint8)
for _lo, _hi, _kind in ((0x30, 0x39, 1), (0x61, 0x7A, 1), (0xC0, 0xFF, 1), (0x3040, 0x30FF, 2), (0x4E00, 0x9FFF, 2)):
    _CLASS[_lo : _hi + 1] = _kind
_CLASS[[0xD7, 0xF7]] = 0
_POWERS = np.full(4096, 0x9E3779B97F4A7C15, np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text begins (with the end as the last)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of lower-cased ``texts`` and the number of tokens before each text."""
    data, begins = codes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = _CLASS[np.minimum(data, 65535)]
    start = kind == 2
    run = kind == 1
    fresh = run.copy()
    fresh[1:] &= ~run[:-1]
    firsts = begins[:-1][begins[:-1] < len(data)]
    fresh[firsts] = run[firsts]
    start |= fresh
    inside = kind > 0
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    number = np.cumsum(start) - 1
    kept = np.flatnonzero(inside)
    place = kept - at[number[kept]]
    values = mix(data[kept].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
    sums = np.add.reduceat(values, np.searchsorted(kept, at))
    return mix(sums), np.searchsorted(at, begins)


def shingle_sets(texts: list[str], width: int = 4, least_tokens: int = 0) -> list[np.ndarray | None]:
    """Sorted distinct hashes of ``width`` adjacent tokens of each text; None below ``least_tokens``."""
    tokens, begins = token_hashes([t.lower() for t in texts])
    return windows(tokens, begins, width, least_tokens)


def gram_sets(texts: list[str], width: int = 3) -> list[np.ndarray | None]:
    """Sorted distinct hashes of the substrings of ``width`` characters of each text."""
    data, begins = codes(texts)
    return windows(mix(data.astype(np.uint64) + np.uint64(1)), begins, width, 0)


def sequence_hashes(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each stretch of tokens between ``begins``; those of equal stretches are equal."""
    out = np.zeros(len(begins) - 1, np.uint64)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        place = np.arange(len(tokens)) - np.repeat(begins[:-1], np.diff(begins))
        out[full] = np.add.reduceat(mix(tokens + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begins[:-1][full])
    return mix(out).view(np.int64)


def windows(units: np.ndarray, begins: np.ndarray, width: int, least: int = 0) -> list[np.ndarray | None]:
    """Sorted distinct hashes of ``width`` adjacent units of each stretch between ``begins``."""
    if len(units) >= width:
        h = np.zeros(len(units) - width + 1, np.uint64)
        for k in range(width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + units[k : len(units) - width + 1 + k]
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    out: list[np.ndarray | None] = []
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if hi - lo < least:
            out.append(None)
        else:
            part = np.sort(h[lo : max(lo, hi - width + 1)])
            out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) > 1 else part)
    return out


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` keys, each a hash of ``rows`` minima of the set under different orders."""
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    mul = _multipliers(bands * rows)
    half = len(mul) // 2
    best = np.empty(len(mul), np.uint32)
    for lo in range(0, len(shingles), 2048):
        a = (low[lo : lo + 2048, None] * mul[None, :half]).min(axis=0)
        b = (high[lo : lo + 2048, None] * mul[None, half:]).min(axis=0)
        part = np.concatenate((a, b))
        best = part if lo == 0 else np.minimum(best, part)
    keys = np.zeros(bands, np.uint64)
    for column in best.reshape(rows, bands).astype(np.uint64):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    # Forty bits of hash below the number of the band: short numbers make a short shuffle.
    return (mix(keys) & np.uint64((1 << 40) - 1)) | (np.arange(bands, dtype=np.uint64) << np.uint64(40))


_MUL: dict[int, np.ndarray] = {}


def _multipliers(n: int) -> np.ndarray:
    if n not in _MUL:
        _MUL[n] = np.random.default_rng(20_011).integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1)
    return _MUL[n]


def set_signature(shingles: np.ndarray) -> int:
    """One signed 64-bit number of a set: equal sets have equal numbers."""
    total = np.sum(mix(shingles ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64, keepdims=True)
    return int(mix(total + np.array([len(shingles)], np.uint64)).view(np.int64)[0])

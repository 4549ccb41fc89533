"""Sets of word shingles as sorted arrays of 64-bit hashes, and their minwise signatures, for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

#: Length of signatures.
COORDINATES = 64
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of some bytes, A-Z taken as a-z."""
    data = _FOLD[data]
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(start) == 0:
        return np.zeros(0, np.uint64), start
    inside = np.flatnonzero(~space)
    first = np.flatnonzero(np.concatenate([[True], np.diff(inside) > 1]))
    length = np.diff(np.concatenate([first, [len(inside)]]))
    power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
    at = np.arange(len(inside)) - np.repeat(first, length)
    return mixed(np.add.reduceat(_BYTE[data[inside]] * power[at], first) + length.astype(np.uint64)), start


def sets(texts: list[str], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words has its whole sequence as one."""
    parts = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    with np.errstate(over="ignore"):
        words, start = word_hashes(np.frombuffer(b"".join(parts), dtype=np.uint8))
        m = len(words) - width + 1
        runs = np.zeros(0, np.uint64)
        if m > 0:
            runs = np.zeros(m, np.uint64)
            for j in range(width):
                runs += words[j : j + m] * _PLACE[j]
            runs = mixed(runs)
        low = 0
        for high in np.searchsorted(start, ends):
            n = high - low
            if n >= width:
                yield np.unique(runs[low : high - width + 1])
            elif n:
                yield mixed(np.add.reduce(words[low:high] * _PLACE[8 * n : 8 * n + n]).reshape(1))
            else:
                yield np.zeros(0, np.uint64)
            low = high


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of many hash functions, as 32-bit numbers."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096]
            values = ((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]) >> np.uint64(32)
            out = np.minimum(out, values.min(axis=1).astype(np.uint32))
    return out


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that name the set."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mixed(hashes), dtype=np.uint64) if len(hashes) else np.uint64(0)
        b = np.bitwise_xor.reduce(mixed(hashes * _BASE + np.uint64(len(hashes)))) if len(hashes) else np.uint64(0)
    return np.array([a, b], dtype=np.uint64).tobytes()


def chunks(texts, limit: int = 1 << 18) -> Iterator[list[str]]:
    """The texts in runs of about a quarter of a megabyte, so that temporary arrays stay small beside the batch."""
    part, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part

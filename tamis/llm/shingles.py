"""Word-shingle sets of whole texts as 64-bit hashes, computed on byte buffers.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D`` after
lower-casing A-Z (bytes above 0x7F are never touched, so this works on UTF-8).
Each word gets a polynomial hash over Z/2^64 of randomised byte values, mixed by a
finaliser; a shingle mixes its words' hashes in order.  The chance that two of the
shingles met anywhere in a comparison of ``m`` shingles collide is about
``m * m / 2**65``.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SEED = 0x5EED_0F_7A315


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` well-mixed 64-bit values that depend on nothing but ``seed``."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) + _U(seed)
        return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = _splitmix(256, _SEED)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STRETCH = 1 << 16


def _powers(base: int) -> np.ndarray:
    """``base ** 0 .. base ** (_STRETCH - 1)`` modulo 2^64."""
    out = np.full(_STRETCH, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)
_UP_BY, _DOWN_BY = pow(_BASE, _STRETCH, 1 << 64), pow(_INVERSE, _STRETCH, 1 << 64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each word's text index.

    The sum of byte values times powers of the base is carried from stretch to stretch, and only its values at the words' ends are
    kept, so memory follows the words and not eight times the bytes.
    """
    joined = b"\n".join(texts)
    if not joined:
        return np.empty(0, _U), np.empty(0, np.int64)
    raw = np.frombuffer(joined, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    h, scale = np.zeros(len(start), dtype=_U), np.empty(len(start), dtype=_U)
    carry, up, down = 0, 1, 1
    total = np.zeros(_STRETCH + 1, dtype=_U)
    for lo in range(0, len(raw), _STRETCH):
        part = raw[lo : lo + _STRETCH]
        np.cumsum(_BYTE[_LOWER[part]] * _UP[: len(part)], out=total[1 : len(part) + 1])
        sums = total[: len(part) + 1] * _U(up) + _U(carry)
        a, b = np.searchsorted(end, [lo, lo + len(part)], side="right")
        h[a:b] += sums[end[a:b] - lo]
        a, b = np.searchsorted(start, [lo, lo + len(part)])
        h[a:b] -= sums[start[a:b] - lo]
        scale[a:b] = _DOWN[start[a:b] - lo] * _U(down)
        carry, up, down = int(sums[-1]), up * _UP_BY % (1 << 64), down * _DOWN_BY % (1 << 64)
    h = mix64(h * scale + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return h, np.searchsorted(firsts, start, side="right") - 1


def shingle_sets(texts: list[bytes | None], width: int = 2, most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and ``len(texts) + 1`` offsets.

    A text with fewer than ``width`` words has its whole word sequence as its only
    shingle; null texts and texts without words have none.  Texts are worked on in
    blocks of about ``most_bytes`` so that the temporary arrays stay small; one text
    is never cut.
    """
    sets: list[np.ndarray] = []
    block: list[bytes] = []
    held = 0

    def flush() -> None:
        words, of = word_hashes(block)
        bounds = np.searchsorted(of, np.arange(len(block) + 1))
        grams = words.copy()
        for k in range(1, width):
            if len(words) > k:
                grams[:-k] = mix64(grams[:-k] * _U(0xA24BAED4963EE407) + words[k:] + _U(k))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= width:
                sets.append(np.unique(grams[lo : hi - width + 1]))
            elif hi > lo:
                whole = words[lo : lo + 1].copy()
                for k in range(lo + 1, hi):
                    whole = mix64(whole * _U(0xA24BAED4963EE407) + words[k : k + 1] + _U(0x51ED))
                sets.append(mix64(whole + _U(0xC0FFEE)))
            else:
                sets.append(words[:0])

    for text in texts:
        text = text or b""
        if block and held + len(text) > most_bytes:
            flush()
            block, held = [], 0
        block.append(text)
        held += len(text) + 1
    if block:
        flush()
    offsets = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.empty(0, _U)), offsets


def minima(values: np.ndarray, offsets: np.ndarray, n_hashes: int, seed: int) -> np.ndarray:
    """``len(offsets) - 1`` by ``n_hashes`` minima of multiply-add-shift hashes, as int32.

    Empty sets get a row of zeros; callers leave them out.
    """
    a = _splitmix(n_hashes, seed) | _U(1)
    b = _splitmix(n_hashes, seed + 1)
    n = len(offsets) - 1
    out = np.zeros((n, n_hashes), dtype=np.int32)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    at = 0
    while at < len(full):
        # about 32k values at a time stay in the processor's cache
        stop = max(at + 1, int(np.searchsorted(offsets[full], offsets[full[at]] + (1 << 15))))
        rows = full[at:stop]
        lo, hi = offsets[rows[0]], offsets[rows[-1] + 1]
        x, cuts = values[lo:hi], offsets[rows] - lo
        tmp = np.empty_like(x)
        for k in range(n_hashes):
            np.multiply(x, a[k], out=tmp)
            np.add(tmp, b[k], out=tmp)
            out[rows, k] = (np.minimum.reduceat(tmp, cuts) >> _U(32)).astype(np.uint32).view(np.int32)
        at = stop
    return out

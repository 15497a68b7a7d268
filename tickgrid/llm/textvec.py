"""Whole-text vectors in numpy, used inside Arrow batches: hashed character n-grams, word shingles, MinHash."""

from __future__ import annotations

import numpy as np
import regex

#: Characters or bytes worked on at once, which bounds memory for texts of any length.
PIECE = 1 << 18
_U = np.uint64
_ODD = regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{N}]")
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def ngram_counts(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the text's character n-grams, hashed to 2**bits places; every piece of the text counts."""
    out = np.zeros(1 << bits, np.int64)
    most = max(orders)
    for at in range(0, max(1, len(text)), PIECE):
        c = np.frombuffer(text[at : at + PIECE + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = min(PIECE, len(text) - at)
        h = np.zeros(len(c) + 1, np.uint32)
        for n in range(1, most + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            if n in orders:
                own = h[:fresh] if n > 1 or len(h) > fresh else h
                out += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def hellinger(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares: unit length, no favour for long texts; zeros stay zeros."""
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        for b in (_BASE, inverse):
            p = np.full(2 * PIECE + 1, b, _U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, in order: maximal runs of letters, marks and digits of the lower-cased text."""
    if not text.isascii() and _ODD.search(text):
        text = _ODD.sub(" ", text)
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    power, inverse = _powers()
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:  # end at a word's end
            gap = np.flatnonzero(~_WORD[raw[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # a word longer than a piece is hashed whole: the sums of its parts, each moved to its place
                total, size, more = 0, 0, True
                while more and at < n:
                    part = raw[at : at + PIECE]
                    stops = np.flatnonzero(~_WORD[part])
                    more = not len(stops)
                    part = part if more else part[: int(stops[0])]
                    total += int((part.astype(_U) * power[: len(part)]).sum()) * pow(_BASE, size, 1 << 64)
                    size, at = size + len(part), at + len(part)
                out.append(_mixed(np.array([(total + size) % (1 << 64)], _U)))
                continue
        b = raw[at:end]
        edge = np.diff(_WORD[b].astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(b) + 1, _U)
        np.cumsum(b.astype(_U) * power[: len(b)], out=sums[1:])
        out.append(_mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of so many words; a shorter text with words is one run of them all."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    m = len(h) - n + 1
    g = np.zeros(m, _U)
    for i in range(n):
        g = g * _U(0x100000001B3) + h[i : i + m]
    return np.unique(_mixed(g))


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum over the set under each map x -> a*x + b mod 2**32."""
    x = (grams >> _U(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * a + b).min(axis=0), out=out)
    return out


def maps(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1 << 31, size=n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(1 << 32, size=n, dtype=np.uint64).astype(np.uint32)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3, l2: float = 1e-4, softmax: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by full-batch Adam: independent sigmoids, or one softmax; y may be soft."""
    n, d = x.shape
    k = y.shape[1]
    p = np.zeros((d + 1, k), np.float32)
    m, v = np.zeros_like(p), np.zeros_like(p)
    y = y.astype(np.float32)
    for t in range(1, rounds + 1):
        z = x @ p[:-1] + p[-1]
        if softmax:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            q = z / z.sum(axis=1, keepdims=True)
        else:
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = (q - y) / max(n, 1)
        g = np.vstack([x.T @ e + l2 * p[:-1], e.sum(axis=0, keepdims=True)])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p[:-1].copy(), p[-1].copy()

"""Words of whole texts, cut from UTF-8 bytes by a table of letters, a bounded number of words at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np

#: Bytes that are cut into words at once, within one text or over many.
WINDOW = 1 << 21


def letters(*ranges: tuple[int, int]) -> bytes:
    """A table for bytes.translate: A-Z become a-z, bytes in the ranges and above 127 stay, all others are blanks."""
    own = set(range(128, 256)).union(*(range(a, z + 1) for a, z in ranges))
    folded = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b in own else 32 for b in folded)


#: a-z and other letters; with digits too.
ALPHA = letters((97, 122))
ALNUM = letters((48, 57), (97, 122))


def parts(text: bytes, cut: bytes, window: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text in order; a long text comes in several lists, parted between words."""
    window = window or WINDOW
    plain, at = text.translate(cut), 0
    while len(plain) - at > window:
        gap = plain.find(b" ", at + window)
        if gap < 0:
            break
        yield plain[at:gap].split()
        at = gap
    yield plain[at:].split() if at else plain.split()


def windows(texts: Iterable[bytes | None], cut: bytes, carry: int = 0, window: int | None = None) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, rows, fresh) of many texts: each list of words ends with an empty word; rows tells whose a word is.

    Where a text goes on in the next window, its last ``carry`` words come again, with fresh false.
    """
    window = window or WINDOW
    words: list[bytes] = []
    own: list[tuple[int, int, int]] = []  # row, words seen before, new words
    size = 0

    def flush() -> tuple[list[bytes], np.ndarray, np.ndarray]:
        n = np.array([(again + new + 1) for _, again, new in own], np.int64)
        rows = np.repeat(np.array([r for r, _, _ in own], np.int64), n)
        ends = np.cumsum(n)
        place = np.arange(len(rows)) - np.repeat(ends - n, n)
        again = np.repeat(np.array([a for _, a, _ in own], np.int64), n)
        return words, rows, place >= again

    for row, text in enumerate(texts):
        last: list[bytes] = []
        for part in parts(text or b"", cut, window):
            own.append((row, len(last), len(part)))
            words += last
            words += part
            words.append(b"")
            last = (last + part)[-carry:] if carry else []
            size += sum(map(len, part)) + len(part) + 1
            if size >= window:
                yield flush()
                words, own, size = [], [], 0
    if own:
        yield flush()


def numbered[T: (str, bytes)](words: list[T], empty: T = b"") -> tuple[np.ndarray, list[T]]:
    """A number for each word, 0 for the empty one, equal for equal words; and the words by their numbers."""
    fresh = count(1)

    class Known(dict):
        def __missing__(self, word: T) -> int:
            self[word] = n = next(fresh)
            return n

    known = Known({empty: 0})
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), list(known)

"""Numpy helpers over Arrow batches of texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points handled at once by the numpy scorers; bounds the temporary arrays, not the texts.
CHUNK_CHARS = 500_000

_MIX = np.uint32(2654435761)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts holding about ``limit`` characters; a longer text is a run of its own."""
    a = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield a, i
            a, total = i, 0
        total += len(text)
    if a < len(texts):
        yield a, len(texts)


# Marks and digits that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_PLAIN = np.arange(128, dtype=np.uint32)
for _mark, _letter in DISGUISE.items():
    _PLAIN[ord(_mark)] = ord(_letter)


def undisguised(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Marks and digits as the letters they may stand for, where a letter is within two places on either side or both.

    ``edges`` are the spaces between texts; no text sees the letters of another.
    """
    low = code < 128
    letter = (code >= 0x61) & (~low | (code <= 0x7A))
    near = letter.copy()
    near[1:] |= letter[:-1]
    near[:-1] |= letter[1:]
    inner = np.ones(len(code), dtype=bool)
    inner[edges] = False
    near[2:] |= letter[:-2] & inner[1:-1]
    near[:-2] |= letter[2:] & inner[1:-1]
    at = np.flatnonzero(low & near & ~letter)
    out = code.copy()
    out[at] = _PLAIN[code[at]]
    return out


def letters(texts: list[str], disguised: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, one space before, between and after them; start of each text.

    With ``disguised``, marks and digits inside or beside words count as the letters they look like.

    Everything that is not a letter (ASCII punctuation, digits, control characters) becomes a space, so
    n-grams see words only. The text i is at ``[starts[i], starts[i + 1] - 1)``.
    """
    joined = (" " + " ".join(texts) + " ").lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = [len(t) if t.isascii() else len(t.lower()) for t in texts]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.asarray(lengths, dtype=np.int64) + 1, out=starts[1:])
    if disguised:
        code = undisguised(code, starts)
    other = (code < 0x61) | ((code > 0x7A) & (code < 0xAA)) | ((code >= 0x2000) & (code < 0x2070))
    return np.where(other, np.uint32(0x20), code), starts + 1


def gram_slots(code: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash slot of the n-gram at each position, and where it lies within one word.

    A space may stand first or last (it marks the edge of a word), not inside.
    """
    m = len(code) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    space = code == 0x20
    h = np.full(m, n, dtype=np.uint32)
    for k in range(n):
        h = (h ^ code[k : k + m]) * _MIX
        h ^= h >> np.uint32(15)
    ok = np.ones(m, dtype=bool)
    for k in range(1, n - 1):
        ok &= ~space[k : k + m]
    if n <= 2:
        ok &= ~(space[:m] & space[n - 1 : n - 1 + m])
    return h >> np.uint32(32 - bits), ok

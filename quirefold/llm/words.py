"""Vectorised words, shingles and hashes over batches of texts.

Words are runs of letters and digits in lower case.  A whole batch of texts becomes one array of
code points; words are found and hashed with a few array passes, never one Python call per word.
"""

import re

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = re.compile(r"\s+")
_CHARS = 1 << 16
_state: dict = {}


def body(paragraphs: list) -> str:
    """Paragraphs joined by a space, white space collapsed, trimmed, lower case; parts that are no strings are left out."""
    return _SPACE.sub(" ", " ".join(p for p in paragraphs if isinstance(p, str))).strip().lower()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _word_char() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    if "table" not in _state:
        _state["table"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _state["table"]


def _scrambled() -> np.ndarray:
    """A 64-bit hash of each code point."""
    if "scrambled" not in _state:
        _state["scrambled"] = mix(np.arange(1, 0x110001, dtype=_U))
    return _state["scrambled"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses."""
    if len(_state.get("powers", ((), ()))[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, dtype=_U), np.full(n, inverse, dtype=_U)
        up[0] = down[0] = 1
        _state["powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _state["powers"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first character, end character) of each word; characters count within the text.

    Texts must already be in lower case.  Equal words have equal hashes everywhere.
    """
    parts, lo, size = [], 0, 0
    for k, t in enumerate(texts):  # parts that fit the processor's cache
        size += len(t)
        if size > _CHARS or k == len(texts) - 1:
            value, number, start, end = _hashes_of_part(texts[lo : k + 1])
            parts.append((value, number + lo, start, end))
            lo, size = k + 1, 0
    if not parts:
        return np.zeros(0, dtype=_U), *[np.zeros(0, dtype=np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def _hashes_of_part(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(code) + 2, dtype=np.int8)
    inside[1:-1] = _word_char()[code]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    number = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return np.zeros(0, dtype=_U), number, start, end
    up, down = _powers(len(code) + 1)
    running = np.zeros(len(code) + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum(_scrambled()[code] * up[: len(code)], out=running[1:])
        value = mix((running[end] - running[start]) * down[start] + (end - start).astype(_U))
    return value, number, start - offsets[number], end - offsets[number]


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``size`` words, in order, repeats kept."""
    value, number, _, _ = word_hashes(texts)
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=_U)
        for k in range(size):
            total = total * _U(0xD6E8FEB86659FD93) + value[k : k + n]
        total = mix(total)
    whole = number[:n] == number[size - 1 :]
    return total[whole], number[:n][whole]


def distinct_shingles(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    value, number = shingles(texts, size)
    order = np.lexsort((value, number))
    value, number = value[order], number[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (number[1:] != number[:-1])
    value, number = value[keep], number[keep]
    cuts = np.searchsorted(number, np.arange(len(texts) + 1))
    return [value[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

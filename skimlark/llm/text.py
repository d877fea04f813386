"""Words and word shingles of whole texts as numpy arrays.

Words are runs of bytes other than space and 0x09-0x0D, after A-Z are lower-cased. Hashes are 64 bits: a polynomial over
the bytes of a word, mixed; a shingle is the mixed sum of five of those. Every function takes null as the empty text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WORDS = 5
TOGETHER = 1 << 17  # bytes of texts that are hashed together
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_INSIDE = bytes(b != 32 and not 9 <= b <= 13 for b in range(256))
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_TURN = np.random.default_rng(11).integers(1, 2**63, WORDS, dtype=np.uint64) | U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers over all positions."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(1024, 1 << n.bit_length()), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = np.frombuffer(raw.translate(_INSIDE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word; equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    sums = np.zeros(len(b) + 1, np.uint64)
    own = _BYTE.take(b)
    own *= powers(_BASE, len(b))
    np.cumsum(own, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BACK, len(b))[starts] + (ends - starts).astype(np.uint64))


def roll(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles in order; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        return mix((words * _TURN[:n]).sum(dtype=np.uint64, keepdims=True) + U(n))
    out = words[: n - WORDS + 1] * _TURN[0]
    for k in range(1, WORDS):
        out = out + words[k : n - WORDS + 1 + k] * _TURN[k]
    return mix(out)


def shingles(text: str | None) -> np.ndarray:
    """The shingles of a whole text, in order, repeats included."""
    raw = lowered(text)
    return roll(word_hashes(raw, *word_spans(raw)))


def several(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of some texts in a row, ``TOGETHER`` bytes at a time, and where each text's begin; the last number is their count."""

    def hashed() -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(raws).translate(_LOWER)
        starts, ends = word_spans(joined)
        bounds = np.cumsum([0, *[len(r) + 1 for r in raws]])
        return word_hashes(joined, starts, ends), np.searchsorted(starts, bounds)

    raws, size = [], 0
    for t in texts:
        raws.append((t or "").encode("utf-8", "replace"))
        size += len(raws[-1])
        if size >= TOGETHER:
            yield hashed()
            raws, size = [], 0
    if raws:
        yield hashed()


def all_shingles(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """``shingles`` of each text, one after the other."""
    for words, begins in several(texts):
        rolled = roll(words)
        for begin, end in zip(begins.tolist(), begins[1:].tolist(), strict=False):
            yield rolled[begin : end - WORDS + 1] if end - begin >= WORDS else roll(words[begin:end])


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles of a whole text, ascending."""
    return np.unique(shingles(text))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.astype(np.uint64, copy=False).view(np.int64)


_keepers: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    """An operator keeps something in this Python worker that ``forget`` gives back."""
    _keepers[name] = forget


def alone(name: str) -> None:
    """At the start of a task: what other operators kept in this worker is given back to the system."""
    others = [k for k in _keepers if k != name]
    for k in others:
        _keepers.pop(k)()
    if others:
        trimmed()


def trimmed() -> None:
    """Tables of powers and free memory of this worker go back to the system."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function over a task's batches that leaves its worker small: idle workers of earlier stages stay beside those that run."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trimmed()

    return wrapped


def settled(run: Callable) -> Callable:
    """The same for a function of one large group: what it worked with goes back before its result is sent."""

    def wrapped(pdf):
        out = run(pdf)
        trimmed()
        return out

    return wrapped

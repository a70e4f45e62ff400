"""Words and word shingles of whole batches of texts as numpy arrays.

A word is a maximal run of letters, digits and non-ASCII characters of the lower-cased text. All
hashes are 64-bit and depend on the characters alone, so every worker computes the same ones.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np

SHINGLE_WORDS = 5
CHUNK_BYTES = 1 << 19

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1


def process_wide(name: str, make: Callable[[], object]):
    """An object that this process keeps from task to task. It lives outside this module, whose own
    variables are sent along with each function."""
    store = sys.modules.setdefault("_pharmatext_llm_state", types.ModuleType("_pharmatext_llm_state"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    known = process_wide("powers", list)
    if not known or len(known[0]) < n:
        known.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 2 * CHUNK_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            known.append(np.cumprod(steps, dtype=np.uint64))
    return known[0][:n], known[1][:n]


def _words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words in the joined bytes, the sums that give hashes, and where each text's words begin."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = len(data)
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    before, after = inside[:-1].copy(), inside[1:].copy()
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner - 1] = False
    after[inner - 1] = False
    first[1:] &= ~before
    last[:-1] &= ~after
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return starts, ends, sums, inverses, np.searchsorted(starts, bounds)


def _hash(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * inverses[starts] ^ (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the place of each text's first word (one entry more than texts)."""
    starts, ends, sums, inverses, bounds = _words(texts)
    return _hash(starts, ends, sums, inverses), bounds


def stem_hashes(texts: list[str | None], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text of each) of all words, then for each size of the first bytes of all longer words."""
    starts, ends, sums, inverses, bounds = _words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    yield _hash(starts, ends, sums, inverses), text
    for size in sizes:
        longer = ends - starts > size
        yield _hash(starts[longer], starts[longer] + size, sums, inverses), text[longer]


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and the bounds by text. A text of fewer words has one
    shingle of all its words; a text without words has none."""
    counts = np.diff(bounds)
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    full = np.empty(0, dtype=np.uint64)
    if len(words) >= size:
        full = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            full = full * multiplier + words[k : len(words) - size + 1 + k]
        full = mix(full)
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out_bounds[1:])
    place = np.repeat(bounds[:-1] - out_bounds[:-1], sizes) + np.arange(out_bounds[-1])
    out = np.zeros(out_bounds[-1], dtype=np.uint64)
    fits = np.repeat(counts >= size, sizes)
    out[fits] = full[place[fits]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        acc = np.uint64(0)
        for w in words[bounds[i] : bounds[i + 1]]:
            acc = np.uint64((int(acc) * int(multiplier) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[out_bounds[i]] = mix(np.array([acc ^ np.uint64(counts[i])]))[0]
    return out, out_bounds


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together, so that work arrays stay small."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_shingles(texts: list[str | None], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, in order and with repeats."""
    for a, b in chunks(texts):
        hashes, bounds = shingle_hashes(*word_hashes(texts[a:b]), size)
        for i in range(b - a):
            yield hashes[bounds[i] : bounds[i + 1]]


_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[*b" \t\n\r\x0b\x0c"]] = 0
_KIND[_WORD] = 1
_KIND[ord("A") : ord("Z") + 1] = 1


def token_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each run of word characters or of other signs, in original case, and the
    bounds by text. A shape is 0 lower case, 1 upper case, 2 capital, 3 with a digit, or the sign's hash."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = len(data)
    kind = _KIND[data]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    filled = kind[starts] > 0 if n else np.empty(0, dtype=bool)
    starts, ends = starts[filled], ends[filled]
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    hashes = _hash(starts, ends, sums, inverses)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122)
    within = lambda flags: np.concatenate([[0], np.cumsum(flags)])[ends] - np.concatenate([[0], np.cumsum(flags)])[starts]
    n_upper, n_digit, n_lower = within(upper), within(digit), within(lower)
    shapes = np.where(n_digit > 0, 3, np.where((n_upper > 1) & (n_lower == 0), 1, np.where(n_upper > 0, 2, 0))).astype(np.uint64)
    shapes = np.where(kind[starts] == 2, hashes | np.uint64(8), shapes) if n else shapes
    return hashes, shapes, np.searchsorted(starts, bounds)

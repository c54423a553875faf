"""Vectorised word tables over Arrow string columns.

A word is a maximal run of bytes outside space, tab, LF, VT, FF and CR, which
on UTF-8 equals the code-point class ``[^\\x20\\x09-\\x0D]+``.  Texts are taken
in slices of a few MB, so that memory does not depend on the batch; nulls are
empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, hence invertible modulo 2**64
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of consecutive documents: hashes, byte spans, and each document's first word."""

    data: np.ndarray
    doc_bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len = documents + 1

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def _cuts(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> list[int]:
    """Ends of blocks of about 1 MB; they never fall inside a word."""
    cuts, at, n = [0], 0, len(data)
    while at < n:
        want = at + _BLOCK
        if want >= n:
            cuts.append(n)
            break
        k = int(off[np.searchsorted(off, want, side="right") - 1])
        if k <= at:  # one long document
            gap = np.flatnonzero(separator[data[want : want + 4096]])
            while not len(gap) and want < n:
                want += 4096
                gap = np.flatnonzero(separator[data[want : want + 4096]])
            stop = int(off[np.searchsorted(off, at, side="right")])
            k = min(want + int(gap[0]) if len(gap) else n, stop)
        cuts.append(k)
        at = k
    return cuts


def words_of(col: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """The word table of a string column (``lower``: ASCII letters hash alike; ``separator``: by byte)."""
    data, off = text_buffers(col)
    starts, ends, hashes = [], [], []
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[off] = True
    cuts = _cuts(data, off, separator)
    for a, z in zip(cuts, cuts[1:], strict=False):
        b = data[a:z]
        word = ~separator[b]
        new = fresh[a:z].copy()
        new[0] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | new[1:]
        last = word.copy()
        last[:-1] &= ~word[1:] | new[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        pw, inv = powers(_P, len(b) + 1)
        v = b.astype(U64)
        if lower:
            v[(b >= 65) & (b <= 90)] += U64(32)
        acc = np.zeros(len(b) + 1, dtype=U64)
        np.cumsum((v + U64(1)) * pw[: len(b)], out=acc[1:])
        hashes.append(mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(U64) * U64(_Q)))
        starts.append(s + a)
        ends.append(e + a)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    st = cat(starts, np.int64)
    return Words(data, off, st, cat(ends, np.int64), cat(hashes, U64), np.searchsorted(st, off))


def window_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (callers mask runs that cross documents)."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    pw, inv = powers(_Q, len(h) + 1)
    acc = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(mix(h + U64(seed * 0x2545F4914F6CDD1D % (1 << 64))) * pw[: len(h)], out=acc[1:])
    m = len(h) - n + 1
    return mix((acc[n:] - acc[:m]) * inv[:m])


def doc_of_word(w: Words) -> np.ndarray:
    return np.repeat(np.arange(w.n_docs), np.diff(w.first))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end

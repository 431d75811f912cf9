"""Vectorised kernels over whole texts held as one byte buffer.

Every function here works on a *batch*: a list of UTF-8 texts.  Nothing is
truncated; a batch is only a unit of work, never a limit on what is compared.
"""

from __future__ import annotations

import ctypes
import gc
import time

import numpy as np
import pyarrow as pa

#: Bytes that end a word: space and the five ASCII controls 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Keeps the first k bytes of a little-endian load.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a fresh array."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def join(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts as one string, a newline after each and eight more at the end, and the
    offset of each text (one more offset than texts)."""
    lens = np.fromiter((len(x) for x in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=starts[1:])
    return b"\n".join([*texts, b"\n" * 8]), starts


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, in order, and for each text the
    number of the first word (one more entry than texts).  A word is taken in eight bytes
    at a time, each step mixing all bits so far, so that no arithmetic relation between
    words carries over to their hashes."""
    raw, starts = join(texts)
    raw = raw.translate(_LOWER) if lower else raw
    buf = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    first = np.flatnonzero(edge == -1)
    left = np.flatnonzero(edge == 1) - first  # bytes of each word not yet taken in
    loads = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(left.astype(np.uint64) * _ODD)
        at, who = first, None
        while len(at):
            part = loads[at] & _HEAD[np.minimum(left, 8)]
            now = mix((out if who is None else out[who]) ^ part * _ODD)
            if who is None:
                out = now
            else:
                out[who] = now
            more = np.flatnonzero(left > 8)
            at, left = at[more] + 8, left[more] - 8
            who = more if who is None else who[more]
    return out, np.searchsorted(first, starts)


#: Bytes of text that are hashed at a time, so that few arrays of that length are held.
_HASHED = 1_500_000


def shingle_sets(texts: list[bytes], width: int, lower: bool = True) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `width`-word shingles.  A text with
    fewer words gives its whole word sequence as one shingle; without words, none."""
    out: list[np.ndarray] = []
    at = held = 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= _HASHED or i == len(texts) - 1:
            out += _shingle_sets(texts[at : i + 1], width, lower)
            at, held = i + 1, 0
    return out


def _shingle_sets(texts: list[bytes], width: int, lower: bool) -> list[np.ndarray]:
    words, at = word_hashes(texts, lower)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled = mix(rolled * _ODD + words[k : k + len(rolled)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                h = np.sort(rolled[a : b - width + 1])
                keep = np.empty(len(h), dtype=bool)
                keep[0] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                out.append(h[keep])
            elif b > a:
                h = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    h = mix(h * _ODD + words[k : k + 1])
                out.append(h ^ np.uint64(0x5555))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for each range, all in one; no size is 0."""
    total = int(size.sum())
    step = np.ones(total, dtype=np.int64)
    at = np.cumsum(size)[:-1]
    if total:
        step[0] = first[0]
        step[at] = first[1:] - (first[:-1] + size[:-1] - 1)
    return np.cumsum(step)


_released = 0.0


def steady() -> None:
    """Makes this process give large blocks back as soon as they're freed: Python workers
    stay for later stages, beside executors that need the memory."""
    global _released
    if _released:
        return
    _released = 1.0
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # blocks from here on are mapped by themselves
        libc.mallopt(-1, 16 << 20)  # free memory at the end of the heap that is kept
    except (AttributeError, OSError):
        pass  # another C library


def release(every: float = 8.0) -> None:
    """Hands freed memory back to the system, if that wasn't done in the last seconds."""
    global _released
    steady()
    if time.monotonic() - _released < every:
        return
    _released = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass

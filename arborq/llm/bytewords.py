"""Words of many texts at once, as runs of bytes, with numpy: no Python object a word."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes of a word that fit its key, in numbers of 8 bytes.
KEY_BYTES = 32
PAD = bytes(KEY_BYTES + 8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_FACTORS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _FACTORS[3]
    x ^= x >> _U(29)
    x *= _FACTORS[0]
    x ^= x >> _U(32)
    return x


def runs(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal classes."""
    if not len(classes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.append(0, change), np.append(change, len(classes))


def keys(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The first 8, next 8, ... bytes of each word as numbers, zeros after its end; data ends in PAD. Words of up to KEY_BYTES bytes without a zero byte are equal if their keys are."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = [view[starts] & _MASKS[np.minimum(sizes, 8)]]
    for k in range(8, KEY_BYTES, 8):
        own = np.zeros(len(starts), np.uint64)
        at = np.flatnonzero(sizes > k)
        if len(at):
            own[at] = view[starts[at] + k] & _MASKS[np.minimum(sizes[at] - k, 8)]
        out.append(own)
    return out


def key_hash(parts: list[np.ndarray]) -> np.ndarray:
    h = parts[0] * _FACTORS[0]
    for k in range(1, len(parts)):
        h ^= mix(parts[k] * _FACTORS[k] + _U(k))
    return mix(h)


def hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of any length; data ends in PAD."""
    h = key_hash(keys(data, starts, sizes)) + sizes.astype(np.uint64)
    at, done = np.flatnonzero(sizes > KEY_BYTES), KEY_BYTES
    while len(at):
        rest = sizes[at] - done
        h[at] = mix(h[at] * _FACTORS[1]) ^ key_hash(keys(data, starts[at] + done, rest))
        done += KEY_BYTES
        at = at[rest > KEY_BYTES]
    return h


#: Words for word hashes: ASCII letters and digits, and every byte of other characters.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lower-cased words of all texts one after another, words of each). Words are runs of ASCII letters and digits and of characters beyond ASCII."""
    parts = [t.lower().encode() for t in texts]
    data = b" ".join(parts) + b" " + PAD
    arr = np.frombuffer(data, np.uint8)[: len(data) - len(PAD)]
    starts, ends = runs(_WORD[arr])
    keep = _WORD[arr[starts]]
    starts, ends = starts[keep], ends[keep]
    edges = np.cumsum([0] + [len(p) + 1 for p in parts])
    return hashes(data, starts, ends - starts), np.diff(np.searchsorted(starts, edges)) if len(parts) else np.zeros(0, np.int64)

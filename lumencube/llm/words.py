"""Hashing of the words of whole texts, by a keyed hash of each word (SipHash) and sums over consecutive words."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

#: Keys of two independent word hashes, and the factors by which the hashes of consecutive words are summed.
_KEYS = ("lumencube words0", "lumencube words1")
_BASE = (np.uint64(0x9E3779B97F4A7C17), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes of text that are hashed at once, so that the lists of words stay small beside long texts.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(data: bytes):
    """A text in pieces of about CHUNK bytes that end between words."""
    at = 0
    while len(data) - at > CHUNK:
        cut = _SPACE.search(data, at + CHUNK)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def hash_list(words: list[bytes], which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; which: 0 or 1, two independent ones."""
    box = np.empty(len(words), object)
    box[:] = words
    return pd.util.hash_array(box, hash_key=_KEYS[which], categorize=False)


def word_hashes(data: bytes, lower: bool = False, which: int = 0) -> np.ndarray:
    """hash_list() of the words of a text, which are its runs of bytes other than space and 9 to 13. lower: A-Z count as a-z."""
    found = [hash_list((p.lower() if lower else p).split(), which) for p in pieces(data)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def both_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each word, with one look at the words."""
    found = [(hash_list(w, 0), hash_list(w, 1)) for p in pieces(data) for w in ((p.lower() if lower else p).split(),)]
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def window_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * _BASE[which] + words[k : len(words) - n + 1 + k]
    return mix(total)


_SALT = np.uint64(0xD1B54A32D192ED03)


def bucket_of(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each hash, and 32 bits that tell the hashes of a bucket apart."""
    k = mix(h ^ _SALT)
    return (k % np.uint64(buckets)).astype(np.int64), (k >> np.uint64(32)).astype(np.uint32)


def slots_of(rest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of a filter of `bits` bits for each of those 32-bit values."""
    k = mix(rest.astype(np.uint64) + _SALT)
    return (k & np.uint64(bits - 1)).astype(np.int64), ((k >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def in_filter(field: np.ndarray, bucket: np.ndarray, rest: np.ndarray, bits: int) -> np.ndarray:
    """Whether a filter per bucket, packed to bytes, may hold each value."""
    known = np.ones(len(rest), bool)
    for s in slots_of(rest, bits):
        known &= (field[bucket, s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
    return known


def filter_of(rest: np.ndarray, bits: int) -> bytes:
    field = np.zeros(bits, bool)
    for s in slots_of(rest, bits):
        field[s] = True
    return np.packbits(field).tobytes()


def spread(bucket: np.ndarray):
    """Order of rows by bucket, and (bucket, lo, hi) of each run in that order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    if not len(b):
        return order, []
    edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return order, [(int(b[lo]), int(lo), int(hi)) for lo, hi in zip(edge, np.r_[edge[1:], len(b)], strict=True)]

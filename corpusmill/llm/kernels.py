"""Vectorised text kernels shared by the training-data operators.

All functions work on a slice of texts at a time and keep Python work to one regular-expression
scan and one dictionary lookup per word; everything after that is numpy on flat arrays.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a longest run of letters and digits, in lower case.
WORD = re.compile(r"[^\W_]+")

#: Texts handled at once; the local document number must fit DOC_BITS.
SLICE = 2048
DOC_BITS = 12
TOKEN_BITS = 44
SKETCH_BITS = 22

_U = np.uint64


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it holds `limit` words so that memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[str]:
    """The words of a text; a NULL text has none."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(texts, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Flat word hashes of some texts and the number of words of each."""
    flat: list[int] = []
    n = np.empty(len(texts), np.int64)
    at = cache.__getitem__
    for i, t in enumerate(texts):
        before = len(flat)
        if t:
            flat.extend(map(at, WORD.findall(t.lower())))
        n[i] = len(flat) - before
    return np.array(flat, dtype=np.uint64), n


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of word hashes become well spread."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def ngrams(flat: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, their text's number and the place of their first word in its text."""
    total = len(flat)
    doc = np.repeat(np.arange(len(n)), n)
    if total < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    keep = np.flatnonzero(doc[: total - width + 1] == doc[width - 1 :])
    h = np.zeros(total - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * _U(0x9E3779B97F4A7C15) + flat[k : total - width + 1 + k]
        h = mix(h[keep])
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    return h, doc[keep], keep - start[doc[keep]]


def shingle_sets(flat: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle tokens (TOKEN_BITS wide) ordered by text, and the number of them in each text."""
    h, doc, _ = ngrams(flat, n, width)
    key = (doc.astype(np.uint64) << _U(TOKEN_BITS)) | (h >> _U(64 - TOKEN_BITS))
    # sorting numbers is several times faster here than numpy's hashing of them
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key, np.bincount((key >> _U(TOKEN_BITS)).astype(np.int64), minlength=len(n))


def bucket_of(token: np.ndarray) -> np.ndarray:
    """The sketch cell of a token."""
    return ((token & _U((1 << TOKEN_BITS) - 1)) >> _U(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 256 steps: 0 stays 0, more never ranks before less."""
    return np.minimum(255, np.ceil(10 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


def by_rarity(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens of each text in the global order (rank of the sketch cell, token).

    The text number is dropped: the result is aligned with the counts of shingle_sets.
    """
    doc = key >> _U(TOKEN_BITS)
    token = key & _U((1 << TOKEN_BITS) - 1)
    full = (doc << _U(TOKEN_BITS + 8)) | (rank[bucket_of(key)].astype(np.uint64) << _U(TOKEN_BITS)) | token
    full.sort()
    return full & _U((1 << TOKEN_BITS) - 1)


def least_common(total: np.ndarray, t: float) -> np.ndarray:
    """Shared shingles that two sets of `total` members together need for a Jaccard similarity of t."""
    return np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)


def index_length(n: np.ndarray, t: float, k: int) -> np.ndarray:
    """Prefix that holds the k rarest shared shingles if this is the smaller set of the pair."""
    return np.minimum(n, n - least_common(2 * n, t) + k)


def probe_length(n: np.ndarray, t: float, k: int) -> np.ndarray:
    """The same for the larger set of the pair."""
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + k)


def starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.empty(0, np.int64)


def heads(n: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of n members: indices of the first `length` of each, their run and their place in it."""
    run = np.repeat(np.arange(len(n)), length)
    place = np.arange(len(run)) - np.repeat(starts(length), length)
    return starts(n)[run] + place, run, place


def prefix_pairs(token, doc_n, doc_id, place, t: float, k: int, chunk: int = 2_000_000, side=None):
    """Pairs of documents with shared prefix tokens, after the length and position filters.

    Entries are (token, document, its size, place); one that occurs twice counts once. Yields arrays (smaller
    document, larger document, shared tokens seen), a pair once per yielded chunk. Entries are sorted by token,
    size and id; an entry meets those before it in its run, at most `chunk` pairs at a time, so a hot token costs
    time but no memory. Of the entries of a token with a `side` other than 0 only those of different sides meet.
    """
    if not len(token):
        return
    order = np.lexsort((place, doc_id, doc_n, token))
    token, n, ids, place = token[order], doc_n[order].astype(np.int64), doc_id[order], place[order].astype(np.int64)
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]) | (n[1:] != n[:-1]) | (place[1:] != place[:-1])])
    if not new.all():
        token, n, ids, place = token[new], n[new], ids[new], place[new]
    side = side[order][new] if side is not None and side.any() else None
    fits_index = place < index_length(n, t, k)
    fits_probe = place < probe_length(n, t, k)
    run = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    width = int(n.max()) + 1
    sized = run * width + n
    low = np.searchsorted(sized, run * width + np.ceil(t * n - 1e-9).astype(np.int64))
    here = np.arange(len(token))
    count = np.where(fits_probe, here - low, 0)
    probes = np.flatnonzero(count)
    ends = np.cumsum(count[probes])
    begin = 0
    while begin < len(probes):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + chunk, side="right")))
        sub = probes[begin:end]
        begin = end
        # a single entry can meet more than a chunk of others
        for lo, hi in _spans(low[sub], sub, chunk):
            c = hi - lo
            right = np.repeat(sub, c)
            left = np.arange(c.sum()) - np.repeat(starts(c), c) + np.repeat(lo, c)
            ok = fits_index[left]
            if side is not None:
                ok &= (side[left] == 0) | (side[left] != side[right])
            left, right = left[ok], right[ok]
            need = least_common(n[left] + n[right], t)
            ok = (place[left] < n[left] - need + k) & (place[right] < n[right] - need + k) & (ids[left] != ids[right])
            left, right = left[ok], right[ok]
            if len(left):
                yield counted(ids[left], ids[right])


def _spans(lo: np.ndarray, hi: np.ndarray, chunk: int):
    if len(lo) > 1 or (hi - lo).sum() <= chunk:
        yield lo, hi
        return
    for a in range(int(lo[0]), int(hi[0]), chunk):
        yield np.array([a]), np.array([min(a + chunk, int(hi[0]))])


def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(new)
    return a[at], b[at], np.diff(np.append(at, len(a)))


def shingles(text: str | None, width: int) -> set:
    """Distinct shingles as tuples of words: the exact sets that verification compares."""
    w = words(text)
    return set(zip(*(w[i:] for i in range(width))))


def similarity(a: set, b: set) -> float:
    """Jaccard similarity; 0 if either set is empty."""
    if not a or not b:
        return 0.0
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)

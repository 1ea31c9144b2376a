"""Sets of word shingles as 64-bit numbers, computed over whole batches of text at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
JOIN = U(0xD6E8FEB86659FD93)
SLICE_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves about half the bits of the result."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, A-Z lower-cased, and the bounds of each text among them. Null texts have no words.

    A word's number is the 64-bit XXH3 hash of its bytes: a hash of the whole word, without structure that would make
    two words of some pattern meet.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.values.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(word.lower()) for word in words), U, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if b"" in words:  # white space at either end of a text leaves an empty piece
        real = codes != words.index(b"")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return table[codes], bounds


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``n`` words of each text; with fewer words, the whole sequence as one."""
    value, bounds = word_numbers(texts)
    empty = np.empty(0, U)
    if len(value) >= n:
        gram = value[: len(value) - n + 1].copy()
        for k in range(1, n):
            gram *= JOIN
            gram += value[k : len(value) - n + 1 + k]
        gram = mixed(gram)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            one = U(b - a)
            for x in value[a:b]:
                with np.errstate(over="ignore"):
                    one = one * JOIN + x
            out.append(mixed(np.array([one ^ JOIN], U)))
        else:
            out.append(empty)
    return out


def parts(texts: pa.Array):
    """Slices of a batch of about SLICE_BYTES each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE_BYTES:
            yield at, texts.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(texts):
        yield at, texts.slice(at)

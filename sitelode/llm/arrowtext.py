"""Whole texts in Arrow batches: slices of bounded bytes, words as numbers, stable hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts cut at ASCII white space: word number of each place, distinct words, offsets of the texts.

    With `lower`, A-Z are lower-cased. Null is an empty text.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels misread arrays that start inside a buffer
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets, flat = kept[offsets], flat.filter(full)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, offsets


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def mix(value: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    value = (value ^ (value >> np.uint64(32))) * _MIX
    value = (value ^ (value >> np.uint64(29))) * _MIX
    return value ^ (value >> np.uint64(32))


def chain(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` neighbours."""
    count = max(0, len(hashes) - length + 1)
    value = np.full(count, np.uint64(length))
    for i in range(length):
        value = value * _MIX + hashes[i : i + count]
    return mix(value)


def sorted_inside(owner: np.ndarray, values: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """Order by (owner, kind, value); owners are below 2^20, kinds below 4.

    One fast sort by the owner, the kind and the upper bits of the value decides nearly
    always; where two different values share those bits, all three are sorted.
    """
    key = owner.astype(np.uint64) << np.uint64(44) | values >> np.uint64(22)
    if kind is not None:
        key |= kind.astype(np.uint64) << np.uint64(42)
    order = np.argsort(key)
    key, ordered = key[order], values[order]
    if ((key[1:] == key[:-1]) & (ordered[1:] != ordered[:-1])).any():
        return np.lexsort((values, owner) if kind is None else (values, kind, owner))
    return order


def shingle_sets(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending inside a text, and the offsets of the texts.

    A text with fewer words than `length` has one shingle, its whole sequence; one without words has none.
    """
    places, distinct, offsets = words(texts, lower=True)
    hashes = word_hashes(distinct)[places] if len(places) else np.empty(0, np.uint64)
    counts = np.diff(offsets)
    whole = chain(hashes, length)
    starts, n_windows = offsets[:-1], np.maximum(0, counts - length + 1)
    owner = np.repeat(np.arange(len(counts)), n_windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    value = whole[starts[owner] + inside]
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        extra = np.array(
            [chain(hashes[offsets[i] : offsets[i + 1]], int(counts[i]))[0] for i in short], dtype=np.uint64
        )
        owner, value = np.concatenate([owner, short]), np.concatenate([value, extra])
    order = sorted_inside(owner, value)
    owner, value = owner[order], value[order]
    if len(value):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
        owner, value = owner[new], value[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64)

"""Word n-grams of Arrow text columns as 64-bit hashes, with numpy over the column's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one pass of numpy takes; a longer text is taken in blocks that end between words.
BLOCK_BYTES = 1 << 19
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
#: What a gram of so many words adds to its hash.
LENGTHS = np.arange(64, dtype=np.uint64) * GOLDEN

#: Bytes of words: letters and digits of ASCII, and all of longer characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; ``keep`` marks the bytes of all runs."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
    body = (data[keep].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(body, firsts) + lengths.astype(np.uint64) * GOLDEN)


def _runs(data: np.ndarray, breaks: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of kept bytes start and how long they are; ``breaks`` also start a run."""
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = keep[1:] != keep[:-1]
    edge[0] = edge[-1] = True
    edge[breaks] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = keep[starts]
    return starts[word], (ends - starts)[word]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has; text i is data[offsets[i]:offsets[i + 1]]."""
    hashes, counts, i, n = [], np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * BLOCK_BYTES:
            part = data[lo:hi]
            if hi > lo:
                keep = WORD_BYTE[part]
                starts, lengths = _runs(part, (offsets[i : j + 1] - lo), keep)
                hashes.append(hash_runs(part, starts, lengths, keep))
                edges = np.searchsorted(starts, offsets[i : j + 1] - lo)
                edges[-1] = len(starts)
                counts[i:j] = np.diff(edges)
        else:  # one long text
            at = lo
            while at < hi:
                end = min(hi, at + BLOCK_BYTES)
                while end < hi and WORD_BYTE[data[end]]:
                    end += 1
                part = data[at:end]
                keep = WORD_BYTE[part]
                starts, lengths = _runs(part, np.zeros(0, np.int64), keep)
                hashes.append(hash_runs(part, starts, lengths, keep))
                counts[i] += len(starts)
                at = end
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.utf8_lower(column) if lower else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def gram_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct n-grams of words, hashed and sorted.

    A text of fewer words has one gram of all its words, and one without words has none.
    """
    data, offsets = text_bytes(column)
    words, counts = word_hashes(data, offsets)
    factors = powers(n, 0xD6E8FEB86659FD93)
    at = 0
    for k in counts.tolist():
        w = words[at : at + k]
        at += k
        if not k:
            yield np.zeros(0, np.uint64)
            continue
        m = min(k, n)
        grams = np.zeros(k - m + 1, np.uint64)
        for j in range(m):
            grams += w[j : k - m + 1 + j] * factors[j]
        yield np.unique(mix(grams + LENGTHS[m]))

"""Words of texts straight from Arrow's buffers: bounds between ASCII white space, and hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are taken at once; a longer text is taken as a whole.
PORTION = 1 << 18
#: Masks of the first k bytes of eight.
_HEADS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def mix(x: np.ndarray, k: int) -> np.ndarray:
    """Another order of the 64-bit numbers, in which all bits depend on all."""
    x = x * U(k)
    x ^= x >> U(32)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def portions(texts: pa.Array, size: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes of whole texts, about `size` at a time, where each begins, and the row of the first. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32, len(texts) + 1, texts.offset * (8 if large else 4)).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.array([], np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row], row
        row = end


def bounds(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word spans two texts."""
    outside = np.ones(len(data) + 2, bool)
    outside[1:-1] = (data == 32) | ((data - np.uint8(9)) <= 4)
    edges = np.flatnonzero(outside[1:] != outside[:-1])  # places whose left neighbour is of the other kind: starts and ends in turn
    starts, ends = edges[::2], edges[1::2]
    cut = begins[(begins > 0) & (begins < len(data))]
    cut = np.unique(cut[~outside[1:][cut] & ~outside[:-1][cut]])  # texts that meet without white space
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


class Lanes:
    """Eight bytes from any place of data, as numbers; what stands past the end is zero."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        self.at = np.ndarray((len(data) + 8,), "<u8", buffer=padded, strides=(1,))

    def head(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """The first bytes from starts on, 8 at most."""
        return self.at[starts] & _HEADS[sizes]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from starts to ends."""
        size = ends - starts
        h = mix(self.head(starts, np.minimum(size, 8)) + size.astype(U) * U(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F)
        more, done = np.flatnonzero(size > 8), 8
        while len(more):
            part = self.head(starts[more] + done, np.minimum(size[more] - done, 8))
            h[more] = mix(h[more] ^ (part * U(0x165667B19E3779F9) + U(done)), 0xD6E8FEB86659FD93)
            done += 8
            more = more[size[more] > done]
        return h

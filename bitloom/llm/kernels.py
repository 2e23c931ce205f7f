"""Vectorised text kernels over Arrow string columns.

Every kernel works on the UTF-8 bytes of a run of documents at once, so the cost
is a few numpy passes over the bytes and no Python loop over words.  Words are
maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; ``A-Z`` is
lower-cased bytewise, which never touches a multi-byte character.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Base of the polynomial hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that a kernel takes at once (a longer document is taken whole).
SPAN = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes outside words made of ASCII letters, digits and any other script's letters.
PUNCT = np.ones(256, dtype=bool)
PUNCT[np.r_[48:58, 65:91, 97:123, 128:256]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of a constant modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            steps = np.full(max(n, SPAN + 1), self.base, dtype=U64)
            steps[0] = 1
            self.table = np.multiply.accumulate(steps)
        return self.table


POWERS, INVERSES = _Powers(BASE), _Powers(BASE_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    column = column.cast(pa.large_string()).cast(large) if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else column.cast(large)
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = SPAN, most: int = 50_000):
    """Runs ``(first, last)`` of at most ``most`` documents and ``limit`` bytes, one document at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, at + most)
        yield at, to
        at = to


def pieces(batches, column: int, limit: int = 1 << 22):
    """The batches in slices of about ``limit`` bytes of text (a longer text is a slice of its own),
    so that what a kernel makes of one stays under the limits of Arrow's offsets."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        for a, b in spans(offsets, limit, len(size)) if len(size) else [(0, 0)]:
            yield batch.slice(a, b - a)


class Words:
    """Words of a run of documents: ``start``/``end`` byte offsets, ``hash`` and
    ``first`` (index of each document's first word, one entry more than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        gap = np.ones(n + 2, dtype=bool)
        gap[1:-1] = space[data]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins, ends = gap[:-2] & ~gap[1:-1], gap[2:] & ~gap[1:-1]
        if len(inner):
            begins[inner[~gap[inner + 1]]] = True
            ends[inner[~gap[inner]] - 1] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def docs(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * POWERS.upto(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hash of each byte span, equal for equal contents and lengths."""
    inv = INVERSES.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, whole_if_short: bool = True):
    """Hashes of the k-word shingles of each document and the index of each's document.

    A document with fewer than k words has its whole sequence as one shingle if
    ``whole_if_short``; one without words has none."""
    n, counts = len(hashes), np.diff(first)
    total = np.zeros(max(0, n), dtype=U64)
    weight = U64(0xA0761D6478BD642F)
    for j in range(k):
        w = U64(pow(0xA0761D6478BD642F, k - 1 - j, 1 << 64))
        if j < n:
            total[: n - j] += hashes[j:] * w
    docs = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - first[:-1][docs] if n else np.zeros(0, np.int64)
    full = place + k <= counts[docs] if n else np.zeros(0, bool)
    out, where = mix(total[full] ^ weight), docs[full]
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            # few words each: a short loop over the word's place
            acc = np.zeros(len(short), dtype=U64)
            for j in range(k - 1):
                has = counts[short] > j
                acc[has] = acc[has] * weight + hashes[first[:-1][short[has]] + j]
            extra = mix(acc * weight + counts[short].astype(U64))
            out, where = np.concatenate([out, extra]), np.concatenate([where, short])
            order = np.argsort(where, kind="stable")
            out, where = out[order], where[order]
    return out, where


def distinct_by_doc(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted by document and value; ``docs`` is ascending."""
    values = values.copy()
    edges = np.flatnonzero(np.diff(docs, prepend=-1, append=docs[-1] + 1 if len(docs) else 0))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    return values[keep], docs[keep]


def ragged(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """A list column whose rows take ``counts`` consecutive values each."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def blobs(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows take ``counts`` consecutive bytes each."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data, dtype=np.uint8))])


def arange_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)`` for each run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)

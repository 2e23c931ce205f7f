"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Every text is covered by windows about as long as a benchmark item.  Windows start
at content-defined words (the smallest word hash among eight in a row), so a copied
passage is cut at the same words wherever it stands.  A window's 64-bit SimHash is
looked up in four 16-bit blocks: fingerprints within distance 7 agree in one block
up to one bit, so each block and its one-bit neighbours are looked up among the items'
fingerprints, which are filed by block, and only those in these files are compared.
None within the radius is missed, and the work of a window hardly grows with the
benchmark.  What is found is verified by the share of the item's five-word shingles, weighted by
their length, that stand in the text around that place.

Windows alone miss truncated and edited copies.  So each item also lists its rarest
shingles until they weigh more than a copy may lack: any text that holds enough of
the item holds one of these.  A text with one is verified in its densest stretch.

One pass over the texts, without a shuffle.  Only the index of the benchmark
travels with the tasks, at most ``max_items`` items of it at a time; a larger
benchmark takes several passes.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from bitloom.llm import kernels as K

ANCHOR = 8
RADIUS = 7
SHINGLE = 5
SPAN = 1 << 18

FOUND = ArrayType(StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("word_at", LongType())]))


def window_sizes(n: int) -> tuple[int, int]:
    """Words of the window for an item of n words, and the stretch that must hold its start.

    Sizes lie on a grid of ratio 1.35, so that all items share a few sizes; items
    under 16 words take windows of their own size at every word."""
    if n < 2 * ANCHOR:
        return n, 1
    size = ANCHOR + 1
    while max(size + 1, int(size * 1.35)) <= n - ANCHOR + 1:
        size = max(size + 1, int(size * 1.35))
    return size, ANCHOR


def bit_sums(hashes: np.ndarray, wide: bool) -> np.ndarray:
    """Running counts of the one bits of word hashes, side by side in lanes of 8 bits
    (16 if ``wide``) of 64-bit integers.  A difference of two rows is exact modulo
    2**64, so its lanes are right for any window that a lane can count."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    lanes = bits.astype(np.uint16).view(np.uint64) if wide else bits.view(np.uint64)
    out = np.zeros((len(hashes) + 1, lanes.shape[1]), dtype=np.uint64)
    np.cumsum(lanes, axis=0, out=out[1:])
    return out


def simhash(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Bit i is set where more than half of the window's words have it set."""
    ones = (sums[start + size] - sums[start]).view(np.uint16 if sums.shape[1] == 16 else np.uint8)
    return np.packbits(ones > size // 2, axis=1).view(np.uint64).ravel()


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Places of the leftmost smallest hash of any eight words in a row."""
    if len(hashes) < ANCHOR:
        return np.zeros(0, dtype=np.int64)
    key = K.mix(hashes ^ K.U64(0x5851F42D4C957F2D))
    low = key.copy()
    step = 1
    while step < ANCHOR:
        low[:-step] = np.minimum(low[:-step], low[step:])
        step *= 2
    low = low[: len(key) - ANCHOR + 1]
    marks = np.zeros(len(key), dtype=bool)
    left = np.zeros(len(low), dtype=bool)
    for j in range(ANCHOR):  # leftmost place of the minimum of each stretch
        here = (key[j : j + len(low)] == low) & ~left
        marks[np.flatnonzero(here) + j] = True
        left |= here
    return np.flatnonzero(marks)


FLIPS = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint16)


class Files:
    """Fingerprints filed by each of their four 16-bit blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints, blocks = prints, prints.view(np.uint16).reshape(-1, 4)
        self.order = np.argsort(blocks, axis=0, kind="stable").T.astype(np.int32)
        #: places of a block's file: from ``begin[j, block]`` to ``begin[j, block + 1]``
        self.begin = np.stack([np.searchsorted(np.sort(blocks[:, j]), np.arange((1 << 16) + 1)) for j in range(4)]).astype(np.int32)
        self.near = np.zeros((4, 1 << 16), dtype=bool)  # blocks with a print up to one bit away
        for j in range(4):
            self.near[j, (blocks[:, j][:, None] ^ FLIPS[None]).ravel()] = True

    def within(self, found: np.ndarray, most: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, print, distance) of all pairs up to ``most`` apart."""
        blocks, out = found.view(np.uint16).reshape(-1, 4), []
        for j in range(4):
            hit = np.flatnonzero(self.near[j, blocks[:, j]])
            for part in np.array_split(hit, len(hit) // 8192 + 1):
                key = blocks[part, j][:, None] ^ FLIPS[None]
                low, n = self.begin[j, key], self.begin[j, key.astype(np.int32) + 1]
                n = n - low
                window = np.repeat(part, n.sum(axis=1))
                pick = self.order[j, K.arange_runs(low.ravel().astype(np.int64), n.ravel().astype(np.int64))]
                apart = np.bitwise_count(found[window] ^ self.prints[pick])
                close = np.flatnonzero(apart <= most)
                out.append(np.stack([window[close], pick[close], apart[close]]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
        return pairs[0], pairs[1], pairs[2]


class Index:
    """Fingerprints of benchmark items by window size."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, least: float = 0.8):
        self.least = least
        data, offsets = K.utf8(pc.utf8_lower(texts))
        words = K.Words(data, offsets, space=K.PUNCT)
        length = (words.end - words.start).astype(float)
        by_size: dict[tuple[int, int], list] = {}
        self.items = {}
        for i in np.flatnonzero(words.counts):
            a, b = words.first[i], words.first[i + 1]
            h, n = words.hash[a:b], int(b - a)
            size, stretch = window_sizes(n)
            place = anchors(h) if stretch > 1 else np.zeros(1, np.int64)
            place = place[place + size <= n]
            shingle, _ = K.shingles(h, np.array([0, n]), SHINGLE)
            run = np.concatenate([[0], np.cumsum(length[a:b])])
            weight = run[SHINGLE:] - run[:-SHINGLE] if n >= SHINGLE else np.array([run[-1]])
            shingle, first = np.unique(shingle, return_index=True)
            self.items[int(i)] = (int(ids[i]), n, shingle, weight[first] / weight[first].sum(), first)
            prints = simhash(bit_sums(h, size > 255), place, size)
            by_size.setdefault((size, stretch), []).extend((int(i), int(p), int(f)) for p, f in zip(place, prints))
        self.sizes = {size: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), Files(np.array([r[2] for r in rows], dtype=np.uint64))) for size, rows in by_size.items()}
        self._sign()

    def _sign(self) -> None:
        """Marks of the items by words hashed at once: a table of low bits, the sorted hashes and the items of each."""
        kinds, counts = np.unique(np.concatenate([x[2] for x in self.items.values()] or [np.zeros(0, np.uint64)]), return_counts=True)
        by_words: dict[int, list] = {}
        for i, (_, n, shingle, weight, _) in self.items.items():
            rare = np.lexsort((-weight, counts[np.searchsorted(kinds, shingle)]))
            enough = int(np.searchsorted(np.cumsum(weight[rare]), 1 - self.least + 1e-9, side="right")) + 1
            by_words.setdefault(min(n, SHINGLE), []).extend((int(h), i) for h in shingle[rare[:enough]])
        self.marks = {}
        for k, rows in by_words.items():
            rows.sort()
            marks = np.array([h for h, _ in rows], dtype=np.uint64)
            table = np.zeros(1 << max(16, (8 * len(rows)).bit_length()), dtype=bool)
            table[marks & np.uint64(len(table) - 1)] = True
            self.marks[k] = (table, marks, np.array([i for _, i in rows]))

    def search(self, texts) -> list[list[tuple[int, float, int]]]:
        """For each text: (item_id, similarity, first word) of the items it holds."""
        data, offsets = K.utf8(pc.utf8_lower(texts))
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        for a, b in K.spans(offsets, SPAN):
            words = K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], space=K.PUNCT)
            if not len(words.hash):
                continue
            sums, docs, ends = {}, words.docs(), words.first[1:]
            at = anchors(words.hash)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for (size, stretch), (item, place, files) in self.sizes.items():
                start = at if stretch > 1 else np.arange(len(words.hash))
                start = start[start + size <= ends[docs[start]]]
                if not len(start):
                    continue
                if (wide := size > 255) not in sums:
                    sums[wide] = bit_sums(words.hash, wide)
                x, y, apart = files.within(simhash(sums[wide], start, size))
                closest = np.argsort(apart, kind="stable")  # whole copies settle the rest
                for x, y in zip(x[closest].tolist(), y[closest].tolist()):
                    p = int(start[x])
                    self._verify(words, int(docs[p]), p - int(place[y]), int(item[y]), best)
            self._marked(words, docs, best)
            for (doc, _), (sim, p, item_id) in sorted(best.items()):
                out[a + doc].append((item_id, sim, p))
        return out

    def _verify(self, words, doc: int, start: int, item: int, best: dict) -> None:
        if best.get((doc, item), (0.0, 0, 0))[0] >= 1.0:  # several windows lead to one passage
            return
        item_id, n, shingle, weight, _ = self.items[item]
        low, high = int(words.first[doc]), int(words.first[doc + 1])
        slack = n // 10 + 1
        a, b = max(low, start - slack), min(high, start + n + slack)
        seen = words.hash[a:b]
        if n < SHINGLE:
            seen = words.hash[max(low, start) : min(high, start + n)]
        own, _ = K.shingles(seen, np.array([0, len(seen)]), SHINGLE)
        sim = float(weight[np.isin(shingle, own)].sum())
        if sim > best.get((doc, item), (0.0, 0, 0))[0]:
            best[doc, item] = (min(1.0, round(sim, 12)), max(0, start - low), item_id)

    def _marked(self, words, docs: np.ndarray, best: dict) -> None:
        """Verifies the items that have a mark in a text, wherever it stands."""
        for k, (table, marks, items) in self.marks.items():
            at, hashes = runs(words, docs, k)
            hit = np.flatnonzero(table[hashes & np.uint64(len(table) - 1)])
            a, b = np.searchsorted(marks, hashes[hit]), np.searchsorted(marks, hashes[hit], side="right")
            pairs = np.stack([np.repeat(docs[at[hit]], b - a), items[K.arange_runs(a, b - a)]], axis=1)
            for doc, item in np.unique(pairs, axis=0).tolist():
                before = best.get((doc, item), (0.0, 0, 0))[0]
                if before >= 1.0:
                    continue
                item_id, n, shingle, weight, first = self.items[item]
                low, high = np.searchsorted(at, words.first[doc : doc + 2])
                kind = np.minimum(np.searchsorted(shingle, hashes[low:high]), len(shingle) - 1)
                place = np.flatnonzero(shingle[kind] == hashes[low:high])
                kind = kind[place]
                if round(float(weight[np.unique(kind)].sum()), 12) < self.least:
                    continue
                x, y = densest(place, weight[kind], kind, n - k + 2 * (n // 10 + 1) if n >= SHINGLE else 0)
                sim = min(1.0, round(float(weight[np.unique(kind[x:y])].sum()), 12))
                if sim > before:
                    best[doc, item] = (sim, max(0, int(place[x] - first[kind[x]])), item_id)


def runs(words, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of k words inside a text, as an item's shingles are hashed."""
    at = np.arange(len(words.hash))
    at = at[at + k <= words.first[1:][docs]]
    if k == SHINGLE:
        return at, K.shingles(words.hash, words.first, k, whole_if_short=False)[0]
    flat = words.hash[(at[:, None] + np.arange(k)).ravel()]
    return at, K.shingles(flat, np.arange(len(at) + 1) * k, SHINGLE)[0]


def densest(place: np.ndarray, weight: np.ndarray, kind: np.ndarray, reach: int) -> tuple[int, int]:
    """First and last (exclusive) of the places at most ``reach`` apart whose different kinds weigh most."""
    if place[-1] - place[0] <= reach:
        return 0, len(place)
    last = np.searchsorted(place, place + reach, side="right").tolist()
    weight, kind = weight.tolist(), kind.tolist()
    seen: dict[int, int] = {}
    total, top, out, y = 0.0, -1.0, (0, 1), 0
    for x, stop in enumerate(last):
        for j in range(y, stop):
            if not seen.get(kind[j]):
                total += weight[j]
            seen[kind[j]] = seen.get(kind[j], 0) + 1
        y = stop
        if total > top + 1e-9:
            top, out = total, (x, stop)
        seen[kind[x]] -= 1
        if not seen[kind[x]]:
            total -= weight[x]
    return out


def _pass(docs: DataFrame, index: Index, least: float, text_col: str, found_col: str, more: bool) -> DataFrame:
    """One pass over the texts; ``more`` adds to what the pass before has found."""
    schema = docs.schema if more else StructType([*docs.schema.fields, StructField(found_col, FOUND)])
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in K.pieces(batches, place):
            got = [[{"item_id": i, "similarity": s, "word_at": w} for i, s, w in row if s >= least] for row in index.search(batch.column(place))]
            columns = list(batch.columns)
            if more:
                got = [old + new for old, new in zip(columns.pop().to_pylist(), got)]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("word_at", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, type=kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def find_items(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, max_items: int = 20_000, max_bytes: int = 1 << 25, text_col: str = "text", found_col: str = "_items") -> DataFrame:
    """``docs`` and an array of ``(item_id, similarity, word_at)`` of the items that each text holds.

    Words are runs of letters and digits in lower case, so case and marks don't
    matter.  ``similarity`` is the weighted share of the item's five-word shingles found
    around that place, at least ``least``; every such item is found, also truncated or edited.  Items without words and null items are
    never found; an item under five words counts as one shingle.  Null and empty
    texts hold nothing.  An item's copies are all reported; repeated rows are
    treated alike; empty tables on either side give empty arrays.  An input column
    ``found_col`` is replaced.  A pass takes about ``max_items`` items or ``max_bytes`` of
    their text; larger benchmarks take more passes.
    """
    docs = docs.drop(found_col)
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // max_items), -(-size["bytes"] // max_bytes))
    for i in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        got = part.orderBy("item_id").toArrow().combine_chunks()
        ids = got.column("item_id").to_numpy() if got.num_rows else np.zeros(0, np.int64)
        texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
        docs = _pass(docs, Index(ids, texts, least), least, text_col, found_col, i > 0)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = found.select("doc_id", F.explode("_items").alias("x"))
    return hits.groupBy("doc_id", F.col("x.item_id").alias("item_id")).agg(F.max("x.similarity").alias("similarity"), F.min("x.word_at").alias("word_at"))

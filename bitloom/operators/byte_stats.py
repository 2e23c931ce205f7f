"""Byte statistics, code lengths and candidate sizes of texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from bitloom.functions.bits import bits_for_count
from bitloom.operators.transforms import PIECE, Texts, blobs, byte_texts, counts_of, runs_of

#: Methods by number.
METHODS = ("raw-copy", "indexed-raw", "indexed-circuit", "indexed-huffman", "raw-deflate", "raw-zstd", "framed-raw", "recursive-circuit-xz", "monotonic-delta", "raw-xz")
#: The order in which candidates are compared; on ties the earlier stays.
ORDER = ("raw-copy", "indexed-raw", "indexed-circuit", "indexed-huffman", "raw-deflate", "raw-zstd", "raw-xz", "framed-raw", "recursive-circuit-xz", "monotonic-delta")
HEADER = 36


def byte_counts(df: DataFrame) -> DataFrame:
    """``k, bytes`` -> ``k, b, freq``: how often each byte occurs in each row, counted in passes over
    the bytes of a batch; nothing is shuffled."""
    kind = df.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for t in runs_of(batch.column(1)):
                n = counts_of(t)
                row, byte = np.nonzero(n)
                items = pa.StructArray.from_arrays([pa.array(byte.astype(np.int32)), pa.array(n[row, byte].astype(np.int64))], names=["b", "freq"])
                offsets = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["k", "counts"])
                at += len(n)

    return df.select("k", "bytes").mapInArrow(run, f"k {kind}, counts array<struct<b:int,freq:bigint>>").select("k", F.inline("counts"))


def histogram(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``k, b, freq``: how often each byte occurs in the texts of each key."""
    return byte_counts(byte_texts(df, key, text)).groupBy("k", "b").agg(F.sum("freq").alias("freq"))


def byte_masks(df: DataFrame) -> DataFrame:
    """``k, bytes`` -> ``k, size, m0, m1, m2, m3``: which bytes occur in each row, as the bits of four integers."""
    kind = df.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for t in runs_of(batch.column(1)):
                words = np.packbits(counts_of(t) > 0, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(words)), pa.array(t.sizes), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)]], names=["k", "size", "m0", "m1", "m2", "m3"])
                at += len(words)

    return df.select("k", "bytes").mapInArrow(run, f"k {kind}, size long, m0 long, m1 long, m2 long, m3 long")


def symbol_ids(hist: DataFrame) -> DataFrame:
    """Each byte's id: its rank in the text's sorted alphabet."""
    return hist.withColumn("id", (F.dense_rank().over(Window.partitionBy("k").orderBy("b")) - 1).cast("int"))


def index_sizes(hist: DataFrame) -> DataFrame:
    """Sizes of the raw copy and of fixed-width ids: ``k, n, symbols, bits, raw, indexed``."""
    s = hist.groupBy("k").agg(F.sum("freq").cast("long").alias("n"), F.count("*").alias("symbols"))
    s = s.withColumn("bits", bits_for_count(F.col("symbols")))
    return s.select("k", "n", "symbols", "bits", (F.col("n") + HEADER).alias("raw"), (F.ceil(F.col("n") * F.col("bits") / 8) + F.col("symbols") + HEADER).alias("indexed"))


def _packed(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's bytes as ids of as few bits as its alphabet needs, low bits first: the joined
    payloads, their sizes, and the bits of an id."""
    there = counts_of(t) > 0
    symbols = there.sum(axis=1)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(symbols, 1)))).astype(np.int64)
    ids = (np.cumsum(there, axis=1) - 1).astype(np.uint8)
    # a piece has a whole number of bytes, as its ids are a multiple of eight
    out = [
        np.packbits(np.unpackbits(ids[row][x[at : at + PIECE]][:, None], axis=1, count=width, bitorder="little").ravel(), bitorder="little")
        for row, (x, width) in enumerate(zip(t, bits.tolist())) for at in range(0, len(x), PIECE)
    ]
    return np.concatenate([np.zeros(0, np.uint8), *out]), (t.sizes * bits + 7) // 8, bits


def index_payload(df: DataFrame) -> DataFrame:
    """``k, bytes`` -> ``k, bits, payload``: ids of each text's bytes (ranks in its sorted alphabet),
    packed low bits first.  Empty texts have an empty payload."""
    kind = df.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for t in runs_of(batch.column(1)):
                body, size, bits = _packed(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(size)), pa.array(bits.astype(np.int32)), blobs(body, size)], names=["k", "bits", "payload"])
                at += len(size)

    return df.select("k", "bytes").mapInArrow(run, f"k {kind}, bits int, payload binary")


def _lengths(freq: list[int]) -> list[int]:
    """Code lengths of a minimum-redundancy code; ties go to the node made first."""
    n = len(freq)
    if n == 1:
        return [1]
    order = sorted(range(n), key=freq.__getitem__)
    weight, up, leaf, node = [freq[i] for i in order], [0] * (2 * n - 1), 0, n
    for made in range(n, 2 * n - 1):  # made nodes come in order of weight, so the least is the next leaf or the next node
        total = 0
        for _ in range(2):
            if leaf < n and (node == made or weight[leaf] <= weight[node]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, node = node, node + 1
            up[pick] = made
            total += weight[pick]
        weight.append(total)
    depth, out = [0] * (2 * n - 1), [0] * n
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[up[i]] + 1
    for i, at in enumerate(order):
        out[at] = depth[i]
    return out


@F.arrow_udf(returnType=ArrayType(IntegerType()))
def _lengths_of(freqs: pa.Array) -> pa.Array:
    made, ends = [], [0]
    for at in range(0, len(freqs), 1024):
        for freq in freqs.slice(at, 1024).to_pylist():
            made.extend(_lengths(freq))
            ends.append(len(made))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made, pa.int32()))


def code_tables(hist: DataFrame) -> DataFrame:
    """``k, codes``: one row a text with an array of its ``b, freq, length``, at most 256."""
    met = hist.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("b", "freq"))).alias("_s"))
    met = met.withColumn("_l", _lengths_of(F.col("_s.freq")))
    return met.select("k", F.zip_with("_s", "_l", lambda s, n: F.struct(s["b"].alias("b"), s["freq"].alias("freq"), n.alias("length"))).alias("codes"))


def code_lengths(hist: DataFrame) -> DataFrame:
    """``k, b, freq, length`` of a minimum-redundancy code for each text."""
    return code_tables(hist).select("k", F.inline("codes"))


def coded_sizes(tables: DataFrame) -> DataFrame:
    """Sizes of the raw copy, of fixed-width ids and of code words, inside the row of a text:
    ``k, n, symbols, coded_bits, raw, indexed, huffman, codes``."""
    total = lambda f: F.aggregate("codes", F.lit(0).cast("long"), lambda t, c: t + f(c))
    s = tables.select("k", total(lambda c: c["freq"]).alias("n"), F.size("codes").cast("long").alias("symbols"), total(lambda c: c["freq"] * c["length"]).alias("coded_bits"), "codes")
    indexed = F.ceil(F.col("n") * bits_for_count(F.col("symbols")) / 8) + F.col("symbols") + HEADER
    huffman = F.ceil(F.col("coded_bits") / 8) + F.col("symbols") * 2 + HEADER
    return s.select("k", "n", "symbols", "coded_bits", (F.col("n") + HEADER).alias("raw"), indexed.alias("indexed"), huffman.alias("huffman"), "codes")


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """Canonical codes in closed form: the sum of the code space that earlier symbols take."""
    order = Window.partitionBy("k").orderBy("length", "b").rowsBetween(Window.unboundedPreceding, -1)
    space = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("length"))).over(order), F.lit(0.0))
    return lengths.withColumn("code", (space * F.pow(F.lit(2.0), F.col("length"))).cast("long"))


def huffman_sizes(lengths: DataFrame) -> DataFrame:
    """``k, coded_bits, huffman``: two bytes a symbol, then the codes."""
    s = lengths.groupBy("k").agg(F.sum(F.col("freq") * F.col("length")).cast("long").alias("coded_bits"), F.count("*").alias("_s"))
    return s.select("k", "coded_bits", (F.ceil(F.col("coded_bits") / 8) + F.col("_s") * 2 + HEADER).alias("huffman"))


def choose(candidates: DataFrame) -> DataFrame:
    """The smallest of ``k, method, total``; a circuit dictionary must save over one per cent
    of the best size before it."""
    rank = F.array_position(F.array(*[F.lit(m) for m in ORDER]), F.col("method"))
    rows = candidates.where("total IS NOT NULL").withColumn("rank", rank)
    plain = F.col("method") != "indexed-circuit"
    least = lambda cond: F.min(F.when(cond, F.struct("total", "rank", "method")))
    best = rows.groupBy("k").agg(least(plain & (F.col("rank") <= 2)).alias("early"), least(plain & (F.col("rank") > 2)).alias("late"), least(~plain).alias("circuit"))
    best = best.where("early IS NOT NULL OR late IS NOT NULL")
    saves = F.col("circuit.total") < F.col("early.total") - F.floor(F.col("early.total") / 100)
    first = F.when(F.coalesce(saves, F.lit(False)), F.col("circuit")).otherwise(F.col("early"))
    win = F.when(F.col("late").isNotNull() & (F.col("late.total") < first["total"]), F.col("late")).otherwise(first)
    return best.select("k", win["method"].alias("method"), win["total"].alias("total"))

"""Texts as chunks and restartable blocks, in batch and as a stream."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.bits import bits_for_count
from bitloom.operators.byte_stats import HEADER, byte_counts, byte_masks


def text_chunks(df: DataFrame, key: Column, text: Column, size: int) -> DataFrame:
    """Fixed-size pieces of each text's bytes: ``k, chunk, size, hex``; empty texts have none."""
    rows = df.select(key.alias("k"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("_d")).where(F.octet_length("_d") > 0)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("_d") - 1) / size))))
    part = F.substring("_d", (F.col("chunk") * size + 1).cast("int"), F.lit(size))
    return rows.select("k", F.col("chunk").cast("long").alias("chunk"), F.octet_length(part).alias("size"), part.alias("bytes"))


def joined(chunks: DataFrame) -> DataFrame:
    """``k, bytes, size, chunks``: each key's chunks put together in their order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.hex("bytes").alias("hex"))))
    made = chunks.groupBy("k").agg(parts.alias("_p"), F.sum("size").cast("long").alias("size"), F.count("*").alias("chunks"))
    return made.select("k", F.unhex(F.array_join(F.transform("_p", lambda c: c["hex"]), "")).alias("bytes"), "size", "chunks")


def resume(chunks: DataFrame, start: int, interval: int) -> DataFrame:
    """What a reader gets who begins at chunk ``start``, which must begin a block of ``interval``
    chunks.  The chunks before are filtered out, not read over."""
    if interval < 1 or start < 0 or start % interval:
        raise ValueError(f"chunk {start} does not begin a block of {interval}")
    return joined(chunks.where(F.col("chunk") >= start))


def block_methods(df: DataFrame, key: Column, text: Column, size: int) -> DataFrame:
    """The smaller of raw bytes and fixed-width ids for each block: ``k, block, method``."""
    pieces = text_chunks(df, key, text, size).select(F.struct("k", "chunk").alias("k"), "bytes")
    rows = byte_counts(pieces).groupBy("k").agg(F.sum("freq").alias("n"), F.count("*").alias("s"))
    rows = rows.select("k.k", F.col("k.chunk").alias("block"), "n", "s")
    indexed = F.ceil(F.col("n") * bits_for_count(F.col("s")) / 8) + F.col("s")
    return rows.select("k", "block", F.when(indexed < F.col("n"), "indexed-raw").otherwise("raw-copy").alias("method"))


def carried(blocks: DataFrame) -> DataFrame:
    """Each block with the method of the block before it."""
    return blocks.withColumn("before", F.lag("method").over(Window.partitionBy("k").orderBy("block")))


PIECE, GROUP, SPLIT = 10, 18, 2
MASKS = ("m0", "m1", "m2", "m3")


def best_groups(chunks: DataFrame, interval: int) -> DataFrame:
    """How to group the chunks of each block of ``interval`` so that the whole is smallest.

    A block is one row with the size and the set of bytes of each of its chunks.  The cost of
    a range of neighbouring chunks as one group (fixed-width ids of its bytes) is an
    expression over these; ranges are joined to longer ones, shortest first, and a split is
    taken where it is strictly smaller.  ``k, block, chunks, best, plain``: the block at its
    best, and as single pieces.  A block that lacks a chunk has no row."""
    rows = byte_masks(chunks.select(F.struct("k", "chunk").alias("k"), "bytes")).select("k.k", "k.chunk", "size", *MASKS).where("size > 0 AND k IS NOT NULL")
    rows = rows.withColumn("block", F.floor(F.col("chunk") / interval)).withColumn("i", (F.col("chunk") % interval).cast("int"))
    here = lambda i, x: F.when(F.col("i") == i, F.col(x))
    parts = [f(here(i, x)).alias(f"{x}_{i}") for i in range(interval) for x, f in (("size", F.sum), *((m, F.bit_or) for m in MASKS))]
    block = rows.groupBy("k", "block").agg((F.max("i") + 1).alias("chunks"), *parts)
    there = sum(F.col(f"size_{i}").isNotNull().cast("int") for i in range(interval))
    block = block.where(there == F.col("chunks"))

    def cost(lo: int, hi: int) -> Column:
        n = reduce(add, [F.col(f"size_{i}") for i in range(lo, hi)])
        s = reduce(add, [F.bit_count(reduce(Column.bitwiseOR, [F.col(f"{m}_{i}") for i in range(lo, hi)])) for m in MASKS])
        return (F.ceil(n * bits_for_count(s) / 8) + s + HEADER + (PIECE if hi - lo == 1 else GROUP)).cast("long")

    # a range past the last chunk has no cost, and no split
    ranges = lambda span: [(lo, lo + span) for lo in range(interval - span + 1)]
    best = lambda lo, hi: F.col(f"best_{lo}_{hi}")
    block = block.withColumns({f"best_{lo}_{hi}": cost(lo, hi) for lo, hi in ranges(1)})
    for span in range(2, interval + 1):
        splits = lambda lo, hi: [best(lo, mid) + best(mid, hi) + SPLIT for mid in range(lo + 1, hi)]
        block = block.withColumns({f"best_{lo}_{hi}": F.least(cost(lo, hi), *splits(lo, hi)) for lo, hi in ranges(span)})
    plain = reduce(add, [F.coalesce(best(lo, hi), F.lit(0)) for lo, hi in ranges(1)])
    return block.select("k", "block", "chunks", F.element_at(F.array(*[best(0, hi) for hi in range(1, interval + 1)]), F.col("chunks")).alias("best"), plain.cast("long").alias("plain"))


def stream_blocks(chunks: DataFrame, interval: int) -> DataFrame:
    """A stream of ``k, chunk, size, at`` (event time) -> per block of ``interval`` chunks
    its chunks and bytes, once the watermark has passed it; late chunks are dropped."""
    block = F.floor(F.col("chunk") / interval)
    return (
        chunks.withWatermark("at", "10 minutes").groupBy(F.window("at", "10 minutes"), "k", block.alias("block"))
        .agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("bytes"), F.min("chunk").alias("first_chunk"))
        .select("k", "block", F.col("window.start").alias("at"), "chunks", "bytes", "first_chunk")
    )

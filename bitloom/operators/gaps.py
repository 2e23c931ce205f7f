"""Strictly increasing series as gaps: which encoding of the gaps is smallest."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.bits import trailing_zeros, varint_length, zigzag
from bitloom.operators.transforms import PIECE, runs_of

MODES = ("bytes", "varint", "delta-varint", "zero-bytes", "zero-varint")


def gap_rows(series: DataFrame) -> DataFrame:
    """``k, t, v`` -> gaps in the order of ``t``: ``k, i, v, gap, change`` (i from 1; the first row has no gap)."""
    order = Window.partitionBy("k").orderBy("t")
    rows = series.withColumn("i", F.row_number().over(order) - 1).withColumn("gap", F.col("v") - F.lag("v").over(order))
    return rows.withColumn("change", F.col("gap") - F.lag("gap").over(order)).select("k", "i", "v", "gap", "change")


def gap_sizes(series: DataFrame) -> DataFrame:
    """Bytes of each encoding of a series' gaps; null where an encoding can't hold them.

    A series whose values do not strictly increase, or with fewer than three, has none."""
    rows = gap_rows(series)
    later = F.col("i") >= 2
    first_gap = F.when(F.col("i") == 1, F.col("gap"))
    rows = rows.withColumn("_z", F.when(later & (F.col("gap") > 0), trailing_zeros(F.col("gap"))))
    shift = F.coalesce(F.min("_z").over(Window.partitionBy("k")), F.lit(0))
    rows = rows.withColumn("shift", shift).withColumn("_g", F.when(F.col("gap") > 0, F.col("gap")))
    scaled = F.expr("shiftright(_g, CAST(shift AS INT))")
    s = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.max("shift").cast("int").alias("shift"), F.max(first_gap).alias("first_gap"),
        F.max(F.when(later, scaled)).alias("high_scaled"), F.sum(F.when(F.col("i") >= 1, varint_length(F.col("_g")))).cast("long").alias("varint"),
        F.sum(F.when(later, varint_length(zigzag(F.col("change")))).otherwise(F.when(F.col("i") == 1, varint_length(F.col("_g"))))).cast("long").alias("delta_varint"),
        F.sum(F.when(later, varint_length(scaled)).otherwise(F.when(F.col("i") == 1, varint_length(F.col("_g"))))).cast("long").alias("zero_varint"),
    )
    s = s.where((F.col("n") >= 3) & (F.col("low") > 0))
    count = F.col("n") - 1
    return s.select(
        "k", "n", "shift", F.when(F.col("high") <= 255, count).alias("bytes"), "varint", "delta_varint",
        F.when((F.col("shift") > 0) & (F.col("first_gap") <= 255) & (F.col("high_scaled") <= 255), count).alias("zero_bytes"),
        F.when(F.col("shift") > 0, F.col("zero_varint")).alias("zero_varint"),
    )


def best_mode(sizes: DataFrame) -> DataFrame:
    """The smallest encoding of each series; on ties the earlier."""
    columns = ("bytes", "varint", "delta_varint", "zero_bytes", "zero_varint")
    options = F.array(*[F.struct(F.col(c).alias("size"), F.lit(i).alias("rank"), F.lit(m).alias("mode")) for i, (c, m) in enumerate(zip(columns, MODES))])
    best = F.array_min(F.filter(options, lambda x: x["size"].isNotNull()))
    return sizes.select("k", "n", "shift", best["mode"].alias("mode"), best["size"].alias("size"))


def restored(gaps: DataFrame) -> DataFrame:
    """Values from a first value and gaps, by a running sum: ``k, i, v``."""
    start = F.first_value("v").over(Window.partitionBy("k").orderBy("i"))
    total = F.coalesce(F.sum("gap").over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return gaps.select("k", "i", (start + total).alias("v"))


#: Widths in the order in which they are tried.
WIDTHS = (3, 4, 2, 5, 6, 7, 8, 1)


def _falls(x: np.ndarray, w: int) -> int:
    """Values of ``w`` bytes that are not above the one before, a piece at a time."""
    out, values = 0, x.reshape(-1, w)
    for at in range(0, len(values), PIECE):
        part = values[max(0, at - 1) : at + PIECE]
        value = np.zeros(len(part), dtype=np.uint64)
        for i in range(w):
            value |= part[:, i].astype(np.uint64) << np.uint64(8 * i)
        out += np.count_nonzero(value[1:] <= value[:-1])
    return out


def fixed_widths(df: DataFrame) -> DataFrame:
    """``k, bytes`` -> ``k, width, n, falls, chosen``: bytes read as little-endian integers of each width
    that divides them into three or more; ``falls`` counts values not above the one before, and
    ``chosen`` marks the first width of WIDTHS without any."""
    kind = df.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for t in runs_of(batch.column(1)):
                rows, widths, counts, falls = [], [], [], []
                for w in WIDTHS:
                    fits = np.flatnonzero((t.sizes % w == 0) & (t.sizes >= 3 * w))
                    rows.append(fits)
                    widths.append(np.full(len(fits), w))
                    counts.append(t.sizes[fits] // w)
                    falls.append(np.array([_falls(t.data[t.offsets[i] : t.offsets[i + 1]], w) for i in fits.tolist()], dtype=np.int64))
                rows, widths, counts, falls = (np.concatenate(x) for x in (rows, widths, counts, falls))
                first = np.full(len(t.sizes), len(rows))
                np.minimum.at(first, rows[falls == 0], np.flatnonzero(falls == 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows + at)), pa.array(widths.astype(np.int32)), pa.array(counts.astype(np.int64)), pa.array(falls.astype(np.int64)), pa.array(first[rows] == np.arange(len(rows)))],
                    names=["k", "width", "n", "falls", "chosen"],
                )
                at += len(t.sizes)

    return df.select("k", "bytes").mapInArrow(run, f"k {kind}, width int, n long, falls long, chosen boolean")

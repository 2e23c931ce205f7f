"""Mixing sources to target weights by hash thresholds.

A document's hash places it on a line of 2**60 points.  A source's budget becomes
a threshold on that line: tokens are summed by source and hash bucket, the bucket
in which the running sum passes the budget is the boundary, and only that bucket
is histogrammed again at the next 12 bits.  Documents below the threshold are
taken by a plain filter; nothing is sorted.  The document at the boundary does not
fit the rest of the budget; the rest gets a threshold of its own among the documents
that do fit it, and so on until none does: nested budgets, each smaller than the
document that ended the one before.  In effect each source takes, in the order of the
hashes, every document that fits what is left.

The first level is one aggregation with map-side sums over (source, size, hash); a
source that holds a third of all rows sends at most 4096 partial rows a task.  The
other levels read the boundary bucket alone, and each nested budget only the
documents that still fit.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.store import materialize

BITS, STEP = 60, 12
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of MD5 of the id's decimal text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Targets share ``share`` times all tokens by weight, none above ``most`` times
    its source; the excess goes to the others by weight.  Closed form: sources in
    the order in which they reach their cap, and the first level of water at which
    the next one stays below it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("left_w"))
    water = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("before"), F.col("level")))).over(everything)["level"]
    per = per.withColumn("target", F.least(F.col("cap"), water * F.col("w")))
    return per.select("source", "source_size", "target")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size, h`` of each row, written to the shared folder."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return materialize(sizes.withColumn("h", doc_hash(F.col("id"))), "sizes")


def repeated(sizes: DataFrame) -> DataFrame:
    """``source, h, all``: tokens of the rows that share an id and a source, which are taken together."""
    many = materialize(sizes.groupBy("source", "h").agg(F.sum("size").alias("all"), F.count("*").alias("_n")).where("_n > 1").select("source", "h", "all"), "repeated")
    return F.broadcast(many) if many.count() <= 1_000_000 else many


def _units(rows: DataFrame, many: DataFrame, source: str, size: str, h: str) -> DataFrame:
    """``rows`` with ``_unit``: the tokens of all rows of its id and source."""
    many = many.select(F.col("source").alias("_ms"), F.col("h").alias("_mh"), "all")
    joined = rows.join(many, F.col(source).eqNullSafe(F.col("_ms")) & (F.col(h) == F.col("_mh")), "left")
    return joined.withColumn("_unit", F.coalesce("all", size)).drop("_ms", "_mh", "all")


def thresholds(sizes: DataFrame, targets: DataFrame, many: DataFrame) -> DataFrame:
    """Per source: ``copies`` (whole passes over it) and ``cuts``: a document of at most
    ``limit`` tokens with a hash below ``hi``, in any of them, is taken once more."""
    one = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("copies", one.cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = materialize(state.withColumn("cuts", F.array().cast("array<struct<limit:double,hi:bigint>>")), "mix")
    rows = _units(sizes.where(F.col("size") > 0), many, "source", "size", "h").select(F.col("source").alias("src"), "size", "h", F.col("_unit").alias("unit"))
    first = True
    while True:
        fits = (F.col("unit") <= F.col("rest")) & ~chosen(F.col("unit"), F.col("h"))
        some = rows.join(F.broadcast(state), F.col("src").eqNullSafe(F.col("source"))).where(fits).select("src", "size", "h", "unit")  # a row for each source
        if not first:
            rows = some = materialize(some, "fits")
        if not some.take(1):
            return state
        state, first = _nested(some, state), False


def chosen(unit: Column, h: Column) -> Column:
    return F.exists("cuts", lambda c: (unit <= c["limit"]) & (h < c["hi"]))


def _nested(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One more threshold per source for what is left of its budget, among rows that fit it."""
    keep = ("source", "source_size", "target", "copies", "cuts", "rest")
    state = state.select(*keep, F.col("rest").alias("limit"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("cut"))
    for level in range(1, BITS // STEP + 1):
        shift, last = BITS - STEP * level, level == BITS // STEP
        if level > 1:  # the boundary buckets alone
            inside = rows.join(F.broadcast(state), F.col("src").eqNullSafe(F.col("source")))
            inside = inside.where(F.col("cut").isNull() & (F.shiftright("h", shift + STEP) == F.col("at")))
            rows = materialize(inside.select("src", "size", "h", "unit"), "edge") if level == 2 else inside.select("src", "size", "h", "unit")
        hist = rows.groupBy("src", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        hist = hist.join(F.broadcast(state.select("source", F.col("rest").alias("_rest"))), F.col("src").eqNullSafe(F.col("source")))
        over = F.col("cum") > F.col("_rest")
        step = hist.withColumn("cum", F.sum("s").over(Window.partitionBy("src").orderBy("b"))).groupBy("src").agg(
            F.min(F.when(over, F.struct("b", "n"))).alias("edge"), F.max(F.when(~over, F.col("cum"))).alias("done")
        )
        new = state.join(step, F.col("src").eqNullSafe(F.col("source")), "left")
        nb, open_ = F.col("edge")["b"], F.col("cut").isNull()
        # all of the bucket fits: the threshold is its end; a lone document on the edge: its bucket's start
        end = F.shiftleft(F.col("at") + 1, shift + STEP)
        settled = F.when(nb.isNull(), end).when((F.col("edge")["n"] <= 1) | F.lit(last), F.shiftleft(nb, shift))
        new = new.select(
            *keep[:-1], F.when(open_, F.col("rest") - F.coalesce("done", F.lit(0))).otherwise(F.col("rest")).alias("rest"), "limit",
            F.when(open_, F.coalesce(nb, "at")).otherwise(F.col("at")).alias("at"), F.when(open_, settled).otherwise(F.col("cut")).alias("cut"),
        )
        state = materialize(new, "mix")
        if last or not state.where(F.col("cut").isNull()).take(1):
            break
    cut = F.struct(F.col("limit"), F.col("cut").alias("hi"))
    state = state.withColumn("cuts", F.when(F.col("rest") < F.col("limit"), F.array_append("cuts", cut)).otherwise(F.col("cuts")))
    return materialize(state.select(*keep), "mix")


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` with ``_size, _source_size, _target, _taken`` (tokens that the mix takes).

    ``_taken`` is a whole multiple of ``_size``, 0 to 2 times for ``most`` = 2.
    Rows with the same id and source are taken alike.  Null text or text without
    words: size 0, taken 0.  A null source is a source of its own, last in order.
    Null ids share one hash.  An empty table gives an empty table.  The choice
    depends on ids, sources and sizes alone, so reruns agree.  The targets are made of
    one row a source in one task.  Input columns with these names are replaced.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_taken")
    sizes = sized(docs, id_col, text_col, source_col)
    many = repeated(sizes)
    plan = thresholds(sizes, source_targets(sizes, share, most, weights), many)
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_s", F.col("_row")[source_col])
    rows = rows.withColumn("_h", doc_hash(F.col("_row")[id_col])).withColumn("_size", word_count(F.col("_row")[text_col]))
    return _take(rows, plan, many).select("_row.*", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_taken")


def _take(rows: DataFrame, plan: DataFrame, many: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_of")
    joined = _units(rows, many, "_s", "_size", "_h").join(F.broadcast(plan), F.col("_s").eqNullSafe(F.col("_of")))  # a row for each source
    return joined.withColumn("_taken", F.col("_size") * (F.col("copies") + F.when(chosen(F.col("_unit"), F.col("_h")), 1).otherwise(0)))


def query(spark, sf_dir: str) -> DataFrame:
    sizes = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    many = repeated(sizes)
    plan = thresholds(sizes, source_targets(sizes), many)
    rows = sizes.select(F.col("id").alias("doc_id"), F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("h").alias("_h"))
    out = _take(rows, plan, many)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


#: Each source goes through its documents in the order of their hashes and takes every one
#: that fits what is left; a round of the recursion takes all up to the first that does not.
ORACLE = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w
  FROM sizes GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
         CAST(sum(source_size) OVER () AS BIGINT) AS whole
  FROM caps),
water AS (
  SELECT arg_min((whole * 1.5::DOUBLE - before) / left_w, before) AS wl FROM levels
  WHERE (whole * 1.5::DOUBLE - before) / left_w <= cap / w),
targets AS (
  SELECT source, source_size, least(cap, wl * w) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(cap, wl * w) / source_size) AS BIGINT) ELSE 0 END AS copies
  FROM levels, water),
units AS (
  SELECT s.source, s.h, CAST(sum(s.size) AS BIGINT) AS unit, min(t.target - t.copies * t.source_size) AS gap
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size > 0 GROUP BY s.source, s.h),
rounds AS (
  SELECT source, h, unit, cum <= gap AS fits, gap - max(CASE WHEN cum <= gap THEN cum END) OVER (PARTITION BY source) AS rest
  FROM (SELECT *, CAST(sum(unit) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS cum FROM units WHERE unit <= gap)
  UNION ALL
  SELECT source, h, unit, cum <= gap, gap - max(CASE WHEN cum <= gap THEN cum END) OVER (PARTITION BY source)
  FROM (SELECT source, h, unit, rest AS gap, CAST(sum(unit) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS cum FROM rounds WHERE NOT fits AND unit <= rest)),
picked AS (SELECT source, h FROM rounds WHERE fits)
SELECT s.doc_id, s.size, t.source_size, t.target, s.size * (t.copies + CASE WHEN p.h IS NOT NULL THEN 1 ELSE 0 END) AS taken
FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN picked p ON p.source IS NOT DISTINCT FROM s.source AND p.h = s.h
"""

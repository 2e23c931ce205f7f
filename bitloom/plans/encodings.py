"""Byte, series and block queries over whole texts, with the SQL that states the same result."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators import byte_stats as S
from bitloom.operators import gaps as G
from bitloom.operators import transforms as T
from bitloom.sources.tables import scratch, table
from bitloom.streaming import blocks as C


def _texts(spark, sf) -> DataFrame:
    return T.byte_texts(table(spark, sf, "documents"), F.col("doc_id"), F.col("text")).where(F.octet_length("bytes") > 0)


def _hist(spark, sf) -> DataFrame:
    return S.histogram(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


def _round_trip(*plan):
    """Digest of each text's bytes after the plan, and whether the inverse gives the text back."""

    def run(spark, sf):
        both = T.round_trip(_texts(spark, sf), plan)
        return both.select(F.col("k").alias("doc_id"), F.octet_length("made").cast("long").alias("n"), F.md5("made").alias("digest"), (F.col("bytes") == F.col("back")).alias("restored"))

    return run


BYTES = """
WITH hexed AS (SELECT doc_id AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
listed AS (SELECT k, length(h) // 2 AS n, regexp_extract_all(h, '..') AS p FROM hexed),
rel AS (SELECT k, n, generate_subscripts(p, 1) - 1 AS pos, CAST('0x' || unnest(p) AS INTEGER) AS b FROM listed)"""
DIGEST = """
SELECT k AS doc_id, count(*) AS n, md5(unhex(string_agg(printf('%02X', b), '' ORDER BY pos))) AS digest, TRUE AS restored
FROM out GROUP BY k"""


def _sql_delta(src: str, p: int, key: str = "k") -> str:
    return f"SELECT k, n, pos, ((b - coalesce(lag(b, {p}) OVER (PARTITION BY {key} ORDER BY pos), 0)) % 256 + 256) % 256 AS b FROM {src}"


def _sql_xor(src: str, p: int, key: str = "k") -> str:
    return f"SELECT k, n, pos, xor(b, coalesce(lag(b, {p}) OVER (PARTITION BY {key} ORDER BY pos), 0)) AS b FROM {src}"


def _sql_sorted(src: str, order: str) -> str:
    return f"SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY {order}, pos) - 1 AS pos, b FROM {src}"


def _sql(*steps: str) -> str:
    """Relations t0 (= rel), t1, ... and the digest of the last."""
    parts = [f"t{i + 1} AS ({s})" for i, s in enumerate(steps)]
    return BYTES + ", t0 AS (SELECT * FROM rel), " + ", ".join(parts) + f", out AS (SELECT * FROM t{len(steps)})" + DIGEST


def _sql_tail(change: str) -> str:
    """Sort by head (1 of 8) and tail, then a residual of lag 3 on the tail alone."""
    h = "(n // 8 + CASE WHEN n % 8 > 0 THEN 1 ELSE 0 END)"
    lagged = f"coalesce(lag(b, 3) OVER (PARTITION BY k, pos >= {h} ORDER BY pos), 0)"
    value = f"((b - {lagged}) % 256 + 256) % 256" if change == "delta" else f"xor(b, {lagged})"
    return f"SELECT k, n, pos, CASE WHEN pos < {h} THEN b ELSE {value} END AS b FROM t1"


def bits_of(key: str = "doc_id"):
    def run(spark, sf):
        h = S.symbol_ids(_hist(spark, sf))
        return h.select(F.col("k").alias("doc_id"), "b", "freq", "id")

    return run


def sizes(spark, sf):
    return S.index_sizes(_hist(spark, sf)).withColumnRenamed("k", "doc_id")


def payloads_of_ids(spark, sf):
    """Digests of the packed ids of each text."""
    out = S.index_payload(_texts(spark, sf))
    return out.select(F.col("k").alias("doc_id"), "bits", F.octet_length("payload").cast("long").alias("bytes"), F.md5("payload").alias("digest"))


def huffman(spark, sf):
    """Code cost against the entropy bound: it lies within one bit a byte of it."""
    s = S.coded_sizes(S.code_tables(_hist(spark, sf).where("k IS NOT NULL")))
    flog = F.aggregate("codes", F.lit(0.0), lambda t, c: t + c["freq"] * F.log2(c["freq"]))
    entropy = F.col("n") * F.log2("n") - flog
    fits = (F.col("coded_bits") >= entropy - 1e-6) & (F.col("coded_bits") < entropy + F.col("n") + F.when(F.col("symbols") == 1, 1).otherwise(0))
    return s.select(F.col("k").alias("doc_id"), "n", "coded_bits", "huffman", fits.alias("within_bound"))


def codes(spark, sf):
    """Canonical codes are prefix-free: code spaces of a text sum to one and never overlap; no code is shorter in all."""
    c = S.canonical_codes(S.code_lengths(_hist(spark, sf)))
    order = Window.partitionBy("k").orderBy("length", "b")
    low = F.col("code") * F.pow(F.lit(2.0), -F.col("length"))
    c = c.withColumn("low", low).withColumn("gap", F.lead("low").over(order) - F.col("low") - F.pow(F.lit(2.0), -F.col("length")))
    return c.groupBy(F.col("k").alias("doc_id")).agg(
        F.count("*").alias("symbols"), F.sum(F.col("freq") * F.col("length")).cast("long").alias("coded_bits"), F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("space"),
        (F.coalesce(F.min("gap"), F.lit(0.0)) == 0.0).alias("prefix_free"),
    )


def method(spark, sf):
    """Raw copy or fixed-width ids, by total size; ``coded_method`` has code words as well."""
    s = S.index_sizes(_hist(spark, sf))
    both = F.explode(F.array(F.struct(F.lit("raw-copy").alias("method"), F.col("raw").alias("total")), F.struct(F.lit("indexed-raw").alias("method"), F.col("indexed").alias("total"))))
    return S.choose(s.select("k", both.alias("c")).select("k", "c.method", "c.total")).withColumnRenamed("k", "doc_id")


def coded_method(spark, sf):
    """Raw copy, fixed-width ids or minimum-redundancy code words, by total size."""
    s = S.coded_sizes(S.code_tables(_hist(spark, sf).where("k IS NOT NULL")))
    totals = {"raw-copy": "raw", "indexed-raw": "indexed", "indexed-huffman": "huffman"}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("total")) for m, c in totals.items()]))
    return S.choose(s.select("k", each.alias("c")).select("k", "c.method", "c.total")).withColumnRenamed("k", "doc_id")


def methods(spark, sf):
    """Texts and bytes by chosen method."""
    return method(spark, sf).groupBy("method").agg(F.count("*").alias("texts"), F.sum("total").cast("long").alias("bytes"))


def coded_methods(spark, sf):
    """Texts and bytes by chosen method, code words included."""
    return coded_method(spark, sf).groupBy("method").agg(F.count("*").alias("texts"), F.sum("total").cast("long").alias("bytes"))


def payloads(spark, sf):
    """Texts that are equal byte for byte: content hash, length, how many, the first."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.groupBy(F.md5("t").alias("hash"), F.octet_length("t").cast("long").alias("bytes")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def encoded_once(spark, sf):
    """Each text's size as fixed-width ids, worked out once for equal texts."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("hash", F.md5("text")).where("text <> ''")
    first = d.groupBy("hash").agg(F.min("doc_id").alias("encoded_as"))
    some = d.join(first.select(F.col("encoded_as").alias("doc_id"), "hash"), ["doc_id", "hash"], "left_semi").dropDuplicates(["hash"])
    sizes = S.index_sizes(S.histogram(some, F.col("hash"), F.col("text"))).select(F.col("k").alias("hash"), "indexed")
    return d.select("doc_id", "hash").join(first.join(sizes, "hash"), "hash").select("doc_id", "encoded_as", "indexed")


def head_bytes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return d.select("doc_id", *[T.heads(F.col("n"), p, h).cast("long").alias(f"heads_{p}_{h}") for p, h in ((4, 1), (8, 3), (257, 1))])


def best_plan(spark, sf):
    return T.best_plan(T.plan_sizes(_texts(spark, sf))).withColumnRenamed("k", "doc_id")


def groups(spark, sf):
    return C.best_groups(C.text_chunks(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), 512), 4).withColumnRenamed("k", "doc_id")


GROUPS = BYTES + """, p AS (SELECT k, pos // 2048 AS block, CAST(pos // 512 % 4 AS INTEGER) AS i, b FROM rel),
used AS (SELECT k, block, max(i) + 1 AS chunks FROM p GROUP BY ALL),
cost AS (
  SELECT k, block, chunks, lo, hi, CAST((n * CAST(greatest(1, ceil(log2(s))) AS BIGINT) + 7) // 8 + s + 36 + CASE WHEN hi - lo = 1 THEN 10 ELSE 18 END AS BIGINT) AS cost
  FROM (SELECT k, block, chunks, lo, hi, count(*) AS n, count(DISTINCT b) AS s
        FROM p JOIN used USING (k, block), (SELECT l.i AS lo, h.i AS hi FROM range(4) l(i), range(1, 5) h(i) WHERE l.i < h.i)
        WHERE i >= lo AND i < hi AND hi <= chunks GROUP BY 1, 2, 3, 4, 5)),
b1 AS (SELECT * FROM cost WHERE hi - lo = 1)""" + "".join(
    f""",
s{n} AS (SELECT a.k, a.block, a.lo, z.hi, min(a.cost + z.cost) + 2 AS split FROM b{n - 1} a JOIN b{n - 1} z ON a.k = z.k AND a.block = z.block AND a.hi = z.lo AND z.hi - a.lo = {n} GROUP BY ALL),
b{n} AS (SELECT * FROM b{n - 1} UNION ALL SELECT c.k, c.block, c.chunks, c.lo, c.hi, least(c.cost, s.split) FROM cost c JOIN s{n} s USING (k, block, lo, hi))"""
    for n in (2, 3, 4)
) + """
SELECT w.k AS doc_id, w.block, CAST(w.chunks AS INTEGER) AS chunks, w.cost AS best, CAST(q.plain AS BIGINT) AS plain
FROM b4 w JOIN (SELECT k, block, sum(cost) AS plain FROM b1 GROUP BY ALL) q USING (k, block) WHERE lo = 0 AND hi = chunks"""


def _plan_sql() -> str:
    parts = {
        "identity": "SELECT k, n, pos, b FROM t0", "delta": _sql_delta("t0", 1), "xor": _sql_xor("t0", 1), "delta-4": _sql_delta("t0", 4), "xor-4": _sql_xor("t0", 4),
        "bit-planes": "SELECT k, n, (i * n + pos) // 8 AS pos, CAST(sum(((b >> i) & 1) << CAST((i * n + pos) % 8 AS INTEGER)) AS INTEGER) AS b"
        " FROM t0, (SELECT CAST(i AS INTEGER) AS i FROM range(8) r(i)) GROUP BY ALL",
    }
    every = " UNION ALL ".join(f"SELECT k, '{name}' AS plan, {i} AS rank, b FROM ({sql})" for i, (name, sql) in enumerate(parts.items()))
    return PERIODS + f""", t0 AS (SELECT * FROM rel),
near AS (SELECT r.k, t.period, t.place, r.b, coalesce(q.b, 0) AS before FROM top t JOIN rel r ON r.k = t.k LEFT JOIN rel q ON q.k = r.k AND q.pos = r.pos - t.period),
e AS ({every}
  UNION ALL SELECT k, 'delta-' || period, 4 + 2 * place, ((b - before) % 256 + 256) % 256 FROM near
  UNION ALL SELECT k, 'xor-' || period, 5 + 2 * place, xor(b, before) FROM near),
s AS (SELECT k, plan, rank, count(*) AS n, count(DISTINCT b) AS s FROM e GROUP BY ALL),
sized AS (SELECT *, CAST((n * CAST(greatest(1, ceil(log2(s))) AS BIGINT) + 7) // 8 + s AS BIGINT) AS size FROM s)
SELECT k AS doc_id, plan, size, max(CASE WHEN rank = 0 THEN size END) OVER (PARTITION BY k) AS plain, size + 28 < plain AS beats FROM sized
QUALIFY row_number() OVER (PARTITION BY k ORDER BY size, rank) = 1"""


PERIODS = BYTES + """, pairs AS (
  SELECT k, p.i AS period, CASE WHEN b = lag(b, CAST(p.i AS INTEGER)) OVER (PARTITION BY k, p.i ORDER BY pos) THEN 1 ELSE 0 END AS same, pos, n
  FROM rel, range(2, 17) p(i) WHERE n >= 2048),
scored AS (SELECT k, CAST(period AS INTEGER) AS period, CAST(sum(same) AS BIGINT) AS same, count(*) AS total FROM pairs
      WHERE pos >= period AND (pos - period) % greatest(1, (n - period) // least(20000, n - 2)) = 0 GROUP BY ALL),
top AS (SELECT k, period, same, total, CAST(row_number() OVER (PARTITION BY k ORDER BY same::DOUBLE / total DESC, period) AS INTEGER) AS place
FROM scored QUALIFY place <= 3)"""

#: Bits of a minimum-redundancy code: the two smallest counts of a text merge until one is left.
MERGES = BYTES.replace("WITH hexed", "WITH RECURSIVE hexed") + """, counted AS (SELECT k, b, count(*) AS f FROM rel GROUP BY ALL),
merges AS (
  SELECT k, list_sort(list(f)) AS l, CAST(CASE WHEN count(*) = 1 THEN sum(f) ELSE 0 END AS BIGINT) AS bits FROM counted GROUP BY k
  UNION ALL
  SELECT k, list_sort(list_append(l[3:], l[1] + l[2])), CAST(bits + l[1] + l[2] AS BIGINT) FROM merges WHERE len(l) > 1),
whole AS (SELECT k, sum(f) AS n, count(*) AS symbols, sum(f * log2(f)) AS flog FROM counted GROUP BY k),
coded AS (SELECT k, CAST(n AS BIGINT) AS n, symbols, flog, bits, (bits + 7) // 8 + 2 * symbols + 36 AS huffman,
          (n * CAST(greatest(1, ceil(log2(symbols))) AS BIGINT) + 7) // 8 + symbols + 36 AS idx FROM merges JOIN whole USING (k) WHERE len(l) = 1),
chosen AS (SELECT k, CASE WHEN huffman < least(idx, n + 36) THEN 'indexed-huffman' WHEN idx < n + 36 THEN 'indexed-raw' ELSE 'raw-copy' END AS method,
           CAST(least(n + 36, idx, huffman) AS BIGINT) AS total FROM coded)"""


def series(spark, sf) -> DataFrame:
    """Event times of each user in microseconds, distinct, in order."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("v")).distinct()
    return e.withColumn("t", F.col("v"))


SERIES = """
WITH s AS (SELECT DISTINCT user_id AS k, epoch_us(ts) AS v FROM events),
g AS (SELECT k, v, row_number() OVER w - 1 AS i, v - lag(v) OVER w AS gap FROM s WINDOW w AS (PARTITION BY k ORDER BY v)),
c AS (SELECT *, gap - lag(gap) OVER (PARTITION BY k ORDER BY i) AS change,
      min(CASE WHEN i >= 2 AND gap > 0 THEN bit_count((gap & -gap) - 1) END) OVER (PARTITION BY k) AS z FROM g),
l AS (SELECT *, coalesce(z, 0) AS shift, CASE WHEN change >= 0 THEN change * 2 ELSE -change * 2 - 1 END AS zz FROM c),
vl AS (SELECT *, gap >> shift AS scaled,
       greatest(1, (length(ltrim(bin(gap), '0')) + 6) // 7) AS lv, greatest(1, (length(ltrim(bin(zz), '0')) + 6) // 7) AS lz,
       greatest(1, (length(ltrim(bin(gap >> shift), '0')) + 6) // 7) AS ls FROM l),
sizes AS (
  SELECT k, count(*) AS n, CAST(max(shift) AS INTEGER) AS shift, CASE WHEN max(gap) <= 255 THEN count(*) - 1 END AS bytes,
         CAST(sum(CASE WHEN i >= 1 THEN lv END) AS BIGINT) AS varint, CAST(sum(CASE WHEN i >= 2 THEN lz WHEN i = 1 THEN lv END) AS BIGINT) AS delta_varint,
         CASE WHEN max(shift) > 0 AND max(CASE WHEN i = 1 THEN gap END) <= 255 AND max(CASE WHEN i >= 2 THEN scaled END) <= 255 THEN count(*) - 1 END AS zero_bytes,
         CASE WHEN max(shift) > 0 THEN CAST(sum(CASE WHEN i >= 2 THEN ls WHEN i = 1 THEN lv END) AS BIGINT) END AS zero_varint
  FROM vl GROUP BY k HAVING count(*) >= 3)"""


def gap_sizes(spark, sf):
    return G.gap_sizes(series(spark, sf)).withColumnRenamed("k", "user_id")


def gap_mode(spark, sf):
    return G.best_mode(G.gap_sizes(series(spark, sf))).withColumnRenamed("k", "user_id")


def gap_restored(spark, sf):
    rows = G.gap_rows(series(spark, sf))
    back = G.restored(rows).withColumnRenamed("v", "again")
    both = rows.join(back, ["k", "i"])
    return both.groupBy(F.col("k").alias("user_id")).agg(F.count("*").alias("n"), F.sum("again").cast("decimal(38,0)").cast("string").alias("total"), F.min((F.col("v") == F.col("again"))).alias("restored"))


def fixed_widths(spark, sf):
    return G.fixed_widths(_texts(spark, sf)).withColumnRenamed("k", "doc_id")


def periods(spark, sf):
    return T.period_scores(_texts(spark, sf)).withColumnRenamed("k", "doc_id")


def chunks(spark, sf):
    """Blocks of eight 256-byte chunks, put together again: digests of their bytes."""
    out = C.text_chunks(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), 256)
    blocks = C.joined(out.withColumn("k", F.struct("k", F.floor(F.col("chunk") / 8).alias("block"))))
    return blocks.select(F.col("k.k").alias("doc_id"), F.col("k.block").alias("block"), "chunks", F.col("size").alias("bytes"), F.md5("bytes").alias("digest"))


CODECS = ("none", "snappy", "gzip", "zstd", "lz4")


def table_codecs(spark, sf):
    """All texts written as Parquet with each of Spark's codecs: bytes of the files, smallest first."""
    texts, made = table(spark, sf, "documents").select("doc_id", "text"), None
    for i, codec in enumerate(CODECS):
        path = scratch(spark, f"codec-{codec}")
        texts.write.option("compression", codec).parquet(path)
        size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length").alias("bytes"))
        size = size.select(F.lit(codec).alias("codec"), F.lit(i).alias("rank"), "bytes")
        made = size if made is None else made.union(size)
    order = Window.orderBy("bytes", "rank")  # five rows
    return made.select("codec", "bytes", F.row_number().over(order).alias("place"))


def history(spark, sf):
    return C.carried(C.block_methods(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), 2048)).withColumnRenamed("k", "doc_id")


def resumed(spark, sf):
    """The bytes that a reader gets who starts at the second block of four 512-byte chunks of each text."""
    out = C.text_chunks(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), 512)
    return C.resume(out, 4, 4).select(F.col("k").alias("doc_id"), F.col("size").alias("bytes"), "chunks", F.md5("bytes").alias("digest"))


def registry() -> dict:
    d1, x1 = _sql_delta("t0", 1), _sql_xor("t0", 1)
    g4 = _sql_sorted("t0", "pos % 4")
    ht = _sql_sorted("t0", "CASE WHEN pos % 8 >= 3 THEN 1 ELSE 0 END")
    h1 = _sql_sorted("t0", "CASE WHEN pos % 8 >= 1 THEN 1 ELSE 0 END")
    h = "(n // 8 + CASE WHEN n % 8 > 0 THEN 1 ELSE 0 END)"
    tail_gather = f"SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN pos < {h} THEN -1 ELSE (pos - {h}) % 3 END, pos) - 1 AS pos, b FROM t1"
    planes = (
        "SELECT k, n, (i * n + pos) // 8 AS pos, CAST(sum(((b >> i) & 1) << CAST((i * n + pos) % 8 AS INTEGER)) AS INTEGER) AS b"
        " FROM t0, (SELECT CAST(i AS INTEGER) AS i FROM range(8) r(i)) GROUP BY ALL"
    )
    ht1 = ("head-tail", 8, 1)
    return {
        "t1_delta": (_round_trip(("delta",)), _sql(d1)),
        "t2_xor": (_round_trip(("xor",)), _sql(x1)),
        "t3_bit_planes": (_round_trip(("bit-planes",)), _sql(planes)),
        "t4_bit_planes_delta": (_round_trip(("bit-planes",), ("delta",)), _sql(planes, _sql_delta("t1", 1))),
        "t4_bit_planes_xor": (_round_trip(("bit-planes",), ("xor",)), _sql(planes, _sql_xor("t1", 1))),
        "t5_head_tail": (_round_trip(("head-tail", 8, 3)), _sql(ht)),
        "t6_gather": (_round_trip(("gather", 4)), _sql(g4)),
        "t7_periodic_delta": (_round_trip(("delta", 4)), _sql(_sql_delta("t0", 4))),
        "t7_periodic_xor": (_round_trip(("xor", 4)), _sql(_sql_xor("t0", 4))),
        "t8_gather_delta": (_round_trip(("gather", 4), ("delta",)), _sql(g4, _sql_delta("t1", 1))),
        "t8_gather_xor": (_round_trip(("gather", 4), ("xor",)), _sql(g4, _sql_xor("t1", 1))),
        "t9_tail_gather": (_round_trip(ht1, ("tail-gather", 8, 1, 3)), _sql(h1, tail_gather)),
        "t9_tail_gather_delta": (_round_trip(ht1, ("tail-gather", 8, 1, 3), ("delta",)), _sql(h1, tail_gather, _sql_delta("t2", 1))),
        "t10_tail_delta": (_round_trip(ht1, ("tail-delta", 8, 1, 3)), _sql(h1, _sql_tail("delta"))),
        "t10_tail_xor": (_round_trip(ht1, ("tail-xor", 8, 1, 3)), _sql(h1, _sql_tail("xor"))),
        "t11_head_tail_delta": (_round_trip(("head-tail", 8, 3), ("delta",)), _sql(ht, _sql_delta("t1", 1))),
        "t11_head_tail_xor": (_round_trip(("head-tail", 8, 3), ("xor",)), _sql(ht, _sql_xor("t1", 1))),
        "t14_period_scores": (periods, PERIODS + " SELECT k AS doc_id, period, same, total, place FROM top"),
        "p1_histogram": (bits_of(), BYTES + " SELECT k AS doc_id, b, count(*) AS freq, CAST(dense_rank() OVER (PARTITION BY k ORDER BY b) - 1 AS INTEGER) AS id FROM rel GROUP BY k, b"),
        "p3_index_sizes": (
            sizes,
            BYTES + ", s AS (SELECT k, count(*) AS n, count(DISTINCT b) AS symbols FROM rel GROUP BY k),"
            " w AS (SELECT *, CAST(greatest(1, ceil(log2(symbols))) AS INTEGER) AS bits FROM s)"
            " SELECT k AS doc_id, n, symbols, bits, n + 36 AS raw, (n * bits + 7) // 8 + symbols + 36 AS indexed FROM w",
        ),
        "p3_index_payload": (
            payloads_of_ids,
            BYTES + ", i AS (SELECT k, n, pos, dense_rank() OVER (PARTITION BY k ORDER BY b) - 1 AS id FROM rel), w AS (SELECT k, CAST(greatest(1, ceil(log2(max(id) + 1))) AS BIGINT) AS bits FROM i GROUP BY k),"
            " p AS (SELECT k, bits, (pos * bits + j) // 8 AS place, CAST(sum(((id >> CAST(j AS INTEGER)) & 1) << CAST((pos * bits + j) % 8 AS INTEGER)) AS INTEGER) AS v FROM i JOIN w USING (k), range(8) r(j) WHERE j < bits GROUP BY ALL)"
            " SELECT k AS doc_id, CAST(bits AS INTEGER) AS bits, count(*) AS bytes, md5(unhex(string_agg(printf('%02X', v), '' ORDER BY place))) AS digest FROM p GROUP BY k, bits",
        ),
        "p4_huffman_bound": (
            huffman,
            MERGES + " SELECT k AS doc_id, n, bits AS coded_bits, CAST(huffman AS BIGINT) AS huffman,"
            " bits >= n * log2(n) - flog - 1e-6::DOUBLE AND bits < n * log2(n) - flog + n + CASE WHEN symbols = 1 THEN 1 ELSE 0 END AS within_bound FROM coded",
        ),
        "p5_canonical_codes": (codes, MERGES + " SELECT k AS doc_id, symbols, bits AS coded_bits, CASE WHEN symbols = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS space, TRUE AS prefix_free FROM coded"),
        "c2_choose_method": (
            method,
            BYTES + ", s AS (SELECT k, count(*) AS n, count(DISTINCT b) AS symbols FROM rel GROUP BY k),"
            " w AS (SELECT k, n + 36 AS raw, (n * CAST(greatest(1, ceil(log2(symbols))) AS BIGINT) + 7) // 8 + symbols + 36 AS idx FROM s)"
            " SELECT k AS doc_id, CASE WHEN idx < raw THEN 'indexed-raw' ELSE 'raw-copy' END AS method, least(raw, idx) AS total FROM w",
        ),
        "c1_methods_used": (
            methods,
            BYTES + ", s AS (SELECT k, count(*) AS n, count(DISTINCT b) AS symbols FROM rel GROUP BY k),"
            " w AS (SELECT k, n + 36 AS raw, (n * CAST(greatest(1, ceil(log2(symbols))) AS BIGINT) + 7) // 8 + symbols + 36 AS idx FROM s)"
            " SELECT CASE WHEN idx < raw THEN 'indexed-raw' ELSE 'raw-copy' END AS method, count(*) AS texts, CAST(sum(least(raw, idx)) AS BIGINT) AS bytes FROM w GROUP BY 1",
        ),
        "c2_choose_coded_method": (coded_method, MERGES + " SELECT k AS doc_id, method, total FROM chosen"),
        "c1_coded_methods_used": (coded_methods, MERGES + " SELECT method, count(*) AS texts, CAST(sum(total) AS BIGINT) AS bytes FROM chosen GROUP BY method"),
        "c10_encoded_once": (
            encoded_once,
            BYTES + ", s AS (SELECT k, count(*) AS n, count(DISTINCT b) AS symbols FROM rel GROUP BY k), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS encoded_as FROM documents)"
            " SELECT f.doc_id, encoded_as, (n * CAST(greatest(1, ceil(log2(symbols))) AS BIGINT) + 7) // 8 + symbols + 36 AS indexed FROM f JOIN s ON f.doc_id = s.k",
        ),
        "p10_equal_payloads": (payloads, "SELECT md5(coalesce(text, '')) AS hash, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2"),
        "t13_head_bytes": (
            head_bytes,
            "SELECT doc_id, " + ", ".join(f"CAST(n // {p} * {h} + least({h}, n % {p}) AS BIGINT) AS heads_{p}_{h}" for p, h in ((4, 1), (8, 3), (257, 1)))
            + " FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)",
        ),
        "t16_best_plan": (best_plan, _plan_sql()),
        "g9_best_groups": (groups, GROUPS),
        "c3_table_codecs": (table_codecs, None),
        "d1_fixed_width": (
            fixed_widths,
            BYTES + ", w AS (SELECT CAST(x.w AS BIGINT) AS w, row_number() OVER () AS place FROM (SELECT unnest([3, 4, 2, 5, 6, 7, 8, 1]) AS w) x),"
            " v AS (SELECT k, w, place, pos // w AS t, sum(b * (1::HUGEINT << CAST(8 * (pos % w) AS INTEGER))) AS v FROM rel JOIN w ON n % w = 0 AND n >= 3 * w GROUP BY ALL),"
            " g AS (SELECT *, v <= lag(v) OVER (PARTITION BY k, w ORDER BY t) AS fall FROM v),"
            " f AS (SELECT k, w, place, count(*) AS n, count(*) FILTER (WHERE fall) AS falls FROM g GROUP BY ALL)"
            " SELECT k AS doc_id, CAST(w AS INTEGER) AS width, n, falls, coalesce(place = min(CASE WHEN falls = 0 THEN place END) OVER (PARTITION BY k), FALSE) AS chosen FROM f",
        ),
        "d6_gap_sizes": (gap_sizes, SERIES + " SELECT k AS user_id, * EXCLUDE (k) FROM sizes"),
        "d7_gap_mode": (
            gap_mode,
            SERIES + """, o AS (SELECT k, n, shift, unnest([{'size': bytes, 'rank': 0, 'mode': 'bytes'}, {'size': varint, 'rank': 1, 'mode': 'varint'},
  {'size': delta_varint, 'rank': 2, 'mode': 'delta-varint'}, {'size': zero_bytes, 'rank': 3, 'mode': 'zero-bytes'}, {'size': zero_varint, 'rank': 4, 'mode': 'zero-varint'}]) AS o FROM sizes)
SELECT k AS user_id, n, shift, o.mode AS mode, o.size AS size FROM o WHERE o.size IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY o.size, o.rank) = 1""",
        ),
        "d8_gap_restored": (gap_restored, "WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) AS v FROM events) SELECT user_id, count(*) AS n, CAST(sum(v) AS VARCHAR) AS total, TRUE AS restored FROM s GROUP BY user_id"),
        "g2_chunks_and_blocks": (
            chunks,
            "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), c AS (SELECT doc_id, h, unnest(range(CAST(ceil(length(h) / 4096.0) AS BIGINT))) AS block FROM h),"
            " b AS (SELECT doc_id, block, substr(h, block * 4096 + 1, 4096) AS part FROM c)"
            " SELECT doc_id, block, CAST(ceil(length(part) / 512.0) AS BIGINT) AS chunks, CAST(length(part) // 2 AS BIGINT) AS bytes, md5(unhex(part)) AS digest FROM b",
        ),
        "g14_resume": (
            resumed,
            "WITH h AS (SELECT doc_id, substr(hex(encode(coalesce(text, ''))), 4097) AS part FROM documents WHERE octet_length(encode(text)) > 2048)"
            " SELECT doc_id, CAST(length(part) // 2 AS BIGINT) AS bytes, CAST(ceil(length(part) / 1024.0) AS BIGINT) AS chunks, md5(unhex(part)) AS digest FROM h",
        ),
        "g15_history": (
            history,
            BYTES + ", s AS (SELECT k, pos // 2048 AS block, count(*) AS n, count(DISTINCT b) AS symbols FROM rel GROUP BY ALL),"
            " m AS (SELECT k, block, CASE WHEN (n * CAST(greatest(1, ceil(log2(symbols))) AS BIGINT) + 7) // 8 + symbols < n THEN 'indexed-raw' ELSE 'raw-copy' END AS method FROM s)"
            " SELECT k AS doc_id, block, method, lag(method) OVER (PARTITION BY k ORDER BY block) AS before FROM m",
        ),
    }

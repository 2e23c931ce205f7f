"""Line deduplication with DataFrame functions alone.

Lines are exploded and hashed; a hash that occurs in many documents keeps its
lines only in the document with the largest id; the rest is reassembled by
position.

Plan.  Long lines are hashed to 128 bits and reduced to one row per
(hash, document), then to one row per hash, so a line that a third of all
documents hold arrives at its reducer as one partial row a task.  The repeated
hashes are materialised; the second pass joins them to the exploded lines, which
yields the dropped positions of each affected text, and a last join attaches
these positions to the texts.  The text itself is shuffled only if the table of
positions, which is counted, is too large to broadcast.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.store import materialize

#: The characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, ``A-Z`` lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that many documents hold; all columns of ``docs`` come back.

    ``text_col`` holds the kept lines joined by a line feed; added columns are
    ``_n_lines`` and ``_n_dropped``.  Keys of at least ``min_chars`` code points
    found under at least ``min_docs`` distinct ids lose all lines but those of the
    largest id.

    Null or empty text: one empty line, kept (a null text comes back null).  Null
    id: all rows with a null id count as one document, below every other id.
    Repeated rows count as one document and are treated alike.  An empty table
    gives an empty table.  Input columns with the added names are replaced.
    """
    docs = docs.drop("_n_lines", "_n_dropped")
    rows = docs.select(F.struct("*").alias("_row"))  # columns of the input can't clash with ours
    given_id, given_text = F.col("_row")[id_col], F.col("_row")[text_col]
    text = F.coalesce(given_text, F.lit(""))
    base = rows.select(given_id.alias("_id"), F.xxhash64(text).alias("_tag"), F.split(text, "\n").alias("_lines"))
    # only lines that can have a key of that length are taken apart further
    lines = base.select("_id", "_tag", F.posexplode("_lines").alias("_pos", "_line")).where(F.char_length("_line") >= min_chars)
    keyed = lines.select("_id", "_tag", "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    hashed = keyed.select("_id", "_tag", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))

    hot = (
        hashed.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_id").alias("_keep"))
        .where(F.col("_n") >= min_docs).select("_h1", "_h2", "_keep")
    )
    hot = materialize(hot, "lines")
    if hot.count() <= 1_000_000:  # 24 MB at most; beyond, lines meet their hashes by a shuffle that Spark splits where it is skewed
        hot = F.broadcast(hot)
    gone = (
        hashed.join(hot, ["_h1", "_h2"])
        .where(~F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy("_id", "_tag").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    )
    gone = materialize(gone, "gone")
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_gone")), F.lit(0)).alias("places")).first()
    gone = gone.withColumnsRenamed({"_id": "_gid", "_tag": "_gtag"})
    if size["rows"] <= 500_000 and size["places"] <= 4_000_000:  # 36 MB at most
        gone = F.broadcast(gone)

    tagged = rows.withColumn("_tag", F.xxhash64(text))
    joined = tagged.join(gone, given_id.eqNullSafe(F.col("_gid")) & (F.col("_tag") == F.col("_gtag")), "left")
    parts = F.split(text, "\n")
    # the kept runs lie between the dropped positions; each is one slice
    edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(parts)))
    runs = F.transform(F.sequence(F.lit(0), F.size("_edges") - 2), lambda i: F.struct((F.col("_edges")[i] + 1).alias("at"), (F.col("_edges")[i + 1] - F.col("_edges")[i] - 1).alias("n")))
    kept = F.array_join(F.flatten(F.transform(F.filter(runs, lambda r: r["n"] > 0), lambda r: F.slice("_parts", r["at"] + 1, r["n"]))), "\n")
    has = F.col("_gone").isNotNull()
    out = joined.withColumn("_n_lines", F.size(parts).cast("long")).withColumn("_n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    out = out.withColumn("_edges", F.when(has, edges)).withColumn("_parts", F.when(has, parts))
    out = out.withColumn("_kept", F.when(has, kept).otherwise(given_text))
    return out.select(*[(F.col("_kept") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns], "_n_lines", "_n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keep AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

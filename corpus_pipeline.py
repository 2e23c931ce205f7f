"""A training corpus in five stages: quality, repeated lines, near duplicates, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, extra ones included.  ``run`` writes each stage's
rows as Parquet to the shared folder and reads them back for the next one.

Odd input.  An empty table stays empty.  Repeated rows are treated alike by every
stage but the third, which keeps one of them.  Null and empty texts are texts without
words: the quality stage scores them like any other, no later stage but the mixture
drops them.  Extra columns of any name come through unchanged; only the four that the
mixture adds replace input columns of their names.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shielded(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and the way back."""
    moved = {c: f"{c} of the input" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more).

    The classifier learns from the labels of these documents; without any it gives 0.5 to
    all, so all stay.  Ties at 0.3 stay.  Rows with a null id are scored by their text."""
    safe, back = _shielded(docs, "_score")
    scored = quality.score_quality(safe, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("_score") >= 0.3).select(*safe.columns).withColumnsRenamed(back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more documents hold, but in the one with the largest
    id; their lengths follow.

    Rows with a null id count as one document, below all others.  A null text stays null, and
    its length as it was."""
    safe, back = _shielded(docs, "_n_lines", "_n_dropped")
    out = line_dedup.dedup_lines(safe).select(*safe.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars").try_cast("long")))
    return out.withColumnsRenamed(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class linked at 0.8 over five-word shingles.

    Texts without words are linked with nothing and stay.  Rows with a null id stay.  Of
    repeated rows one stays; rows of one id with different texts are one document, of which
    the row with the smallest text stays."""
    safe, back = _shielded(docs, "_gone", "_again", "_first")
    classes = jaccard_join.link_classes(safe, k=5, num=80, den=100)
    gone = classes.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_gone")).distinct()
    gone = store.materialize(gone, "gone")
    kept = safe.join(gone, safe["doc_id"] == gone["_gone"], "left_anti")
    again = safe.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n"), F.min("text").alias("_first")).where("_n > 1").select("_again", "_first")
    again = store.materialize(again, "again")
    if again.take(1):
        several = kept.join(again, kept["doc_id"] == again["_again"]).where(F.col("text").eqNullSafe(F.col("_first"))).select(*safe.columns).dropDuplicates(["doc_id"])
        kept = kept.join(again, kept["doc_id"] == again["_again"], "left_anti").union(several)
    return kept.withColumnsRenamed(back)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; all rows of a text that holds one go; an empty benchmark
    drops nothing."""
    safe, back = _shielded(docs, "_items")
    found = decontaminate.find_items(safe, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("_items") == 0).select(*safe.columns).withColumnsRenamed(back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with their words and how many of them are taken.

    Documents without words have nothing to take and go.  Null ids share one place in the
    order; a null source is one of its own, the last.  Rows of one id and source go together."""
    safe, back = _shielded(docs, "_size", "_source_size", "_target", "_taken")
    mixed = mixing.mix_sources(safe).where(F.col("_taken") > 0)
    added = ("size", "source_size", "target", "taken")
    return mixed.select(*[c for c in safe.columns if c.lower() not in added], *[F.col("_" + c).alias(c) for c in added]).withColumnsRenamed(back)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: A trained classifier has no SQL form; tests/llm/test_pipeline.py holds every stage and ``run`` against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.materialize(docs, name)
    return docs

"""What the two trained classifiers share: the labelled sample and the scoring pass."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Columns beside the text that a score may read; ids, labels, languages and sources never do.
METADATA = ("n_chars",)


def held_out(doc_id):
    """True where crc32 of the id's decimal text is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int, longest: int = 1 << 22) -> DataFrame:
    """Labelled rows that are not held out: ``doc_id, text, lang, meta, y, aside``.

    They are at most about ``most`` rows and ``most_bytes`` bytes of text; texts over
    ``longest`` bytes don't train.  Rows are taken by a hash of the id, so the sample is
    the same in every run.  Several labels of one document count as the largest; null
    labels don't count.  ``aside`` marks a fifth of the rows, for calibration.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(label).alias("y"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", "text", lang.cast("string").alias("lang"), metadata(docs).alias("meta"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = rows.where(size <= longest)
    seen = rows.select("doc_id", size.alias("b")).join(marked, "doc_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    share = min(1.0, most / max(1, seen["n"]), most_bytes / max(1, seen["b"]))
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return rows.join(marked, "doc_id").withColumn("aside", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def metadata(docs: DataFrame) -> Column:
    """Numeric metadata as an array of doubles; null where a row or the table has none."""
    return F.array(*[F.col(c).try_cast("double") if c in docs.columns else F.lit(None).cast("double") for c in METADATA])


def score_texts(docs: DataFrame, scorer: Callable[[pa.Array, pa.Array], "object"]) -> DataFrame:
    """``docs`` with ``_score`` (an input column of that name is replaced); ``scorer`` takes
    the texts and the metadata of a batch and returns doubles."""
    docs = docs.drop("_score")
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(scorer(batch.column(place), batch.column(batch.num_columns - 1)), type=pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=schema.names)

    return docs.withColumn("_score", metadata(docs)).mapInArrow(run, schema)

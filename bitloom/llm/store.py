"""Materialised intermediate tables in the folder that the cluster shares.

Intermediate results that several later steps read are written as Parquet under
``spark.checkpoint.dir``.  Such a table cuts the lineage, survives the loss of
any executor, and gives the planner real sizes.  Tables that a step has replaced are
dropped at once; those that a returned frame still reads go with ``sweep``, which
deletes the folder of the application.
"""

from pyspark.sql import DataFrame

from bitloom.sources.tables import keep, shared_dir, sweep

__all__ = ["drop", "materialize", "shared_dir", "sweep"]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back."""
    return keep(df, name)


def drop(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/bitloom-" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

"""Tables of a folder of Parquet files, and intermediate tables in the folder that the cluster shares."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder.  Only a local session without one gets a folder of its own;
    on a cluster its absence is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="bitloom-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder of this application, which ``sweep`` deletes as a whole."""
    return f"{shared_dir(spark)}/bitloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back: the lineage is
    cut, the loss of an executor costs nothing, and the planner knows the size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).alias(name)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; no result may still read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/bitloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

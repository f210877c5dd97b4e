"""Tables in, intermediate tables out."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a table's files for which it gets a partition of shuffles; some 100 to 300 MB of a task's memory.
BYTES_A_PARTITION = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Shuffles of the session get one partition for each BYTES_A_PARTITION of its files, if they have
    fewer, so that what one task holds does not grow with the table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    deal(spark, -(-size // BYTES_A_PARTITION))
    return df


def deal(spark: SparkSession, parts: int) -> int:
    """The session's partitions of shuffles, raised to `parts` if they are fewer."""
    if (now := int(spark.conf.get("spark.sql.shuffle.partitions"))) >= parts:
        return now
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    return parts


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all partitions of shuffles, which a small file of many rows is not by itself; by keys, if any are given."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and read it back: lineage ends, and lost executors lose nothing.
    The files go when the session ends."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        import tempfile

        at = "file://" + tempfile.gettempdir() + "/loomgraph-shared"
    at = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)

    def remove() -> None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone
            pass

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(at)

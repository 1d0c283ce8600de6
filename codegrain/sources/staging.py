"""Tables that several steps read: written once to the folder that all executors share, and read back.

Lineage ends there: a lost executor costs a re-read. ``spark.checkpoint.dir``
names the folder. Where it is unset, a session of one machine gets a folder of
its own; a session of several is refused, as its executors share no disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="codegrain-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codegrain/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/codegrain/" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch that a Python worker gets, about.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python workers batches of bounded bytes from now on: 10,000 rows, Spark's bound, can be any number of bytes."""
    conf = df.sparkSession.conf
    if int(str(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df

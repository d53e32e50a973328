"""Logs of requests: their schema, stored form and reading, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.config import NO_OPERATION, OWN_CLIENT
from loomrow.operators.frames import numbered

REQUESTS = T.StructType([T.StructField("tx", T.LongType()), T.StructField("client_id", T.IntegerType()), T.StructField("conn_id", T.LongType()), T.StructField("pid", T.IntegerType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))])


def number_requests(calls: DataFrame, order: str, first: int = 0) -> DataFrame:
    """Total order: tx numbers from `first` in the order of a numeric column (ties by client_id, conn_id, pid)."""
    return numbered(calls, order, "tx", ties=("client_id", "conn_id", "pid")).withColumn("tx", F.col("tx") + first)


def without_no_ops(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("pid") != NO_OPERATION)


def own_call(spark: SparkSession, tx: int, pid: int, params: dict[str, str] | None = None) -> DataFrame:
    """A call that the engine makes itself, as a row of REQUESTS."""
    return spark.createDataFrame([(tx, OWN_CLIENT, -1, pid, params or {})], REQUESTS)


def write_log(requests: DataFrame, path: str, read_only: tuple[int, ...] = ()) -> None:
    """Appends requests that write (pid not in read_only), with all their parameters."""
    requests.where(~F.col("pid").isin(*read_only) if read_only else F.lit(True)).select(*REQUESTS.names).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUESTS).parquet(path)


def stream_log(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The log as a stream, `files` files a micro-batch."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files).parquet(path)

"""Run a streaming plan over what is there now and read its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.session import shared_folder


def run_now(plan: DataFrame, mode: str = "append") -> DataFrame:
    """Start the plan with the available-now trigger, wait, and read the table it wrote; a stream without a batch gives no rows."""
    spark = plan.sparkSession
    root = f"{shared_folder(spark, 'inkwell-stream-').rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = plan.schema
    if mode == "append":
        query = plan.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.selectExpr("*", f"{number}L as batch").write.mode("overwrite").parquet(f"{root}/out/part={number}")

        query = plan.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{root}/out")
    batches = spark.createDataFrame([], schema).selectExpr("*", "0L as batch").schema
    spark.createDataFrame([], batches).write.mode("ignore").parquet(f"{root}/out/part=-1")  # so that the table is there without a batch
    return spark.read.schema(batches).option("basePath", f"{root}/out").parquet(f"{root}/out")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of Parquet as a stream, with its own schema."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)

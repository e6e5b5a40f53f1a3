"""Run a stream over what is there now and give its rows back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from momentra.functions.shared import shared_dir


def open_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream, whether the table is a file or a folder."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True).parquet(f"{path[:-1]}[t]")


STORE = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str = "append", base: str | None = None, no_data: bool = True) -> DataFrame:
    """All rows that the stream has given for its input so far. append: as they come; complete: the last state.

    base is the folder of the state and the rows: a second run with the same base goes on where the first one has stopped,
    and gives the rows of both. Without base each run begins anew, in a folder of its own under the shared one. no_data:
    batches without rows run as well, so that windows close; with a time to live by processing time they never end.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    before = {k: spark.conf.get(k) for k in (STORE, NO_DATA)}
    spark.conf.set(STORE, ROCKSDB)
    spark.conf.set(NO_DATA, no_data)
    try:
        query = writer.start()  # a query takes its settings when it starts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

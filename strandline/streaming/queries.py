"""Structured Streaming over event logs: windows, outstanding alerts, ingest by content."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandline.runtime import shared_path, ship


def source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files of a folder as a stream; the checkpoint remembers which were read.

    A stored table may be a folder of part files or a single file, which is picked out of its folder by name.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at) and files.getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") and "/" not in name else "*").parquet(folder)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by event type and tumbling window; rows later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count by sliding window."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user that end after a gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


def outstanding(events: DataFrame, key: str, raises: str, acks: str) -> DataFrame:
    """Alerts as a stream: a raise is emitted unless one of its key is outstanding; an acknowledgement clears it.

    State is one flag a key. Within a batch a key's events are taken in order of (ts, event_id).
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            if r.event_type == raises and not open_:
                out.append((k[0], r.event_id))
                open_ = True
            elif r.event_type == acks:
                open_ = False
        state.update((open_,))
        yield pd.DataFrame(out, columns=["key", "event_id"])

    ship(events.sparkSession)
    rows = events.filter(F.col("event_type").isin(raises, acks)).select(F.col(key).cast("long").alias("key"), "event_id", "event_type", "ts")
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event_id long", "open boolean", "append", GroupStateTimeout.NoTimeout)


def by_content(docs: DataFrame, content: str) -> DataFrame:
    """First arrival of each content; the state holds hashes, not texts."""
    return docs.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates(["content_hash"])


def drain(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its rows.

    Rows land as Parquet below the shared folder by batch number, which makes a
    repeated batch overwrite itself.
    """
    spark = stream.sparkSession
    path = shared_path(spark, f"stream-{uuid.uuid4().hex[:8]}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if sink:
            sink(batch, number)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns)


def replay(events: DataFrame, n: int = 500) -> DataFrame:
    """The newest ``n`` events, newest first: what a late listener is given."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)

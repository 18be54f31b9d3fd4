"""Session-level helpers: shared tables, code shipping, hot-key joins."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` names it. Only a local session
    without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so a retried write cannot mix runs."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor, and unlike an RDD
    checkpoint they stay columnar and carry no output partitioning, so AQE may
    still split a skewed join on top of them.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", "9").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Delete the files behind a ``shared_table`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Serve this package to the Python workers of the session, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    target = Path(tempfile.mkdtemp(prefix="strandline-code-")) / "strandline_code.zip"
    target.write_bytes(out.getvalue())
    sc.addPyFile(str(target))
    sc._strandline_shipped = True


#: Text bytes of a batch that a worker unfolds at a time; a longer single text is taken whole.
SLICE_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches as slices with about ``SLICE_BYTES`` of text in a column, so that what is
    made of them follows the longest text. Behind a batch, freed memory goes back to the system.
    """
    for t in batches:
        start = size = 0
        for n, length in enumerate(pc.binary_length(t.column(column))):
            size += length.as_py() or 0
            if size >= SLICE_BYTES:
                yield t.slice(start, n + 1 - start)
                start, size = n + 1, 0
        if start < t.num_rows:
            yield t.slice(start)
        del t
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


#: A key counts as hot from this share of all rows; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 128


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join rows to one row per ``key`` when a single key may hold a third of ``rows``.

    ``groups`` has ``key`` and the number ``size`` of rows with it, and should be
    a shared table because it is read three times. Keys with at least
    ``HOT_SHARE`` of all rows number 128 at most, whatever the input: they are
    broadcast. The other keys are small and take an ordinary shuffle join.
    Null keys match nothing; with ``how="left"`` they are kept without a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(1.0, total * HOT_SHARE)
    hot = groups.filter(F.col(size) >= least)
    cold = groups.filter(F.col(size) < least)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    parts = [
        marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key, "inner"),
        marked.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot").join(cold, key, how),
    ]
    if how == "left":
        rest = rows.filter(F.col(key).isNull())
        for f in groups.schema:
            if f.name != key:
                rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
        parts.append(rest)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

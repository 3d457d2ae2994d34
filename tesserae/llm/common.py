"""What several operators share: scratch tables in the shared folder, row hashes, skew-safe lookups."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than 1/HEAVY of all rows is looked up by broadcast; there are fewer than HEAVY such keys.
HEAVY = 1000

_LOCAL: list[str] = []
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed, and get texts in batches that are small in bytes too."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "16m")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of our own, in local mode only."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tesserae-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"


def tidy(run):
    """run, a function for mapInArrow, after which the worker gives back the memory that it doesn't use: workers stay for the
    tasks to come, and those of several stages may be there at a time."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return own


def filesystem(uri: str):
    """pyarrow's file system and path of a URI, as Spark writes it; for what isn't read or written by Spark itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*saved: DataFrame) -> None:
    """Delete what save() has written, once nothing reads it any more."""
    for df in saved:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_crc(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; -1 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(-1))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def most_frequent(table: DataFrame, k: int, weight: str, key: str) -> DataFrame:
    """The k rows of table with the largest weights (1 or more), ties by the least key.

    A histogram of the weights, eight buckets an octave and so some 500 rows at most, tells first from which
    weight on there are k rows.  Only those are ranked: the one task that ends a top-k gets little more than k rows
    altogether, not k from each task.
    """
    bucket = F.floor(F.log2(weight) * 8)
    least, left = 0, k
    for r in sorted(table.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):
        least, left = r["b"], left - r["n"]
        if left <= 0:
            break
    return table.where(bucket >= least).orderBy(F.desc(weight), key).limit(k)


def thinned(rows: DataFrame, place: Column, k: int, n: int) -> DataFrame:
    """Of n rows those in a range of hashes (place) that holds some 5/4 of k of them, or all if they are few: who then takes the k least
    hashes doesn't get k rows from every task."""
    return rows.where(place < F.lit((5 * k << 62) // n - (1 << 63))) if n > 2 * k else rows


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """rows left-joined with table, which has one row a key and, in weight, how many rows have that key; total: all rows, if known.

    Keys with more than 1/HEAVY of all rows are fewer than HEAVY: they are broadcast, so that
    no task gets all rows of a hot key.  All other keys go through a shuffled join.
    """
    total = (table.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    hot = table.where(F.col(weight) > max(1, total // HEAVY)).drop(weight)
    rest = table.where(F.col(weight) <= max(1, total // HEAVY)).drop(weight)
    marks = hot.select(key, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(marks), key, "left")
    return (
        marked.where("_hot").drop("_hot").join(F.broadcast(hot), key)
        .unionByName(marked.where("_hot is null").drop("_hot").join(rest, key, "left"))
    )

"""Helpers shared by the operators: table access, shared working folders, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import pathlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.relational import estimated_bytes

#: A-Z to a-z; every ASCII byte that is neither digit nor letter to a space. Bytes of
#: multi-byte UTF-8 characters stay, so that words are [0-9a-z] and non-ASCII runs.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


_LOCAL_ROOT: dict[str, str] = {}


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


#: Rows of a batch of texts, for Arrow and for the Parquet reader, where the session doesn't say: their
#: defaults (10,000 and 4,096) are made for narrow rows, and a batch of texts stands in the heap, in Arrow and in Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def prepare(spark: SparkSession) -> None:
    """Batch sizes for texts, and the library's place for Python workers of this machine; on a cluster it is installed or sent with --py-files."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    home = str(pathlib.Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [home, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs of less than this for each core are dealt over all cores, for a small file may be one task.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if the optimiser takes it for small; else as its files are cut. The rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SPREAD_BYTES else df


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if (root := _LOCAL_ROOT.get("root")) is None:
            root = _LOCAL_ROOT["root"] = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, root, True)
    return root.rstrip("/")


_MADE: list[str] = []


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; clean_up() removes it."""
    _MADE.append(f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean_up(spark: SparkSession) -> None:
    """Remove what the operators keep in the shared folder, once their results have been written."""
    while _MADE:
        drop_path(spark, _MADE.pop())


def stage_table(df: DataFrame, tag: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and fixes the rows."""
    spark = df.sparkSession
    path = path or work_path(spark, tag)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_sums_before(rows: DataFrame, tag: str, value: str, *order: str) -> DataFrame:
    """rows with before, the sum of value over all rows that come earlier in the order, which must be total.

    Rows are dealt by ranges and added up range by range; only one row for each range stands in one place.
    """
    dealt = stage_table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), tag)
    earlier = (Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum(value).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("part_at"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    return dealt.withColumn("inside", inside).join(parts, "part").withColumn("before", F.col("part_at") + F.col("inside")).drop("part", "part_at", "inside")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a working folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_STATE: dict = {}


def release_memory() -> None:
    """Give back what Python and Arrow hold of freed memory; a no-op where the C library can't."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def worker_state(key, make):
    """What make() gives, kept by this worker until another key is asked for.

    So a worker that serves stage after stage holds one stage's tables at a time.
    """
    if key not in _STATE:
        _STATE.clear()
        release_memory()
        _STATE[key] = make()
        release_memory()
    return _STATE[key]


def trimmed(run):
    """run over batches; freed memory is given back at its end, for the worker lives on."""

    def whole(*batches):
        yield from run(*batches)
        release_memory()

    return whole


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to clash with no column, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_column(text, limit=None):
    """Native words of a text column: lower-cased ASCII letters, digits and non-ASCII characters."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def labelled_fold(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return labels.where(F.col("doc_id").isNotNull() & (~held_out(F.col("doc_id"))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))

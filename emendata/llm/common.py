"""Shared column expressions and storage helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: an expression named inside a lambda would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves on a local master; on a cluster it is an error, as executors
    could not read each other's files there.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='emendata-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    trim(df.sparkSession)
    return out


#: Folders of this process that are still there: path to its session.
_folders: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read back: for wide rows that are read more than once.

    The folder goes by ``discard``, or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/emendata-{uuid.uuid4().hex}"
    _folders[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _remove(path: str) -> None:
    spark = _folders.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*used: DataFrame) -> None:
    """Delete what ``stored`` wrote for these, which nothing reads any more."""
    for df in used:
        _remove(df.stored_at)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files and checkpoints of finished steps: it waits for the driver's garbage."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Have the driver's JVM give back what its threads have freed, where it can do that (JDK 17.0.9 on).

    Each join and exchange is planned in threads of its own, with heaps of their own outside of Java's; what these have
    freed stays with the process otherwise, and grows with the number of steps.
    """
    jvm = spark._jvm
    with contextlib.suppress(Py4JError):
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        given[0], given[1] = name, "systemTrimNativeHeap"
        call.invoke(server, given)


@atexit.register
def discard_all() -> None:
    """Delete all folders that ``stored`` has left: for the end of a job, when its results are written."""
    for path in list(_folders):
        _remove(path)


def joined_by_shuffle(side: DataFrame) -> DataFrame:
    """``side`` (narrow) marked for a join with texts: both are dealt by key, and the texts need no sort.

    One plan at every size: nothing is broadcast whose size follows the input.
    """
    return side.hint("shuffle_hash")


def joined_by_sort(side: DataFrame) -> DataFrame:
    """``side`` marked for a join of two sorted tables, at every size.

    Spark sizes what ``stored`` has written by its files, and numbers in order take a tenth there of what they take in
    the driver's memory: below the limit for broadcasts a table may have millions of rows.
    """
    return side.hint("merge")


def row_key(doc_id: Column, text: Column) -> Column:
    """One key of 128 bits for rows of equal id and text. Rows that repeat both are one document to the operators that use it."""
    parts = [F.xxhash64(F.lit(i), doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), text.isNull(), text) for i in (1, 2)]
    return F.struct(parts[0].alias("a"), parts[1].alias("b"))

"""Tables that a job reads more than once, written to the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.session import shared_folder

TEXTS = 1000
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
SPACE = r"[\x20\x09-\x0D]+"      # fixed value: what separates words


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Every call has a folder of its own, so a retried job never meets an older half-written one.
    The folders are scratch: whoever owns the checkpoint folder deletes them after the job.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    landed = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[landed] = folder
    return landed


def drop(*tables: DataFrame) -> None:
    """Delete landed tables that nothing reads any more.  Others, such as results, stay.

    Spark deletes the shuffle files of finished jobs when the driver collects its garbage, which may
    be late on a driver with little to do; so that is asked for here.
    """
    for one in tables:
        folder = _FOLDERS.pop(one, None)
        if folder:
            path = one.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(one.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def give_back() -> None:
    """Return freed memory of this process to the system; elsewhere than on glibc, Arrow's alone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most ``TEXTS`` rows: texts are wide, and a Python worker's
    memory follows the bytes of a batch.  What a task has freed goes back to the system at its end,
    as its worker waits for later stages beside an executor that may need it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = rows.sparkSession
    if int(spark.conf.get(name)) > TEXTS:
        spark.conf.set(name, str(TEXTS))
    return rows.mapInArrow(run, schema)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package as bytes; ``pickle.loads`` in a task needs no copy of it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(buckets: int, column: str = "doc_id") -> Column:
    """The fold of a row: crc32 of its id as text; a row without an id is in no fold (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(buckets)


def held_out(buckets: int, column: str = "doc_id") -> Column:
    """True in fold 0, whose rows are not learned from; a row without an id counts as held out."""
    return F.coalesce(fold(buckets, column) == 0, F.lit(True))


def whole_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, all columns as one struct, so that no name can clash with the columns ``more``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[column.alias(name) for name, column in more.items()])


def dealt_anew(df: DataFrame) -> DataFrame:
    """``df``, not tied to the keys it was grouped by.

    A join on these keys then deals out both sides itself, so that rows of a busy key can be split
    over several tasks; only for small tables such as one row per key.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

"""The search log as a stream: repeats removed, the daily rollup kept current.

Which searches were seen is keyed state, so a batch looks up the ids it brings and no others, and a
search is new or a repeat however late it comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from placesearch.operators import searchlog

# state on the executors' disks and in the checkpoint: the ids of all searches need not fit in memory
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``STATE`` while a query starts; the session's own settings come back."""
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def dedupe_searches(searches: DataFrame) -> DataFrame:
    """Each search once, however late a writer sends it again; rows without an id are all kept.

    Of rows with one id within a batch any is kept: a writer repeats a row as it was.
    """
    named = searches.filter("search_id IS NOT NULL").dropDuplicates(["search_id"])
    return named.unionByName(searches.filter("search_id IS NULL"))


def _run(stream, folder: str) -> None:
    """Process what the source holds; the checkpoint lies in the shared folder of the output."""
    query = stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def keep_daily(searches: DataFrame, folder: str) -> DataFrame:
    """Process what the source holds and return the rollup of every day, open days too.

    New searches are added to ``folder/log`` by day; the days they fall on are then counted anew
    from their own files, with exact distinct counts, and replace their rows in ``folder/daily``.
    No other day is read or listed, and no search is too late.  A batch that is run again writes the
    same files, so nothing is counted twice.
    """
    spark = searches.sparkSession
    stored = T.StructType([*searches.schema.fields, T.StructField("day", T.DateType()),
                           T.StructField("batch", T.LongType())])

    def update(batch: DataFrame, number: int) -> None:
        session, log = batch.sparkSession, f"{folder}/log"
        (batch.filter("timestamp IS NOT NULL").withColumns({"day": F.to_date("timestamp"), "batch": F.lit(number)})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(log))
        # one value per day of the batch
        days = [r.day for r in batch.select(F.to_date("timestamp").alias("day")).distinct().collect() if r.day]
        if not days:
            return
        logged = (session.read.schema(stored).option("basePath", log)
                  .parquet(*[f"{log}/day={day}" for day in sorted(days)]))
        (searchlog.daily_analytics(logged).withColumn("day", F.to_date("search_date")).write
         .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
         .parquet(f"{folder}/daily"))

    with _settings(spark):
        _run(dedupe_searches(searches).writeStream.foreachBatch(update), folder)
    kept = searchlog.daily_analytics(spark.createDataFrame([], searches.schema))
    return spark.read.schema(kept.schema).parquet(f"{folder}/daily").select(*kept.columns)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Append what the source holds to ``folder/table`` and return that table.

    The checkpoint lies in the same shared folder, so a later call goes on where this one, or
    one that was lost, stopped.
    """
    with _settings(stream.sparkSession):
        _run(stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table"), folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")

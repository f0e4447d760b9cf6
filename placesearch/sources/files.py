"""Reading and writing the tables and texts as files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from placesearch.operators import searchlog
from placesearch.sources import commits, quotedcsv

# Words a CSV cell may hold for "nothing".
NOTHING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
           "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

LOG_TABLES = ("search_results", "result_scores")
SHELVES = 256             # folders that books are put into, so that many are listed by many tasks

RECORD_SCHEMA = "title string, URL string, address string, phone string, hours string, " \
                "cost string, content string"
DIRECTORY_SCHEMA = "ID long, Restaurant string, State string, City string, Address string, " \
                   "Region string, Crossout string, `Honor Roll` string, Recommend string, " \
                   "long double, lat double, geohash string, `10th Ed.` string"


def read_book_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row ``doc_id, text``; a missing path gives a null text."""
    try:
        return spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([(path, None)], "doc_id string, text string")


def _put_whole(system: fs.FileSystem, folder: str, name: str, text: str) -> None:
    """A file that is there whole or not at all, however often a task is tried; readers skip the hidden name."""
    hidden = f"{folder}/_{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(text.encode())
    try:
        system.move(hidden, f"{folder}/{name}")
    except OSError:
        if system.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(hidden)


def write_book_text(books: DataFrame, path: str) -> None:
    """``doc_id, text`` -> a file per book, named by its id, for ``read_book_text``.

    Tasks write the files themselves, each with a few calls: Spark's writer makes a folder per book, and on a
    local file system starts several processes for it.  Where Arrow does not know the file system, that writer is used.
    """
    spark = books.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toString()
    try:
        fs.FileSystem.from_uri(whole)
    except (pa.ArrowException, OSError):
        # a folder per book: tasks put theirs in place themselves, or the driver would move them one by one
        books.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("doc_id").text(path)
        return
    shelf = F.pmod(F.xxhash64("doc_id"), F.lit(SHELVES)).cast("int")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(whole)
        made: set[str] = set()
        for batch in batches:
            for number, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{top}/shelf={number}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                # a line break ends the file, as of any written line
                _put_whole(system, folder, f"doc_id={'' if doc_id is None else doc_id}.txt", f"{text or ''}\n")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    (books.select(shelf.alias("shelf"), "doc_id", "text").mapInArrow(put, "n long")
     .write.format("noop").mode("overwrite").save())
    system, top = fs.FileSystem.from_uri(whole)
    system.create_dir(top, recursive=True)       # also when there is no book


def read_records_csv(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """CSV with a header and quoted line breaks; words for nothing become null.

    Columns are found by the header's names, in any order; others are left out, and a column that
    the file lacks is null.  The files of one folder have the same header.  A large file is read by
    many tasks.
    """
    wanted = T.StructType.fromDDL(schema)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.csv(path, header=True, inferSchema=False, **{**options, "multiLine": True}).columns
    cells = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    rows = quotedcsv.records(spark, path).select(F.from_csv("text", F.lit(cells), options).alias("r")).select("r.*")
    there = set(rows.columns)

    def cell(f: T.StructField) -> Column:
        if f.name not in there:
            return F.lit(None).cast(f.dataType)
        text = F.col(f"`{f.name}`")
        return F.when(~text.isin(*NOTHING), text).try_cast(f.dataType)

    return rows.select(*[cell(f).alias(f.name) for f in wanted.fields])


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The geocoded directory, landed as Parquet or CSV."""
    if path.rstrip("/").endswith(".parquet"):
        wanted = T.StructType.fromDDL(DIRECTORY_SCHEMA)
        rows = spark.read.parquet(path)
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                             for f in wanted.fields if f.name in rows.columns])
    return read_records_csv(spark, path, DIRECTORY_SCHEMA)


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``value`` and whether it can be read as JSON."""
    return spark.read.text(path).withColumn("readable", F.try_parse_json("value").isNotNull())


def write_records_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True)


def write_marked_text(marked: DataFrame, path: str, mode: str = "error") -> None:
    marked.select("text").write.mode(mode).text(path)


def write_chat_jsonl(examples: DataFrame, path: str, mode: str = "error") -> None:
    """``split, messages`` -> one folder of JSON lines per split."""
    examples.select("split", F.to_json(F.struct("messages")).alias("value")).write.mode(
        mode).partitionBy("split").text(path)


def write_reports(reports: DataFrame, path: str, mode: str = "error") -> None:
    """``search_id, report`` -> JSON lines, a few files whatever the number of searches."""
    reports.select("search_id", "report").write.mode(mode).json(path)


def _stored(spark: SparkSession, folder: str, table: str, manifest: dict, parts: list[dict],
            days: list[str] | None = None) -> DataFrame:
    """The rows of a log table that count, with ``day``; only the folders of ``days`` are read."""
    root, fields = f"{folder}/{table}", T.StructType.fromJson(manifest["schemas"][table]).fields
    named = [T.StructField("version", T.StringType()), T.StructField("day", T.DateType())]
    rows = (spark.read.schema(T.StructType([*fields, *named])).option("basePath", root)
            .parquet(*[f"{root}/version={p['version']}" for p in parts]))
    day = F.coalesce(F.col("day").cast("string"), F.lit(""))
    for part in parts:
        if part["without"]:
            rows = rows.filter(~((F.col("version") == part["version"]) & day.isin(part["without"])))
    return (rows if days is None else rows.filter(day.isin(days))).drop("version")


def _manifest(spark: SparkSession, folder: str) -> dict:
    manifest = commits.current(spark, folder)
    if not manifest.get("parts"):
        raise FileNotFoundError(f"no batch was committed under {folder}")
    return manifest


def stored_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Searches and hits with the ``day`` of the search."""
    manifest = _manifest(spark, folder)
    return tuple(_stored(spark, folder, table, manifest, manifest["parts"]) for table in LOG_TABLES)


def _write_log(searches: DataFrame, scores: DataFrame, folder: str, version: str) -> None:
    """Hits and searches, which have ``day``, under one version; most of a row are ids in hex, which zstd halves."""
    for table, rows in zip(reversed(LOG_TABLES), (scores, searches)):
        rows.write.option("compression", "zstd").partitionBy("day").parquet(f"{folder}/{table}/version={version}")


def append_search_log(searches: DataFrame, scores: DataFrame, folder: str, batch: str) -> None:
    """Add a batch of searches and their hits, by day; a batch that is sent again replaces its rows.

    Both tables are written under a new version, and one manifest then lists it instead of the
    batch's older version, so a reader sees a batch whole, old or new.
    """
    spark, version = searches.sparkSession, commits.new_version()
    dated = searches.withColumn("day", F.to_date("timestamp"))
    days = dated.select("search_id", "day").dropDuplicates(["search_id"])
    _write_log(dated, scores.join(days, "search_id", "left").select(*scores.columns, "day"), folder, version)
    schemas = dict(zip(LOG_TABLES, (searches.schema.jsonValue(), scores.schema.jsonValue())))

    def listed(manifest: dict) -> dict:
        kept = [p for p in manifest.get("parts", []) if p["batch"] != batch]
        return {"schemas": schemas, "parts": [*kept, {"version": version, "batch": batch, "without": []}]}

    commits.commit(spark, folder, listed)


def read_search_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    searches, scores = stored_log(spark, folder)
    return searches.drop("day"), scores.drop("day")


def _rewrite_days(spark: SparkSession, folder: str, touched: Callable[[DataFrame, DataFrame], DataFrame],
                  change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> list[str]:
    """Write the days anew that ``touched`` names; the files of all other days stay as they are.

    A rewritten day of a batch is a new part of that batch, so a batch that is sent again still
    replaces it.
    """
    manifest = _manifest(spark, folder)
    parts = manifest["parts"]
    found = touched(*stored_log(spark, folder)).select(F.coalesce(F.col("day").cast("string"), F.lit("")).alias("day"))
    days = sorted(r.day for r in found.distinct().collect())      # one value per day
    if not days:
        return []
    added = []
    for batch in dict.fromkeys(p["batch"] for p in parts):
        own, version = [p for p in parts if p["batch"] == batch], commits.new_version()
        _write_log(*change(*(_stored(spark, folder, t, manifest, own, days) for t in LOG_TABLES)), folder, version)
        added.append({"version": version, "batch": batch, "without": []})

    def listed(now: dict) -> dict:
        if now != manifest:
            raise RuntimeError("the log changed while days were written anew; run it again")
        return {**manifest, "parts": [{**p, "without": sorted({*p["without"], *days})} for p in parts] + added}

    commits.commit(spark, folder, listed)
    return days


def feedback_into_log(spark: SparkSession, folder: str, feedback: DataFrame) -> list[str]:
    """Put feedback into the stored log; only the days of the rated runs are written anew."""
    runs = feedback.select(F.col("run_id").alias("langsmith_run_id")).distinct()

    def change(searches: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
        return searchlog.feedback_merge(searches, feedback), scores

    return _rewrite_days(spark, folder, lambda s, _: s.join(runs, "langsmith_run_id", "left_semi"), change)


def delete_from_log(spark: SparkSession, folder: str, doomed: DataFrame) -> list[str]:
    """Delete searches and their hits from the stored log; only their days are written anew."""
    gone = doomed.select("search_id").distinct()

    def touched(searches: DataFrame, scores: DataFrame) -> DataFrame:
        return (searches.join(gone, "search_id", "left_semi").select("day")
                .unionByName(scores.join(gone, "search_id", "left_semi").select("day")))

    return _rewrite_days(spark, folder, touched, lambda s, h: searchlog.cascade_delete(s, h, gone))


def build_index_if_absent(documents: DataFrame, path: str) -> DataFrame:
    """The stored document table; ``documents`` are written only if there is no whole one yet.

    Of two builders at once the first to finish counts.
    """
    spark = documents.sparkSession
    if "version" not in (found := commits.current(spark, path)):
        version = commits.new_version()
        documents.write.parquet(f"{path}/version={version}")
        found = commits.commit(spark, path, lambda now: None if "version" in now else {"version": version})
    return spark.read.parquet(f"{path}/version={found['version']}")

"""Token totals that are kept up to date by signed changes.

A change inserts a document's count, deletes it, or revises it; each adds a signed number to the
totals of its source, language and tokenizer version.  The changes of a batch are summed before they
are stored, and a batch is stored under its own name by one atomic step: committing it again, after
a lost driver or a repeated job, replaces it by the same rows and adds nothing.  Totals are the sum
over batches; old batches can be folded into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm.landing import SPACE, land, map_texts, table, text_of
from placesearch.llm.packing import tokenizer_path
from placesearch.llm.tokens import encoder, together
from placesearch.session import shared_folder

KEYS = ["source", "lang", "version"]
SUMS = ["documents", "tokens"]
BLANK_WORDS = "blank-words/1"        # version: runs of non-blanks
SUBWORDS = "word-bpe-49k/1"          # version: ids of the tokenizer file
_SCHEMA = "source string, lang string, version string, documents long, tokens long"


def count_subwords(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``tokens`` instead of ``text``: ids of the tokenizer file; a null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in together(batches):
            sizes = [len(data) // 4 for data in encode(batch.column(1).fill_null(""))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["row", "tokens"])

    keep = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    kind = packed.schema["row"].dataType.simpleString()
    return map_texts(packed, run, f"row {kind}, tokens long").select("row.*", "tokens")


def count_blank_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``tokens`` instead of ``text``: runs of non-blanks."""
    trimmed = F.regexp_replace(text_of(), rf"^{SPACE}|{SPACE}\z", "")
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE)))
    return docs.withColumn("tokens", words.cast("long")).drop("text")


def inserts(counted: DataFrame, version: str) -> DataFrame:
    """Changes for documents that are new: ``source, lang, version, documents, tokens``, signed."""
    return counted.select("source", "lang", F.lit(version).alias("version"),
                          F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counted: DataFrame, version: str) -> DataFrame:
    """Changes for documents that go; ``tokens`` is what was counted for them."""
    return inserts(counted, version).withColumns({c: -F.col(c) for c in SUMS})


def revisions(counted: DataFrame, version: str) -> DataFrame:
    """Changes for documents counted anew: ``tokens`` is the new count, ``before`` the old one."""
    return counted.select("source", "lang", F.lit(version).alias("version"),
                          F.lit(0).cast("long").alias("documents"),
                          (F.col("tokens") - F.col("before")).cast("long").alias("tokens"))


def summed(changes: DataFrame) -> DataFrame:
    """One row per key; every task adds its changes up first, so a busy source is a few rows.

    A null source or language is a key of its own; a null count adds nothing.  Keys whose sums are
    all zero are left out.
    """
    return (changes.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS])
            .filter("documents <> 0 OR tokens <> 0"))


def commit(changes: DataFrame, store: str, batch: str) -> None:
    """Store a batch's sums; committing the same batch again replaces it.

    The rows are written aside and appear with the writer's commit, so readers see all of a batch or
    nothing.  Distinct batches touch distinct folders and may be committed at the same time.
    """
    if not batch or "/" in batch or batch.startswith(("_", ".")):
        raise ValueError("a batch name must not be empty, start with _ or . or contain /")
    summed(changes).write.mode("overwrite").parquet(f"{store}/batch={batch}")


def _batches(spark: SparkSession, store: str) -> list[str]:
    """Names of the committed batches: those with the writer's mark."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=")
                  and files.exists(jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS")))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """``source, lang, version, documents, tokens`` over all committed batches; empty without any."""
    folders = [f"{store}/batch={b}" for b in _batches(spark, store)]
    if not folders:
        return spark.createDataFrame([], _SCHEMA)
    return summed(spark.read.schema(_SCHEMA).parquet(*folders))


def fold_batches(spark: SparkSession, store: str, target: str, through: list[str], name: str) -> None:
    """Sum the batches ``through`` of ``store`` into one batch of ``target``, a new store.

    The old store stays as it is until readers have changed over.
    """
    folders = [f"{store}/batch={b}" for b in _batches(spark, store) if b in set(through)]
    rows = spark.read.schema(_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], _SCHEMA)
    commit(rows, target, name)


def without_repeated_lines() -> Column:
    """The text with only the first of equal lines."""
    return F.array_join(F.array_distinct(F.split(text_of(), "\n")), "\n")


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents under two tokenizer versions, a revision, a deletion.

    Repeated lines are dropped from the texts, which revises the word counts; documents labelled as
    low quality are deleted under both versions.
    """
    store = f"{shared_folder(spark)}/llm/rollups-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    subwords = land(count_subwords(docs, tokenizer_path()), "subwords")
    # the count before and after repeated lines are dropped, from one pass over the texts
    before = count_blank_words(docs.withColumn("shorter", without_repeated_lines())).withColumnsRenamed(
        {"tokens": "before", "shorter": "text"})
    words = land(count_blank_words(before), "words")
    commit(inserts(words.drop("tokens").withColumnRenamed("before", "tokens"), BLANK_WORDS), store, "1-words")
    commit(inserts(subwords, SUBWORDS), store, "2-subwords")
    commit(revisions(words.filter("tokens <> before"), BLANK_WORDS), store, "3-revised")
    gone = [deletes(rows.join(low, "doc_id", "left_semi"), version)
            for rows, version in ((words, BLANK_WORDS), (subwords, SUBWORDS))]
    commit(gone[0].unionByName(gone[1]), store, "4-deleted")
    return totals(spark, store)


QUERIES = {"op8_token_rollups": op8_token_rollups}
SQL: dict[str, str] = {}

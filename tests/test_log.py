"""Search log, contracts, files and streams."""

import csv
import datetime as dt
import io
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from placesearch.operators import contracts, searchdocs, searchlog as log
from placesearch.session import cut_lineage, shared_folder
from placesearch.sources import commits, files, quotedcsv
from placesearch.streaming import log as stream

SEARCH = ("search_id string, query string, timestamp timestamp, num_results int, "
          "search_type string, feedback_success string")


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def full(rows):
    for c in log.SEARCH_COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.col("timestamp") if c == "created_at" else F.lit("x"))
    return rows.select(*log.SEARCH_COLUMNS)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def searches(spark):
    return full(spark.createDataFrame([
        ("a", "q", at(1), 2, "summary", "y"), ("b", "q", at(2), 0, "detailed", None),
        ("c", "r", None, 1, "other", "z")], SEARCH))


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("a", "2", 2, 0.5), ("a", "1", 1, 0.25), ("zz", "1", 0, -1.0), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "search_id string, restaurant_id string, rank int, similarity_score double")
    for c in log.SCORE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x" if c not in ("honor_roll", "recommend", "relevant") else None)
                               .cast("string"))
    return df.select(*log.SCORE_COLUMNS)


def test_view_order_and_left_rows(searches, scores):
    got = [(r.search_id, r.rank) for r in log.searches_with_scores(searches, scores).collect()]
    assert got == [("c", None), ("b", None), ("a", 1), ("a", 2)]
    assert len(log.searches_with_scores(searches, scores).columns) == 25


def test_get_search(searches, scores):
    assert [r.rank for r in log.get_search(searches, scores, "a").collect()] == [1, 2]
    assert log.get_search(searches, scores, "b").count() == 1
    assert log.get_search(searches, scores, "none").count() == 0


def test_constraints(searches, scores):
    bad = {(r.table, r.type, r.rule): r.violations
           for r in contracts.check_constraints(searches, scores).collect() if r.violations}
    assert bad == {
        ("search_results", "NOT NULL", "timestamp"): 1, ("search_results", "NOT NULL", "created_at"): 1,
        ("search_results", "CHECK", "search_type in (detailed, summary)"): 1,
        ("search_results", "CHECK", "feedback_success in (y, n)"): 1,
        ("search_results", "UNIQUE", "id"): 1, ("result_scores", "UNIQUE", "id"): 1,
        ("result_scores", "NOT NULL", "restaurant_id"): 1, ("result_scores", "NOT NULL", "rank"): 1,
        ("result_scores", "NOT NULL", "similarity_score"): 1,
        ("result_scores", "CHECK", "similarity_score >= 0"): 1, ("result_scores", "CHECK", "rank > 0"): 1,
        ("result_scores", "FOREIGN KEY", "search_id"): 1}


def test_cascade(searches, scores, spark):
    left, hits = log.cascade_delete(searches, scores, spark.createDataFrame([("a",)], "search_id string"))
    assert {r.search_id for r in left.collect()} == {"b", "c"}
    assert {r.search_id for r in hits.collect()} == {"zz", "c"}


def test_top_counts_distinct_searches(searches, scores):
    twice = scores.union(scores)
    row = log.top_entities(twice, searches, 1).first()
    assert (row.restaurant_id, row.search_count, row.avg_rank) == ("1", 1, 1.0)


def test_feedback(searches, spark):
    given = spark.createDataFrame([("x", 1, "old", at(1)), ("x", 0, "new", at(3))],
                                  "run_id string, score int, comment string, at timestamp")
    assert {(r.feedback_success, r.feedback_reason)
            for r in log.feedback_merge(searches, given).collect()} == {("n", "new")}
    assert log.feedback_merge(searches, given.limit(0)).exceptAll(searches).count() == 0


def test_ids_repeat_with_the_row(spark):
    results = [(1, "P", "C", "TX", "R", None, None, 1.0, 2.0, None, None, 0.5)]
    df = spark.createDataFrame([(n, "q", at(1), "u", "run", None, True, results) for n in (1, 2)], (
        "request_id long, query string, timestamp timestamp, user_id string, langsmith_run_id string, "
        "filter_applied string, article boolean, results array<struct<ID:long,Restaurant:string,"
        "City:string,State:string,Region:string,`Honor Roll`:string,Recommend:string,long:double,"
        "lat:double,sig_item:string,URL:string,similarity_score:double>>"))
    rows = log.search_rows(df)
    ids = [r.search_id for r in rows.orderBy("search_id").collect()]
    assert ids == [r.search_id for r in log.search_rows(df).orderBy("search_id").collect()]
    assert len(set(ids)) == 2          # alike in all but the request
    assert (rows.first().num_results, rows.first().search_type) == (1, "summary")
    hit = log.score_rows(df.withColumn("search_id", F.lit("s"))).first()
    assert (hit["rank"], hit.honor_roll, hit.recommend, hit.url, hit.sig_item) == (1, "n", "n", "", "")
    filled = log.with_defaults(rows.withColumn("id", F.lit(None).cast("string"))).collect()
    assert len({r.id for r in filled}) == 2


def test_documents(spark):
    row = {c: None for c in searchdocs.READ_COLUMNS}
    schema = ", ".join(f"`{c}` string" for c in searchdocs.READ_COLUMNS)
    df = spark.createDataFrame([{**row, "ID": "1", "State": "ZZ", "content": "t"},
                                {**row, "ID": "2", "Crossout": "y"}], schema)
    docs = searchdocs.build_documents(df).collect()
    assert [d.page_content for d in docs] == [
        "Restaurant: Unknown Restaurant\nLocation: Unknown City, Unknown State\n"
        "Signature Item: Unknown Item\n\nt"]
    assert docs[0]["State Name"] is None


def test_csv_round_trip(spark, folder):
    rows = spark.createDataFrame([('A "b"', "x\ny, z", "NA"), ("null", "", None)],
                                 "title string, content string, cost string")
    files.write_records_csv(rows, folder)
    got = files.read_records_csv(spark, folder, "title string, content string, cost string").collect()
    assert sorted(map(tuple, got), key=str) == sorted([('A "b"', "x\ny, z", None), (None, None, None)], key=str)


def test_missing_book_is_null(spark, folder):
    assert files.read_book_text(spark, folder).first().text is None


def _books(spark, count):
    return spark.range(count).selectExpr("id AS doc_id", "concat('BOOK ', id, '\\n  caf\u00e9 \u201cx\u201d\\n') AS text")


def test_books_are_files_in_a_few_folders(spark, folder):
    files.write_book_text(_books(spark, 400), folder)
    got = files.read_book_text(spark, folder).collect()
    assert sorted(r.text for r in got) == sorted(r.text + "\n" for r in _books(spark, 400).collect())
    assert {r.doc_id.rsplit("/", 1)[1] for r in got} == {f"doc_id={i}.txt" for i in range(400)}
    assert len({r.doc_id.rsplit("/", 1)[0] for r in got}) <= files.SHELVES < 400


def test_a_book_that_is_written_again_is_there_once(spark, folder):
    for _ in range(2):      # as when a task is tried again
        files.write_book_text(_books(spark, 5), folder)
    assert sorted(r.text for r in files.read_book_text(spark, folder).collect()) == [
        r.text + "\n" for r in _books(spark, 5).collect()]


def test_books_on_a_file_system_that_arrow_does_not_know(spark, folder, monkeypatch):
    def unknown(uri):
        raise files.pa.ArrowInvalid(uri)

    monkeypatch.setattr(files, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=unknown)))
    files.write_book_text(_books(spark, 3), folder)
    assert sorted(r.text for r in files.read_book_text(spark, folder).collect()) == [
        r.text + "\n" for r in _books(spark, 3).collect()]


def test_no_books(spark, folder):
    files.write_book_text(_books(spark, 0), folder)
    assert files.read_book_text(spark, folder).count() == 0


def test_bad_json_lines_are_reported(spark, folder):
    spark.createDataFrame([("{}",), ("{",)], "value string").write.text(folder)
    assert {(r.value, r.readable) for r in files.read_chat_jsonl(spark, folder).collect()} == \
        {("{}", True), ("{", False)}


def test_reports_are_written_per_search(spark, folder):
    df = spark.createDataFrame([("s1", "a\nb"), ("s2", "c")], "search_id string, report string")
    files.write_reports(df.coalesce(1), folder)
    read = spark.read.json(folder)
    assert sorted(map(tuple, read.select("search_id", "report").collect())) == [("s1", "a\nb"), ("s2", "c")]
    assert read.select(F.input_file_name()).distinct().count() == 1


def test_lineage_is_cut(spark):
    cut = cut_lineage(spark.range(3).withColumn("x", F.col("id") * 2))
    assert cut.count() == 3 and "Range" not in cut._jdf.queryExecution().executedPlan().toString()


def test_stream_goes_on_and_drops_repeats(spark, folder):
    schema = SEARCH
    source = f"{folder}/in"

    def send(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    send(("a", "q", at(1, 5), 2, "summary", "y"), ("a", "q", at(1, 5), 2, "summary", "y"),
         ("b", "r", at(1, 6), 4, "detailed", "n"))
    rows = spark.readStream.schema(schema).parquet(source)
    opened = stream.keep_daily(rows, f"{folder}/out").collect()
    assert [(r.search_date.day, r.total_searches) for r in opened] == [(1, 2)]      # the day is still open
    send(("b", "r", at(2, 5), 4, "detailed", "n"), ("c", "q", at(9), 1, "summary", None))
    send(("d", "q", at(10), 1, "summary", None))
    got = stream.keep_daily(rows, f"{folder}/out").orderBy("search_date").collect()
    first = got[0]
    assert [r.search_date.day for r in got] == [1, 9, 10]        # b came again
    assert (first.search_date.day, first.total_searches, first.unique_queries,
            first.avg_results_requested, first.summary_searches, first.successful_feedback,
            first.unsuccessful_feedback) == (1, 2, 2, 3.0, 1, 1, 1)


def test_an_append_that_runs_again_adds_nothing(spark, folder):
    searches = spark.createDataFrame([("s", at(1))], "search_id string, timestamp timestamp")
    hits = spark.createDataFrame([("s", 1), ("s", 2)], "search_id string, rank int")
    for batch in ("a", "a", "b"):
        files.append_search_log(searches, hits, folder, batch)
    stored, found = files.read_search_log(spark, folder)
    assert (stored.count(), found.count(), stored.columns) == (2, 4, searches.columns)


def test_a_reader_sees_a_batch_old_or_new(spark, folder, monkeypatch):
    old = spark.createDataFrame([("s", at(1))], "search_id string, timestamp timestamp")
    new = spark.createDataFrame([("s", at(1)), ("t", at(2))], old.schema)
    hits = spark.createDataFrame([("s", 1), ("s", 2)], "search_id string, rank int")
    read = lambda: tuple(t.count() for t in files.read_search_log(spark, folder))
    with pytest.raises(FileNotFoundError):
        read()
    files.append_search_log(old, hits, folder, "a")
    with monkeypatch.context() as stopped:          # all is written, the manifest is not
        stopped.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            files.append_search_log(new, hits.limit(0), folder, "a")
    assert read() == (1, 2)
    fs, _ = commits._files(spark, folder)
    fs.create(commits._path(spark, folder, 2), False).close()      # a writer that was lost while it wrote
    assert read() == (1, 2)
    files.append_search_log(new, hits.limit(1), folder, "a")
    assert read() == (2, 1)


def test_of_two_writers_none_is_lost(spark, folder):
    commits.commit(spark, folder, lambda now: {"n": 1})
    calls = []

    def change(now):
        if not calls:
            calls.append(commits.commit(spark, folder, lambda own: {**own, "m": 1}))
        return {**now, "n": now["n"] + 1}

    assert commits.commit(spark, folder, lambda now: None) == {"n": 1}
    commits.commit(spark, folder, change)
    assert commits.current(spark, folder)["n"] == 2


def test_only_touched_days_are_written_anew(spark, folder):
    rows = full(spark.createDataFrame([(f"s{i}", "q", at(1 + i % 4), 1, "summary", None) for i in range(12)], SEARCH)
                ).withColumn("langsmith_run_id", F.concat(F.lit("run-"), "search_id"))
    hits = rows.select("search_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    files.append_search_log(rows.filter("search_id < 's4'"), hits.filter("search_id < 's4'"), folder, "a")
    files.append_search_log(rows.filter("search_id >= 's4'"), hits.filter("search_id >= 's4'"), folder, "b")

    def by_day(table):
        stored = dict(zip(files.LOG_TABLES, files.stored_log(spark, folder)))[table]
        return {(str(r.day), r.f) for r in stored.select("day", F.input_file_name().alias("f")).distinct().collect()}

    before = by_day("search_results") | by_day("result_scores")
    given = spark.createDataFrame([("run-s1", 1, "good", at(9)), ("run-none", 0, "bad", at(9))],
                                  "run_id string, score int, comment string, at timestamp")
    assert files.feedback_into_log(spark, folder, given) == ["2024-01-02"]
    stored, found = files.read_search_log(spark, folder)
    wanted = log.feedback_merge(rows, given)
    assert sorted(map(str, stored.select(*rows.columns).collect())) == sorted(map(str, wanted.collect()))
    assert files.delete_from_log(spark, folder, spark.createDataFrame([("s2",), ("x",)], "search_id string")) == ["2024-01-03"]
    after = by_day("search_results") | by_day("result_scores")
    assert {f for f in before if f[0] in ("2024-01-01", "2024-01-04")} == {f for f in after if f[0] in ("2024-01-01", "2024-01-04")}
    stored, found = files.read_search_log(spark, folder)
    assert (stored.count(), found.count(), stored.filter("feedback_success = 'y'").count()) == (11, 22, 1)
    files.append_search_log(rows.filter("search_id < 's2'"), hits.limit(0), folder, "a")      # a batch again
    stored, found = files.read_search_log(spark, folder)
    again = sorted(r.search_id for r in rows.filter("search_id < 's2' or search_id >= 's4'").select("search_id").collect())
    assert sorted(r.search_id for r in stored.select("search_id").collect()) == again


def test_an_index_is_whole_or_absent(spark, folder):
    docs = spark.range(5)
    docs.write.parquet(f"{folder}/version=lost")          # by a builder that was lost
    assert files.build_index_if_absent(docs, folder).count() == 5
    assert files.build_index_if_absent(spark.range(9), folder).count() == 5


@pytest.mark.parametrize("most", [50_000, 0])
def test_one_quoted_file_is_read_by_many_tasks(spark, folder, monkeypatch, most):
    monkeypatch.setattr(quotedcsv, "MOST_BROADCAST", most)
    cell = lambda i: "line\n" * (i % 5) + f'say ""{i}""' + ("\r\n\n" if i % 7 == 0 else ", x")
    lines = [f'"{i}","{cell(i) if i != 40 else "long " + chr(10) * 3000}",{i * 2}' for i in range(300)]
    text = "ID,content,cost\r\n" + "\r\n".join(lines[:150]) + "\n\n" + "\n".join(lines[150:])
    fs, _ = commits._files(spark, folder)
    stream_ = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/one.csv"), False)
    stream_.write(bytearray(text.encode()))
    stream_.close()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_records_csv(spark, f"{folder}/one.csv", "ID long, content string, cost string")
        got = {r.ID: (r.content, r.cost) for r in rows.collect()}
        assert quotedcsv._lines(spark, f"{folder}/one.csv").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plain = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    assert got == {int(i): (content, cost) for i, content, cost in plain} and len(got) == 300


def test_csv_columns_are_found_by_name(spark, folder):
    spark.createDataFrame([("c", "NA", "7", "x")], "cost string, URL string, ID string, more string").write.csv(
        folder, header=True)
    got = files.read_records_csv(spark, folder, "ID long, title string, cost string, URL string").collect()
    assert [tuple(r) for r in got] == [(7, None, "c", None)]


def test_shared_folder_needs_no_local_folder(spark):
    assert shared_folder(spark).startswith(("file:", "hdfs:", spark.conf.get("spark.checkpoint.dir", "file:")))


def test_a_late_search_counts_and_a_repeat_does_not(spark, folder):
    def send(*rows):
        full(spark.createDataFrame(list(rows), SEARCH)).write.mode("append").parquet(f"{folder}/in")

    send(("a", "q", at(20), 2, "summary", "y"), ("b", "q", at(21), 2, "summary", "y"))
    rows = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    stream.keep_daily(rows, f"{folder}/out")
    send(("late", "q", at(10), 1, "summary", None), ("a", "q", at(20), 2, "summary", "y"),
         ("b", "q", at(22), 2, "summary", "y"))
    got = stream.keep_daily(rows, f"{folder}/out").collect()
    assert sorted((r.search_date.day, r.total_searches) for r in got) == [(10, 1), (20, 1), (21, 1)]


def test_three_batches_equal_the_batch_rollup(spark, folder):
    """Late, repeated and null ids; days that a batch does not touch are not written again."""
    rows = [[("a", "q", at(20), 2, "summary", "y"), ("b", "r", at(21), 2, "summary", "y"), (None, "n", at(20), 5, "detailed", None)],
            [("late", "q", at(3), 1, "summary", None), ("a", "q", at(20), 2, "summary", "y"), (None, "n", at(20), 5, "detailed", None)],
            [("b", "r", at(21), 2, "summary", "y"), ("c", "z", at(3), 4, "detailed", "n"), ("d", "z", None, 4, "detailed", "n")]]
    schema = full(spark.createDataFrame([], SEARCH)).schema
    stream_of = lambda: spark.readStream.schema(schema).parquet(f"{folder}/in")
    names = []
    for part in rows:
        full(spark.createDataFrame(part, SEARCH)).write.mode("append").parquet(f"{folder}/in")
        daily = stream.keep_daily(stream_of(), f"{folder}/daily")
        table = stream.run_available(stream.dedupe_searches(stream_of()), f"{folder}/table")
        names.append({(r.day, r.name) for r in spark.read.parquet(f"{folder}/daily/daily").select(
            F.col("day"), F.input_file_name().alias("name")).collect()})
    once = spark.createDataFrame([*rows[0], rows[1][0], rows[1][2], rows[2][1], rows[2][2]], SEARCH)
    wanted = log.daily_analytics(full(once).filter("timestamp IS NOT NULL"))
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, wanted.collect()))
    assert sorted((str(r.search_id), r.query) for r in table.collect()) == sorted(
        (str(r.search_id), r.query) for r in once.collect())
    kept = {n for d, n in names[1] if d.day == 20}
    assert kept <= {n for _, n in names[2]}          # the third batch has nothing of day 20
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_hits_of_requests_move_without_the_places(spark, tmp_path):
    from placesearch.plans import inputs
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, id AS user_id, 'view' AS event_type, 1.5D AS value, "
              "'{\"k\": 2}' AS props FROM range(3)").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS s_suppkey, 'S' || id AS s_name, id AS s_nationkey, 64D * id AS s_acctbal FROM range(5)").write.parquet(
        f"{tmp_path}/supplier.parquet")
    made = inputs.requests(spark, str(tmp_path))
    moved = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
    assert moved and not any("content" in x for x in moved)
    row = made.filter("event_id = 1").first()
    assert [(r["rank"], r.ID, r.Restaurant, r.similarity_score) for r in row.results] == [
        (i, (7 + 13 * i) % 5, f"S{(7 + 13 * i) % 5}", 1.5 + i / 64) for i in (1, 2, 3)]
    assert row.results[0].content == "Known for plate 0.\nOpen since 1000" and row.results[0].long == 0.0

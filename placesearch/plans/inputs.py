"""Input tables of the registered queries, derived from the tables at hand.

Each derivation keeps every row of its source.  Holes and defects are put into rows by a rule
on their key, they never remove rows.  ``SQL`` states the same derivations for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.functions.lexicon import BOOK_STATES
from placesearch.session import spread

STATES = tuple(BOOK_STATES)[:25]            # one per nation key
REGIONS = ("Deep South", "Great Plains", "Mid-Atlantic", "Mid-South", "Midwest", "New England",
           "Southwest", "West Coast")
EVERYWHERE = 500_000                        # suppliers that every task may have, at most: about 40 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values, index: str) -> str:
    return f"({sql_list(values)})[1 + ({index})]"


# --- line texts: documents with layout marks put in -------------------------------------------

def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; every line gets a layout mark by its number and the document key."""
    def mark(line: Column, i: Column) -> Column:
        kind = (F.col("doc_id") + i) % 16
        return (F.when(kind == 0, F.concat(F.lit("? "), line))
                .when(kind == 1, F.concat(F.lit("  \t"), line))
                .when(kind == 2, F.upper(F.replace(line, F.lit("ß"), F.lit("ss"))))
                .when(kind == 3, F.concat(F.lit("555-010-2222 "), line))
                .when(kind == 4, F.concat(F.lit("LD "), line, F.lit(" $$ later $")))
                .when(kind == 5, F.lit("www.Place.com/menu_1/"))
                .when(kind == 6, F.lit("  Texas "))
                .when(kind == 7, F.lit("NEW MEXICO"))
                .when(kind == 8, F.concat(F.lit("“"), line, F.lit("” it’s ‘so’")))
                .when(kind == 9, F.lit("No phone tonight"))
                .when(kind == 10, F.lit("(limited hours) noon $$$$"))
                .when(kind == 11, F.lit("  "))
                .when(kind == 12, F.lit(" $$ "))
                .when(kind == 13, F.lit("B.J."))
                .otherwise(line))

    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))


SQL_LINE_TEXTS = """
line_texts AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
    CASE (doc_id + i - 1) % 16
      WHEN 0 THEN '? ' || line
      WHEN 1 THEN '  ' || chr(9) || line
      WHEN 2 THEN upper(replace(line, 'ß', 'ss'))
      WHEN 3 THEN '555-010-2222 ' || line
      WHEN 4 THEN 'LD ' || line || ' $$ later $'
      WHEN 5 THEN 'www.Place.com/menu_1/'
      WHEN 6 THEN '  Texas '
      WHEN 7 THEN 'NEW MEXICO'
      WHEN 8 THEN '“' || line || '” it’s ‘so’'
      WHEN 9 THEN 'No phone tonight'
      WHEN 10 THEN '(limited hours) noon $$$$'
      WHEN 11 THEN '  '
      WHEN 12 THEN ' $$ '
      WHEN 13 THEN 'B.J.'
      ELSE line END), chr(10)) AS text
  FROM documents)
"""


# --- guidebook texts: ten customers make one book ----------------------------------------------

def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each place as they will be written into a book."""
    key = F.col("c_custkey")
    number = F.lpad((key % 10000).cast("string"), 4, "0")
    return table(spark, sf_dir, "customer").select(
        key.alias("key"),
        F.floor(key / 10).alias("doc_id"),
        F.upper("c_name").alias("title"),
        F.concat(F.lit("www.place"), key, F.lit(".com")).alias("url"),
        F.when(key % 11 != 0, F.concat((key + 1).cast("string"), F.lit(" Main St. Town, "),
                                       pick(STATES, F.col("c_nationkey")))).alias("address"),
        F.when(key % 3 != 0, F.concat(F.lit("555-010-"), number)).alias("phone"),
        F.when(key % 13 == 0, F.concat(F.lit("555-011-"), number)).alias("phone2"),
        F.when(key % 2 == 0, "LD | $$").otherwise("LD limited $\n$$$").alias("hours_lines"),
        F.when(key % 7 != 0, F.concat(
            F.lit("Run by the "), F.lower("c_mktsegment"), F.lit(" trade.\n\n  Worth   the trip "),
            F.lit("for no. "), key)).alias("prose"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidebook texts of ten places each, ``(doc_id, text)``."""
    entry = F.concat_ws("\n", "title", "url", "address", "phone", "phone2", "hours_lines",
                        "prose")
    return (places(spark, sf_dir).groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("key", entry.alias("entry")))).alias("e"))
            .select("doc_id", F.concat(
                F.lit("Texas\nABOUT the book\n"),
                F.array_join(F.transform("e", lambda x: x["entry"]), "\n")).alias("text")))


SQL_PLACES = f"""
places AS (
  SELECT c_custkey AS key, c_custkey // 10 AS doc_id, upper(c_name) AS title,
    'www.place' || c_custkey || '.com' AS url,
    CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey + 1) || ' Main St. Town, '
      || {sql_pick(STATES, 'c_nationkey')} END AS address,
    CASE WHEN c_custkey % 13 = 0 THEN '555-011-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
         WHEN c_custkey % 3 <> 0 THEN '555-010-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
         END AS phone,
    c_custkey % 13 = 0 AND c_custkey % 3 <> 0 AS two_phones,
    CASE WHEN c_custkey % 2 = 0 THEN 'LD |' ELSE 'LD limited $' END AS hours,
    CASE WHEN c_custkey % 2 = 0 THEN '$$' ELSE '$$$' END AS cost,
    CASE WHEN c_custkey % 7 <> 0 THEN 'Run by the ' || lower(c_mktsegment) || ' trade.'
      || chr(10) || 'Worth the trip for no. ' || c_custkey END AS content,
    row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS n
  FROM customer)
"""


# --- directory: suppliers as geocoded places ---------------------------------------------------

def place_columns(key: Column, name: Column, nation: Column, balance: Column) -> list[Column]:
    """The columns of the directory, from those of a supplier."""
    return [
        key.alias("ID"), name.alias("Restaurant"),
        F.concat(F.lit("www.place"), key, F.lit(".com")).alias("URL"),
        F.concat((key + 1).cast("string"), F.lit(" Main St.")).alias("Address"),
        F.concat(F.when(key % 4 == 0, "Port ").otherwise(""), F.lit("Town"),
                 (key % 40).cast("string")).alias("City"),
        pick(STATES, nation).alias("State"),
        pick(REGIONS, nation % 8).alias("Region"),
        F.when(key % 3 != 0, F.lit("555-010-0000")).alias("phone"),
        F.lit("LD").alias("hours"),
        F.when(key % 3 == 1, "n").when(key % 3 == 2, "y").alias("Crossout"),
        F.when(key % 5 == 0, "y").when(key % 5 == 1, "n").alias("Honor Roll"),
        F.when(key % 4 == 0, "y").when(key % 4 == 1, "n").alias("Recommend"),
        (balance / 64).alias("long"), (balance / 128).alias("lat"),
        F.substring(F.md5(key.cast("string")), 1, 6).alias("geohash"),
        F.when(key % 6 != 0, F.concat(F.lit("dish no. "), key)).alias("sig_item"),
        F.concat(F.lit("Known for plate "), key, F.lit(".\nOpen since "), key + 1000)
        .alias("content")]


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geocoded directory in the layout of the linked records."""
    return table(spark, sf_dir, "supplier").select(
        *place_columns(*map(F.col, ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))))


SQL_DIRECTORY = f"""
directory AS (
  SELECT s_suppkey AS "ID", s_name AS "Restaurant", 'www.place' || s_suppkey || '.com' AS "URL",
    (s_suppkey + 1) || ' Main St.' AS "Address",
    CASE WHEN s_suppkey % 4 = 0 THEN 'Port ' ELSE '' END || 'Town' || s_suppkey % 40 AS "City",
    {sql_pick(STATES, 's_nationkey')} AS "State",
    {sql_pick(REGIONS, 's_nationkey % 8')} AS "Region",
    CASE WHEN s_suppkey % 3 <> 0 THEN '555-010-0000' END AS phone, 'LD' AS hours,
    CASE s_suppkey % 3 WHEN 1 THEN 'n' WHEN 2 THEN 'y' END AS "Crossout",
    CASE s_suppkey % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'n' END AS "Honor Roll",
    CASE s_suppkey % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'n' END AS "Recommend",
    s_acctbal / 64 AS long, s_acctbal / 128 AS lat,
    substr(md5(s_suppkey::VARCHAR), 1, 6) AS geohash,
    CASE WHEN s_suppkey % 6 <> 0 THEN 'dish no. ' || s_suppkey END AS sig_item,
    'Known for plate ' || s_suppkey || '.' || chr(10) || 'Open since ' || (s_suppkey + 1000)
      AS content
  FROM supplier)
"""


# --- search log: events as searches ------------------------------------------------------------

def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished search requests with 1 to 10 results each; ``request_id`` tells them apart."""
    key = F.col("event_id")
    found = F.col("found")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"), F.col("props").alias("query"),
        F.concat(F.lit("run-"), key).alias("langsmith_run_id"),
        F.when(key % 3 == 0, '{"State":{"$in":["TX"]}}').alias("filter_applied"),
        (key % 2 == 0).alias("article"), "event_type", "value",
        (F.get_json_object("props", "$.k").cast("int") % 10 + 1).alias("found"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    count = suppliers.count()
    place_key = lambda rank: (key * 7 + rank * 13) % count
    hits = events.select(
        "event_id", "value", F.explode(F.sequence(F.lit(1), found)).alias("rank")).withColumn(
        "s_suppkey", place_key(F.col("rank")))
    if count <= EVERYWHERE:
        suppliers = F.broadcast(suppliers)

    def result(hit: Column) -> Column:
        place = place_columns(place_key(hit["rank"]).cast(suppliers.schema["s_suppkey"].dataType),
                              hit["s_name"], hit["s_nationkey"], hit["s_acctbal"])
        return F.struct(hit["rank"].alias("rank"), *place,
                        (F.abs(hit["value"]) + hit["rank"] / 64).alias("similarity_score"))

    # hits move with what their place is made of and their search does not tell, and once, as one list per
    # search, while the suppliers fit in every task; the places are made where the lists are
    results = (hits.join(suppliers, "s_suppkey").groupBy("event_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "s_name", "s_nationkey", "s_acctbal", "value"))).alias("hits"))
        .select("event_id", F.transform("hits", result).alias("results")))
    return events.drop("value", "found").join(results, "event_id").withColumn("request_id", key)


SQL_REQUESTS = SQL_DIRECTORY + """,
requests AS (
  SELECT event_id, ts::TIMESTAMP AS "timestamp", user_id::VARCHAR AS user_id, props AS query,
    'run-' || event_id AS langsmith_run_id,
    CASE WHEN event_id % 3 = 0 THEN '{"State":{"$in":["TX"]}}' END AS filter_applied,
    event_id % 2 = 0 AS article, event_type, value,
    (props->>'$.k')::INT % 10 + 1 AS found
  FROM events),
hits AS (
  SELECT event_id, "timestamp", value, unnest(range(1, found + 1))::INT AS rank FROM requests),
results AS (
  SELECT h.event_id, h."timestamp", h.rank, abs(value) + h.rank / 64.0::DOUBLE AS similarity_score, d.*
  FROM hits h JOIN directory d ON d."ID" = (event_id * 7 + h.rank * 13) % (SELECT count(*) FROM supplier))
"""


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows under readable ids, with feedback by event type."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.md5(F.concat(F.lit("s"), key)).alias("id"),
        F.md5(key.cast("string")).alias("search_id"), F.col("props").alias("query"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("run-"), key).alias("langsmith_run_id"),
        F.when(key % 3 == 0, '{"State":{"$in":["TX"]}}').alias("filter_applied"),
        (F.get_json_object("props", "$.k").cast("int") % 10 + 1).alias("num_results"),
        F.when(key % 2 == 0, "summary").otherwise("detailed").alias("search_type"),
        F.when(F.col("event_type") == "purchase", "y").when(F.col("event_type") == "error", "n")
        .alias("feedback_success"),
        F.when(F.col("event_type") == "error", "slow").alias("feedback_reason"),
        F.col("ts").cast("timestamp").alias("created_at"))


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rows for lineitems: each line is a hit of the search with its order's number."""
    n = table(spark, sf_dir, "events").count()
    lines = table(spark, sf_dir, "lineitem")
    places = directory(spark, sf_dir)
    return lines.join(places, F.col("l_suppkey") == F.col("ID")).select(
        F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
                          F.col("l_shipdate").cast("string"))).alias("id"),
        F.md5((F.col("l_orderkey") % (n + 7)).cast("string")).alias("search_id"),
        F.col("ID").cast("string").alias("restaurant_id"),
        F.col("Restaurant").alias("restaurant_name"), F.col("City").alias("city"),
        F.col("State").alias("state"), F.col("Region").alias("region"),
        F.col("Honor Roll").alias("honor_roll"), F.col("Recommend").alias("recommend"),
        F.lit(None).cast("string").alias("relevant"),
        F.lit(None).cast("double").alias("adjusted_score"), F.col("long").alias("longitude"),
        F.col("lat").alias("latitude"), "sig_item", F.col("URL").alias("url"),
        F.col("l_discount").alias("similarity_score"), F.col("l_linenumber").alias("rank"),
        F.lit("{}").alias("metadata"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"))


SQL_LOG = SQL_DIRECTORY + """,
search_log AS (
  SELECT md5('s' || event_id) AS id, md5(event_id::VARCHAR) AS search_id, props AS query,
    ts::TIMESTAMP AS "timestamp", user_id::VARCHAR AS user_id, 'run-' || event_id AS langsmith_run_id,
    CASE WHEN event_id % 3 = 0 THEN '{"State":{"$in":["TX"]}}' END AS filter_applied,
    (props->>'$.k')::INT % 10 + 1 AS num_results,
    CASE WHEN event_id % 2 = 0 THEN 'summary' ELSE 'detailed' END AS search_type,
    CASE event_type WHEN 'purchase' THEN 'y' WHEN 'error' THEN 'n' END AS feedback_success,
    CASE event_type WHEN 'error' THEN 'slow' END AS feedback_reason
  FROM events),
score_log AS (
  SELECT md5((l_orderkey % ((SELECT count(*) FROM events) + 7))::VARCHAR) AS search_id,
    l_orderkey, "ID"::VARCHAR AS restaurant_id, "Restaurant" AS restaurant_name, "City" AS city,
    "State" AS state, "Region" AS region, "Honor Roll" AS honor_roll, "Recommend" AS recommend,
    NULL::VARCHAR AS relevant, NULL::DOUBLE AS adjusted_score, long AS longitude, lat AS latitude,
    sig_item, l_discount AS similarity_score, l_linenumber AS rank, "URL" AS url,
    md5(concat_ws('-', l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate::TIMESTAMP::VARCHAR)) AS hit_id,
    strftime(l_shipdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') AS hit_created_at
  FROM lineitem JOIN directory ON l_suppkey = "ID")
"""


# --- linkage: parts as guidebook rows and as a directory -----------------------------------------

def guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidebook rows: exact, reordered, misspelt and unknown names by key; some lack a state."""
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    turned = F.concat(F.get(words, F.lit(1)), F.lit(" "), F.get(words, F.lit(0)))
    title = (F.when(key % 4 == 0, F.concat(F.substring(turned, 1, 2), F.substring(turned, 4, 99)))
             .when(key % 4 == 1, F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("  ")))
             .when(key % 4 == 2, turned)
             .otherwise(F.concat(F.lit("Zq "), F.lower("p_type"))))
    state = pick(STATES, F.regexp_extract("p_brand", r"\d+", 0).cast("int") % 25)
    town = F.concat((key + 1).cast("string"), F.lit(" Main St. Town"))
    return table(spark, sf_dir, "part").select(
        key.alias("row_id"), title.alias("title"), F.lit("www.part.com").alias("URL"),
        F.when(key % 17 == 0, town).when(key % 5 == 0, F.concat(town, F.lit(", "), state,
                                                                F.lit(" 02920")))
        .when(key % 5 == 1, F.concat(town, F.lit(", "), state, F.lit(" (rear)")))
        .otherwise(F.concat(town, F.lit(", "), state)).alias("address"),
        F.lit("555-010-0000").alias("phone"), F.lit("LD").alias("hours"),
        F.lit("$").alias("cost"), F.col("p_type").alias("content"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory sheet of the same parts; a third of the names carry an extra word."""
    key = F.col("p_partkey")
    state = pick(STATES, F.regexp_extract("p_brand", r"\d+", 0).cast("int") % 25)
    return table(spark, sf_dir, "part").select(
        key.alias("row_no"), (key * 10).alias("ID"),
        F.when(key % 3 == 0, F.concat(F.initcap("p_name"), F.lit(" "), F.initcap("p_type")))
        .otherwise(F.initcap("p_name")).alias("Restaurant"),
        F.when(key % 17 != 0, state).alias("State"),
        F.concat(F.lit("Town"), key % 40).alias("City"),
        F.concat(key + 1, F.lit(" Main St.")).alias("Address"),
        F.when(key % 7 != 0, pick(REGIONS, key % 8)).alias("Region"),
        F.when(key % 3 == 1, "n").when(key % 3 == 2, "y").alias("Crossout"),
        F.when(key % 5 == 0, "y").alias("Honor Roll"),
        F.when(key % 4 == 0, "y").alias("Recommend"),
        F.col("p_retailprice").alias("long"), (F.col("p_retailprice") / 2).alias("lat"),
        F.substring(F.md5(key.cast("string")), 1, 6).alias("geohash"),
        F.when(F.col("p_size") % 3 != 0, "y").when(F.col("p_size") % 2 == 0, "n")
        .alias("10th Ed."))


_STATE_OF_BRAND = sql_pick(STATES, "regexp_extract(p_brand, '[0-9]+')::INT % 25")

SQL_LINKAGE = f"""
guide AS (
  SELECT p_partkey AS row_id, CASE p_partkey % 4
      WHEN 0 THEN substr(turned, 1, 2) || substr(turned, 4)
      WHEN 1 THEN ' ' || chr(9) || upper(p_name) || '  '
      WHEN 2 THEN turned ELSE 'Zq ' || lower(p_type) END AS title,
    'www.part.com' AS "URL", (p_partkey + 1) || ' Main St. Town'
      || CASE WHEN p_partkey % 17 = 0 THEN '' ELSE ', ' || st || CASE p_partkey % 5
        WHEN 0 THEN ' 02920' WHEN 1 THEN ' (rear)' ELSE '' END END AS address_full,
    '555-010-0000' AS phone, 'LD' AS hours, '$' AS cost, p_type AS content,
    CASE WHEN p_partkey % 17 <> 0 THEN st END AS "State"
  FROM (SELECT *, string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS turned,
    {_STATE_OF_BRAND} AS st FROM part)),
sheet AS (
  SELECT p_partkey AS row_no, p_partkey * 10 AS "ID", list_aggregate(list_transform(string_split(
      CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || lower(p_type) ELSE p_name END, ' '),
      lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS "Restaurant",
    CASE WHEN p_partkey % 17 <> 0 THEN {_STATE_OF_BRAND} END AS "State",
    'Town' || p_partkey % 40 AS "City", (p_partkey + 1) || ' Main St.' AS "Address",
    CASE WHEN p_partkey % 7 <> 0 THEN {sql_pick(REGIONS, 'p_partkey % 8')} END AS "Region",
    CASE p_partkey % 3 WHEN 1 THEN 'n' WHEN 2 THEN 'y' END AS "Crossout",
    CASE WHEN p_partkey % 5 = 0 THEN 'y' END AS "Honor Roll",
    CASE WHEN p_partkey % 4 = 0 THEN 'y' END AS "Recommend",
    p_retailprice AS long, p_retailprice / 2 AS lat,
    substr(md5(p_partkey::VARCHAR), 1, 6) AS geohash,
    CASE WHEN p_size % 3 <> 0 THEN 'y' WHEN p_size % 2 = 0 THEN 'n' END AS "10th Ed."
  FROM part)
"""


# --- records with derived fields, and answers to the questions about them -------------------------

def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records; some derived fields are filled, some empty, some null."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        key.alias("row_id"), F.concat(F.lit("Place "), key).alias("Restaurant"),
        F.col("text").alias("content"),
        F.when(key % 4 == 0, F.concat(F.lit("old dish "), key)).when(key % 4 == 1, "")
        .alias("sig_item"),
        F.when(key % 8 == 0, F.concat(F.lit("old question "), key)).alias("summary_q"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per document: fenced, bare, broken, without a key, or no object."""
    key = F.col("doc_id")
    both = F.concat(F.lit('{"signature_item": "dish '), key,
                    F.lit(' \\"x\\"", "summary_question": "Where, '), "lang", F.lit('?"}'))
    text = (F.when(key % 10 == 3, F.substring(both, 1, 20))
            .when(key % 10 == 5, F.concat(F.lit('{"signature_item": "only '), key, F.lit('"}')))
            .when(key % 10 == 7, F.concat(F.lit("["), both, F.lit("]")))
            .otherwise(both))
    return table(spark, sf_dir, "documents").select(
        key.alias("row_id"), F.when(key % 2 == 0, F.concat(F.lit(" ```json\n"), text,
                                                           F.lit("\n``` \n")))
        .otherwise(text).alias("answer"))


SQL_ENRICHED = """
enriched AS (
  SELECT doc_id AS row_id, 'Place ' || doc_id AS "Restaurant", text AS content, lang,
    CASE doc_id % 4 WHEN 0 THEN 'old dish ' || doc_id WHEN 1 THEN '' END AS sig_item,
    CASE WHEN doc_id % 8 = 0 THEN 'old question ' || doc_id END AS summary_q FROM documents),
parsed AS (
  SELECT doc_id AS row_id, doc_id % 10 NOT IN (3, 7) AS parsed,
    CASE WHEN doc_id % 10 IN (3, 7) THEN NULL WHEN doc_id % 10 = 5 THEN 'only ' || doc_id
      ELSE 'dish ' || doc_id || ' "x"' END AS sig_item,
    CASE WHEN doc_id % 10 IN (3, 7) THEN NULL WHEN doc_id % 10 = 5 THEN ''
      ELSE 'Where, ' || lang || '?' END AS summary_q FROM documents)
"""


# --- training examples: turns and the turns after them --------------------------------------------

def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a row with its successor as the completion."""
    talk = table(spark, sf_dir, "conversations")
    after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"),
                        F.col("text").alias("content"), F.col("role").alias("next_role"))
    key = F.col("conv_id") * 1000 + F.col("turn")
    return talk.join(after, ["conv_id", "turn"], "left").select(
        key.alias("example_id"), F.col("text").alias("summary_q"), "content", "role", "next_role",
        F.when(key % 3 == 1, "n").when(key % 3 == 2, "y").alias("Crossout"))


FULL_MESSAGE = ('{"role":"assistant","content":"Enjoy!","name":"bo","function_call":{"name":"f"},'
                '"weight":1}')


def chat_lines(spark: SparkSession, sf_dir: str, defects: bool = True) -> DataFrame:
    """One JSON line per turn: system, the turn and its successor; defects by key, or none."""
    def message(role, text):
        return F.to_json(F.struct(role.alias("role"), text.alias("content")))

    kind = F.col("example_id") % 13 if defects else F.lit(0)
    first = (F.when(kind == 1, '{"role":"user","content":"a b","mood":"sad"}')
             .when(kind == 2, '{"role":"robot","content":"a"}')
             .when(kind == 3, '{"role":"user","content":5}')
             .when(kind == 7, '{"role":"user"}')
             .when(kind == 8, '{"role":"function","content":"","function_call":{"name":"f"}}')
             .when(kind == 9, '{"role":"user","content":"","name":"bob"}')
             .when(kind == 10, '{"role":null,"content":null}')
             .otherwise('{"role":"system","content":"Be brief, please."}'))
    messages = F.concat_ws(",", first, message(F.col("role"), F.col("summary_q")),
                           F.when(F.col("content").isNotNull(),
                                  message(F.col("next_role"), F.col("content"))),
                           F.lit(None).cast("string") if defects else
                           F.when(F.col("example_id") % 2 == 0, FULL_MESSAGE).otherwise(
                               '{"role":"assistant","content":"Enjoy!"}'))
    line = (F.when(kind == 4, '{"messages":[]}').when(kind == 5, "[1, 2]")
            .when(kind == 6, '{"message":"hi"}').when(kind == 11, '{"messages":')
            .otherwise(F.concat(F.lit('{"messages":['), messages, F.lit("]}"))))
    return turns(spark, sf_dir).select("example_id", line.alias("value"))


SQL_TURNS = """
turns AS (
  SELECT c.conv_id * 1000 + c.turn AS example_id, c.text AS summary_q, n.text AS content, c.role,
    n.role AS next_role, CASE (c.conv_id * 1000 + c.turn) % 3 WHEN 1 THEN 'n' WHEN 2 THEN 'y' END
      AS "Crossout", (c.conv_id * 1000 + c.turn) % 13 AS kind
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)
"""


# --- queries in words, and documents with places ----------------------------------------------------

PHRASES = (
    "West Virginia", "la", "Hawaii", "OK", "the Lone Star State", "the Pacific Northwest",
    "the Southeast and the south", "New England and the South", "the Mid-Atlantic", "NY state",
    "the Mid-West", "Washington DC", "the East Coast", "the Deep South", "the Northeast",
    "Southern States", "Kansas or Arkansas", "Massachusetts", "my home town", "New York and Ohio",
    "the Pacific Coast", "jersey", "in or me hi", "Show Me State", "Eastern Seaboard", "WA and OR",
    "South Dakota, ND", "the great plains", "mid south", "good old cheesehead country")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per event, with a vector and a stored classifier answer."""
    key, user = F.col("event_id"), F.col("user_id")
    phrase = pick(PHRASES, key % len(PHRASES))
    town = F.concat(F.lit("Town"), user % 45)
    text = (F.when(key % 3 == 0, F.concat(F.lit("Best pie in "), phrase, F.lit(" near "), town,
                                          F.lit("?")))
            .when(key % 3 == 1, F.concat(phrase, F.lit(" BBQ ftw")))
            .otherwise(F.concat(F.lit("Where to eat? "), phrase, F.lit(" or Port "), town,
                                F.lit(", "), pick(STATES, user % 25))))
    vectors = table(spark, sf_dir, "embeddings")
    answer = (F.when(key % 5 == 0, "IN_SCOPE").when(key % 5 == 1, " in_scope, surely")
              .when(key % 5 == 2, "OUT_OF_SCOPE").when(key % 5 == 3, "Error"))
    n = vectors.count()
    return spread(table(spark, sf_dir, "events").select("event_id", "user_id")).select(
        key.alias("query_id"), text.alias("text"), answer.alias("answer"),
        (key % n).alias("vec_id")).join(
            vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def placed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        key.alias("doc_id"), "embedding",
        F.concat(F.when(key % 4 == 0, "Port ").otherwise(""), F.lit("Town"), key % 40)
        .alias("City"),
        F.when(key % 29 != 0, pick(STATES, key % 25)).alias("State"),
        pick(REGIONS, key % 8).alias("Region"))


SQL_ASKED = f"""
asked AS (
  SELECT event_id AS query_id, CASE event_id % 3
    WHEN 0 THEN 'Best pie in ' || phrase || ' near Town' || user_id % 45 || '?'
    WHEN 1 THEN phrase || ' BBQ ftw'
    ELSE 'Where to eat? ' || phrase || ' or Port Town' || user_id % 45 || ', '
      || {sql_pick(STATES, 'user_id % 25')} END AS text,
    CASE event_id % 5 WHEN 0 THEN 'IN_SCOPE' WHEN 1 THEN ' in_scope, surely'
      WHEN 2 THEN 'OUT_OF_SCOPE' WHEN 3 THEN 'Error' END AS answer,
    event_id % (SELECT count(*) FROM embeddings) AS vec_id
  FROM (SELECT *, {sql_pick(PHRASES, f'event_id % {len(PHRASES)}')} AS phrase FROM events)),
placed AS (
  SELECT vec_id AS doc_id, embedding,
    CASE WHEN vec_id % 4 = 0 THEN 'Port ' ELSE '' END || 'Town' || vec_id % 40 AS "City",
    CASE WHEN vec_id % 29 <> 0 THEN {sql_pick(STATES, 'vec_id % 25')} END AS "State",
    {sql_pick(REGIONS, 'vec_id % 8')} AS "Region"
  FROM embeddings)
"""


def city_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of cities as a caller may pass them: empty, repeated, without a state."""
    key = F.col("event_id")
    town = F.concat(F.lit("Town"), F.col("user_id"))

    def city(name, state=None):
        return F.struct(name.alias("city"), F.lit(state).cast("string").alias("state"))

    cities = (F.when(key % 5 == 0, F.array().cast("array<struct<city:string,state:string>>"))
              .when(key % 5 == 1, F.array(city(town, "TX")))
              .when(key % 5 == 2, F.array(city(town, "TX"), city(F.upper(town), "tx"),
                                          city(F.lit("Port"))))
              .when(key % 5 == 3, F.array(city(town), city(F.lower(town), ""), city(town, "MD"))))
    return table(spark, sf_dir, "events").select(key.alias("query_id"), cities.alias("cities"))


def condition_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted conditions with repeats that differ in key order only."""
    key = F.col("event_id")
    town = F.concat(F.lit('"Town'), F.col("user_id"), F.lit('"'))
    a = F.concat(F.lit('{"State": "TX", "City": '), town, F.lit("}"))
    b = F.concat(F.lit('{"City":'), town, F.lit(',"State":"TX"}'))
    c, d = F.lit('{"Region":{"$in":["b","a"]}}'), F.lit('{"Region": {"$in": ["a", "b"]}}')
    conditions = (F.when(key % 4 == 0, F.array().cast("array<string>"))
                  .when(key % 4 == 1, F.array(a, b)).when(key % 4 == 2, F.array(c, a, c, b))
                  .otherwise(F.array(d, c, d)))
    return table(spark, sf_dir, "events").select(key.alias("query_id"),
                                                 conditions.alias("conditions"))

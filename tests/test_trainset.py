"""Training sets and enrichment bookkeeping."""

import json

import pytest
from pyspark.sql import functions as F

from placesearch.operators import enrich as en, trainset as tr


def lengths(spark, n, tokens=10):
    return spark.range(n).select(F.col("id").alias("example_id"), F.lit(3).alias("n_messages"),
                                 F.lit(tokens).alias("n_tokens"),
                                 F.lit(2).alias("n_assistant_tokens"))


@pytest.mark.parametrize("n, epochs", [(10, 10), (2, 25), (33, 3), (34, 3), (250, 3), (10000, 2),
                                       (30000, 1)])
def test_epochs(spark, n, epochs):
    row = tr.training_cost(lengths(spark, n, 20000)).first()
    assert (row.epochs, row.tokens) == (epochs, n * tr.MAX_TOKENS)


def test_empty_set_gives_nothing(spark):
    assert tr.training_cost(lengths(spark, 0)).count() == tr.distribution(lengths(spark, 0)).count() == 0


@pytest.mark.parametrize("n, test", [(250, 50), (7, 2), (1, 1), (0, 0), (1000, 200)])
def test_split_is_exact_disjoint_and_repeatable(spark, n, test):
    rows = spark.range(n)
    split = tr.train_test_split(rows, "id")
    assert split.filter("split = 'test'").count() == test and split.count() == n
    again = tr.train_test_split(rows.repartition(3), "id")
    assert split.join(again, ["id", "split"]).count() == n


def test_sample(spark):
    assert tr.seeded_sample(spark.range(100), "id", 30).distinct().count() == 30
    assert tr.seeded_sample(spark.range(10), "id", 30).count() == 10


def test_split_counts(spark):
    parts = spark.range(250).withColumn("split", F.when(F.col("id") < 199, "train").otherwise("test"))
    assert tr.split_counts_ok(parts, 250).first().ok
    assert not tr.split_counts_ok(parts.filter("id > 5"), 250).first().ok


@pytest.mark.parametrize("line, errors", [
    ('[1]', {"data_type": 1}), ('"x"', {"data_type": 1}), ("null", {"data_type": 1}),
    ("{bad", {"unreadable_line": 1}), ("{}", {"missing_messages_list": 1}),
    ('{"messages":null}', {"missing_messages_list": 1}),
    ('{"messages":[{"role":"assistant","content":"a"}]}', {}),
    ('{"messages":[{"role":"user","content":"a"}]}', {"example_missing_assistant_message": 1}),
    ('{"messages":[{"role":"assistant"}]}', {"message_missing_key": 1, "missing_content": 1}),
    ('{"messages":[{"role":"assistant","content":5,"x":1,"y":2}]}',
     {"missing_content": 1, "message_unrecognized_key": 1}),
    ('{"messages":[{"role":"assistant","content":"","function_call":{"n":1}}]}', {}),
    ('{"messages":[{"role":"assistant","content":"","function_call":""}]}', {"missing_content": 1}),
    ('{"messages":[{"role":"assistant","content":null,"function_call":"f"}]}', {"missing_content": 1}),
    ('{"messages":[{"role":"robot","content":"a"},{"role":"assistant","content":"b","name":"n"}]}',
     {"unrecognized_role": 1})])
def test_validation(spark, line, errors):
    lines = spark.createDataFrame([(1, line)], "example_id long, value string")
    assert {r.error: r.n for r in tr.validate_format(lines).collect() if r.n} == errors


def test_token_lengths(spark):
    lines = spark.createDataFrame([(1, json.dumps({"messages": [
        {"role": "system", "content": "Be brief."}, {"role": "assistant", "content": "Yes, sir!",
                                                     "name": "al b"}]}))], "example_id long, value string")
    row = tr.token_lengths(tr.typed_examples(lines)).first()
    assert (row.n_messages, row.n_tokens, row.n_assistant_tokens) == (2, 4 + 3 + 4 + 4 + 3 + 3, 4)
    doubled = tr.token_lengths(tr.typed_examples(lines), lambda t: F.length(t)).first()
    assert doubled.n_assistant_tokens == 9


def test_gate(spark):
    good = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'
    lines = spark.createDataFrame([(1, good), (2, good)], "example_id long, value string")
    values = {r.measure: r.value for r in tr.gated_profile(lines).collect()}
    assert values["examples"] == 2 and values["missing_system"] == 2 and values["epochs"] == 25
    assert tr.gated_profile(lines.union(lines.limit(1).withColumn("value", F.lit("[]")))).count() == 0


def test_eligible(spark):
    rows = spark.createDataFrame([("q", "c", None), ("q", "c", "y"), ("", "c", "n"), ("q", None, "n")],
                                 "summary_q string, content string, Crossout string")
    assert tr.eligible_examples(rows).count() == 1
    assert tr.eligible_examples(rows.drop("Crossout")).count() == 2
    with pytest.raises(ValueError):
        tr.eligible_examples(rows, "absent")


@pytest.mark.parametrize("answer, fields", [
    ('{"signature_item":"pie","summary_question":"where?"}', ("pie", "where?")),
    ('```json\n{"signature_item":"pie"}\n```', ("pie", "")), (' {"signature_item":null} ', ("", "")),
    ('```json {"signature_item":', None), ("[]", None), ("", None), (None, None),
    ('{"signature_item":5}', ("5", ""))])
def test_answers(spark, answer, fields):
    row = en.parse_answers(spark.createDataFrame([(1, answer)], "row_id long, answer string")).first()
    assert ((row.sig_item, row.summary_q) if row.parsed else None) == fields


def test_batches_resume(spark):
    rows = en.ensure_columns(spark.range(5).select(F.col("id").alias("row_id"),
                                                   F.lit("p").alias("Restaurant"),
                                                   F.lit("{name} $1").alias("content")))
    first = en.pending_rows(rows, 2)
    assert [r.row_id for r in first.collect()] == [0, 1]
    prompt = en.build_prompts(first).first().prompt
    assert '"p"' in prompt and "{name} $1" in prompt
    answers = first.select("row_id", F.lit('{"signature_item":"a","summary_question":"b"}').alias("answer"))
    after = en.merge_answers(rows, en.parse_answers(answers))
    assert [r.row_id for r in en.pending_rows(after, 2).collect()] == [2, 3]


def test_bad_answers_do_not_keep_others_waiting(spark):
    rows = en.ensure_columns(spark.range(7).select(F.col("id").alias("row_id")))
    rejected = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 0)], "row_id long")
    assert [r.row_id for r in en.pending_rows(rows, 3, rejected).collect()] == [5, 6, 1]
    assert en.pending_rows(rows).count() == 7


def test_every_value_of_a_message_counts(spark):
    lines = spark.createDataFrame([(1, '{"messages":[{"role":"user","content":"a b"}]}'), (
        2, '{"messages":[{"role":"user","content":"a b","function_call":{"n":"one two"},"weight":1,"name":"x"}]}')],
        "example_id long, value string")
    sizes = {r.example_id: r.n_tokens for r in tr.token_lengths(tr.typed_examples(lines)).collect()}
    assert sizes == {1: 3 + 3 + 3, 2: 9 + 6 + 1 + 2}

"""Chat training sets: choose, split, serialise, validate, profile, estimate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from placesearch.operators.selection import SMALL, first_rows
from placesearch.session import cut_lineage

# Sizes, allowed keys and roles, billing rules.
SAMPLE_SIZE, TEST_SHARE, SEED = 250, 0.2, 42
MESSAGE_KEYS = ("role", "content", "name", "function_call", "weight")
ROLES = ("system", "user", "assistant", "function")
MAX_TOKENS = 16385
TARGET_EPOCHS, MIN_EXAMPLES, MAX_EXAMPLES, MIN_EPOCHS, MAX_EPOCHS = 3, 100, 25000, 1, 25
TOKENS_PER_MESSAGE, TOKENS_PER_NAME, TOKENS_PER_REPLY = 3, 1, 3
ERRORS = ("unreadable_line", "data_type", "missing_messages_list", "message_missing_key",
          "message_unrecognized_key", "unrecognized_role", "missing_content",
          "example_missing_assistant_message")

SYSTEM_PROMPT = "You write for a road-trip food guide. Recommend the restaurants in its style."
MESSAGES = "array<map<string,string>>"    # every key of a message; nested values as JSON text


def eligible_examples(rows: DataFrame, prompt: str = "summary_q",
                      completion: str = "content") -> DataFrame:
    """Rows not crossed out that have both texts."""
    for column in (prompt, completion):
        if column not in rows.columns:
            raise ValueError(f"column {column} is missing")
    rows = rows.fillna("", [prompt, completion])
    if "Crossout" in rows.columns:
        rows = rows.filter(~F.col("Crossout").eqNullSafe("y"))
    return rows.filter((F.col(prompt) != "") & (F.col(completion) != ""))


def hash_order(row_id: str, seed: int = SEED) -> Column:
    """A repeatable random order; ids must be unique."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def _ordered(rows: DataFrame, row_id: str, seed: int) -> DataFrame:
    """``_order``, and its first 60 bits as a number."""
    return rows.withColumn("_order", hash_order(row_id, seed)).withColumn(
        "_key", F.conv(F.substring("_order", 1, 15), 16, 10).cast("long"))


def seeded_sample(rows: DataFrame, row_id: str, n: int = SAMPLE_SIZE,
                  seed: int = SEED) -> DataFrame:
    """``n`` random rows, or all if there are fewer.

    A small sample is each task's ``n`` first rows, merged; for a large one the last hash value that
    belongs to it is found from counts, so rows are neither sorted nor gathered.
    """
    ordered = _ordered(rows, row_id, seed)
    chosen = (ordered.orderBy("_order").limit(n) if n <= SMALL else
              ordered.filter(first_rows(ordered.select("_key", "_order"), "_key", "_order", n)))
    return chosen.drop("_order", "_key")


def to_messages(rows: DataFrame, prompt: str = "summary_q", completion: str = "content",
                system: str = SYSTEM_PROMPT) -> DataFrame:
    """Add ``messages``: system, user, assistant."""
    said = [("system", F.lit(system)), ("user", F.col(prompt)), ("assistant", F.col(completion))]
    return rows.withColumn("messages", F.array(*[
        F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in said]))


def train_test_split(rows: DataFrame, row_id: str, test_share: float = TEST_SHARE,
                     seed: int = SEED) -> DataFrame:
    """Add ``split``: exactly the rounded-up share is ``test``, the rest ``train``.

    The cut is one hash value, found from counts per range of values, so the rows themselves are
    neither sorted nor shuffled.
    """
    ordered = _ordered(rows, row_id, seed)
    n_test = ordered.agg(F.ceil(F.count("*") * F.lit(test_share)).alias("n")).first().n
    test = first_rows(ordered.select("_key", "_order"), "_key", "_order", n_test)
    return ordered.withColumn("split", F.when(test, "test").otherwise("train")).drop("_order", "_key")


def split_counts_ok(split: DataFrame, expected: int, test_share: float = TEST_SHARE) -> DataFrame:
    """Whether existing parts have the expected sizes, give or take one."""
    train = int(expected * (1 - test_share))
    counted = split.agg(F.count_if(F.col("split") == "train").alias("train_rows"),
                        F.count_if(F.col("split") == "test").alias("test_rows"))
    return counted.withColumn("ok", (F.abs(F.col("train_rows") - train) <= 1)
                              & (F.abs(F.col("test_rows") - (expected - train)) <= 1))


# --- validation of JSON lines --------------------------------------------------------------------

def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, key: str) -> Column:
    """A string value of an object; null if it is absent or of another type."""
    value = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(_kind(value) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def _is_filled(v: Column, key: str) -> Column:
    """The value is there and not null, empty, zero or false."""
    value = F.try_variant_get(v, f"$.{key}", "variant")
    plain = F.to_json(value)
    return F.coalesce(~plain.isin("null", '""', "0", "0.0", "false", "[]", "{}"), F.lit(False))


def validate_examples(lines: DataFrame) -> DataFrame:
    """``example_id, value`` (one JSON text per row) -> error counts per example."""
    v = F.col("v")
    loaded = lines.select("example_id", F.try_parse_json("value").alias("v"))
    is_object = F.startswith(_kind(v), F.lit("OBJECT"))
    listed = F.try_variant_get(v, "$.messages", "array<variant>")
    split = loaded.select(
        "example_id", v.isNull().alias("bad"), is_object.alias("is_object"),
        F.when(is_object & (F.size(F.coalesce(listed, F.array().cast("array<variant>"))) > 0),
               listed).alias("messages"))

    def count(condition: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.size(F.filter("messages", condition)), F.lit(0)).cast("long")

    def keys(m: Column) -> Column:
        return F.coalesce(F.json_object_keys(F.to_json(m)), F.array().cast("array<string>"))

    one = {
        "unreadable_line": F.col("bad").cast("long"),
        "data_type": (~F.col("bad") & ~F.col("is_object")).cast("long"),
        "missing_messages_list": (F.col("is_object") & F.col("messages").isNull()).cast("long"),
        "message_missing_key": count(lambda m: ~(F.array_contains(keys(m), "role")
                                                 & F.array_contains(keys(m), "content"))),
        "message_unrecognized_key": count(lambda m: F.size(F.array_except(
            keys(m), F.array(*[F.lit(k) for k in MESSAGE_KEYS]))) > 0),
        "unrecognized_role": count(lambda m: ~F.coalesce(_text(m, "role").isin(*ROLES),
                                                         F.lit(False))),
        "missing_content": count(lambda m: _text(m, "content").isNull()
                                 | ((_text(m, "content") == "") & ~_is_filled(m, "function_call"))),
        "example_missing_assistant_message": (
            F.col("messages").isNotNull()
            & (count(lambda m: _text(m, "role").eqNullSafe("assistant")) == 0)).cast("long"),
    }
    return split.select("example_id", *[
        F.coalesce(c, F.lit(0).cast("long")).alias(name) for name, c in one.items()])


def validate_format(lines: DataFrame) -> DataFrame:
    """``error, n`` over all examples."""
    summed = validate_examples(lines).agg(*[
        F.coalesce(F.sum(e), F.lit(0).cast("long")).alias(e) for e in ERRORS])
    return summed.select(F.inline(F.array(*[
        F.struct(F.lit(e).alias("error"), F.col(e).alias("n")) for e in ERRORS])))


def typed_examples(lines: DataFrame) -> DataFrame:
    """``example_id, messages`` of the lines that hold messages, with every key they have."""
    typed = F.from_json("value", f"struct<messages:{MESSAGES}>")["messages"]
    return lines.select("example_id", typed.alias("messages")).filter(
        F.col("messages").isNotNull())


# --- profile ------------------------------------------------------------------------------------

def _lacks(role: str) -> Column:
    return ~F.exists("messages", lambda m: m["role"].eqNullSafe(role))


def missing_roles(examples: DataFrame) -> DataFrame:
    """Examples without a system and without a user message."""
    return examples.agg(F.count_if(_lacks("system")).alias("missing_system"),
                        F.count_if(_lacks("user")).alias("missing_user"))


def word_tokens(text: Column) -> Column:
    """The default token count: runs of letters and digits, and runs of other signs."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+")), F.lit(0))


def token_lengths(examples: DataFrame, tokens: Callable[[Column], Column] = word_tokens,
                  *extra: Column) -> DataFrame:
    """Messages, tokens and assistant tokens of each example."""
    def total(of: Column, start: int) -> Column:
        return F.aggregate(of, F.lit(start), lambda a, b: a + b)

    def size(m: Column) -> Column:
        # every value counts, whatever its key
        values = F.transform(F.map_values(m), tokens)
        name = F.when(m["name"].isNotNull(), TOKENS_PER_NAME).otherwise(0)
        return total(values, TOKENS_PER_MESSAGE) + name

    messages = F.transform("messages", lambda m: F.from_json(F.to_json(m), "map<string,string>"))
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return examples.select(
        "example_id", F.size(messages).alias("n_messages"),
        total(F.transform(messages, size), TOKENS_PER_REPLY).alias("n_tokens"),
        total(F.transform(said, lambda m: tokens(m["content"])), 0).alias("n_assistant_tokens"),
        *extra)


MEASURES = {"n_messages": "num_messages_per_example", "n_tokens": "num_total_tokens_per_example",
            "n_assistant_tokens": "num_assistant_tokens_per_example"}


SHARES = {"median": 0.5, "p10": 0.1, "p90": 0.9}


def value_counts(lengths: DataFrame, *columns: str) -> DataFrame:
    """``measure, value, n``: how often each value of a column occurs; tasks count before rows move."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value"))
                               for c in columns]))
    return (lengths.select(each.alias("m")).select("m.*").filter("value IS NOT NULL")
            .groupBy("measure", "value").agg(F.count("*").alias("n")))


def spread(counts: DataFrame) -> DataFrame:
    """Extremes, mean and exact quantiles per measure, from running sums over its distinct values.

    A quantile between two rows is weighted by its distance from them.
    """
    rising = Window.partitionBy("measure").orderBy("value")
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = counts.withColumn("upto", F.sum("n").over(rising)).withColumn("rows", F.sum("n").over(whole))

    def at(row: Column) -> Column:
        return F.min(F.when(F.col("upto") > row, F.col("value")))

    def quantile(share: float) -> Column:
        place = F.lit(share) * (F.col("rows") - 1)
        low, high = F.floor(place), F.ceil(place)
        below, above = at(low), at(high)
        distance = F.max(place - low)
        return F.when(below == above, below.cast("double")).otherwise(
            (F.max(high - place)) * below + distance * above)

    return summed.groupBy("measure").agg(
        F.max("rows").alias("rows"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        *[quantile(share).alias(name) for name, share in SHARES.items()])


def distribution(lengths: DataFrame) -> DataFrame:
    """Extremes, mean and quantiles of the three measures; nothing for an empty set."""
    label = F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair])
    kinds = dict(lengths.dtypes)
    kind = "int" if all(kinds[c] == "int" for c in MEASURES) else "long"
    return spread(value_counts(lengths, *MEASURES)).select(
        label[F.col("measure")].alias("measure"), F.col("min").cast(kind).alias("min"),
        F.col("max").cast(kind).alias("max"), "mean", *SHARES)


def _is_too_long() -> Column:
    return F.count_if(F.col("n_tokens") > MAX_TOKENS)


def _billable() -> Column:
    return F.sum(F.least(F.lit(MAX_TOKENS), "n_tokens"))


def _epochs(n: Column) -> Column:
    def div(total: int) -> Column:
        return F.floor(F.lit(total) / n).cast("int")

    return (F.when(n * TARGET_EPOCHS < MIN_EXAMPLES, F.least(F.lit(MAX_EPOCHS), div(MIN_EXAMPLES)))
            .when(n * TARGET_EPOCHS > MAX_EXAMPLES, F.greatest(F.lit(MIN_EPOCHS), div(MAX_EXAMPLES)))
            .otherwise(TARGET_EPOCHS))


def too_long(lengths: DataFrame) -> DataFrame:
    return lengths.agg(_is_too_long().alias("too_long"))


def training_cost(lengths: DataFrame) -> DataFrame:
    """Examples, epochs and billed tokens; nothing for an empty set."""
    summed = lengths.agg(F.count("*").alias("examples"), _billable().alias("tokens"))
    return (summed.filter("examples > 0").withColumn("epochs", _epochs(F.col("examples")))
            .withColumn("billed_tokens", F.col("epochs") * F.col("tokens")))


def profile(examples: DataFrame, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """The whole profile as ``measure, value`` rows, in one pass over the examples."""
    flags = {"no_system": "missing_system", "no_user": "missing_user"}
    lengths = token_lengths(examples, tokens, _lacks("system").alias("no_system"),
                            _lacks("user").alias("no_user"))
    # one row per measure and distinct value is all that is read on
    counts = cut_lineage(value_counts(lengths, *MEASURES, *flags))
    of = lambda measure, value: F.sum(F.when(F.col("measure") == measure, value))
    n, value = F.col("n"), F.col("value")
    whole = counts.agg(
        of("n_tokens", n).alias("examples"), of("n_tokens", F.least(F.lit(MAX_TOKENS), value) * n).alias("tokens"),
        of("n_tokens", F.when(value > MAX_TOKENS, n).otherwise(0)).alias("too_long"),
        *[of(flag, value * n).alias(name) for flag, name in flags.items()]).filter("examples > 0")
    whole = whole.withColumn("epochs", _epochs(F.col("examples"))).withColumn(
        "billed_tokens", F.col("epochs") * F.col("tokens"))
    single = ("examples", "tokens", "epochs", "billed_tokens", "too_long", *flags.values())
    found = whole.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in single])))
    label = F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair])
    spreads = spread(counts.filter(F.col("measure").isin(*MEASURES))).select(F.inline(F.array(*[
        F.struct(F.concat(label[F.col("measure")], F.lit(f"/{c}")).alias("measure"),
                 F.col(c).cast("double").alias("value")) for c in ("min", "max", "mean", *SHARES)])))
    return found.unionByName(spreads)


def gated_profile(lines: DataFrame, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """The profile, only if no line has a format error."""
    errors = validate_format(lines).agg(F.sum("n").cast("double").alias("value")).select(
        F.lit("errors").alias("measure"), "value")
    rows = profile(typed_examples(lines), tokens).unionByName(errors)     # a few rows
    found = F.max(F.when(F.col("measure") == "errors", F.col("value"))).over(
        Window.partitionBy(F.lit(1)))
    return (rows.withColumn("_errors", found)
            .filter((F.col("_errors") == 0) & (F.col("measure") != "errors")).drop("_errors"))

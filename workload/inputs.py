"""The engine's input tables, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.session import scratch_path
from paceline.sources.segments import SegmentStore
from paceline.sources.tables import event_log, read_ordered_log, user_profiles, write_ordered_log
from paceline.sources.user_states import UserStates

PROPERTIES = ["segment", "nation", "region", "balance_band"]


# Declared, so that no job has to look into the files before the first query.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "orders": "o_custkey bigint, o_orderpriority string, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string",
    "conversations": "conv_id bigint, text string",
    "benchmark": "item_id bigint, text string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(_table(spark, sf_dir, "events"), event="event_type")


def click_log_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log as a table partitioned by day."""
    path = scratch_path(spark, "clicks-by-day")
    click_log(spark, sf_dir).withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    return event_log(spark.read.parquet(path), day="day")


def click_log_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log in folders by day, ordered by time."""
    path = scratch_path(spark, "clicks-ordered")
    write_ordered_log(click_log(spark, sf_dir), path)
    return read_ordered_log(spark, path)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(_table(spark, sf_dir, "orders"), user_id="o_custkey", event="o_orderpriority", ts="o_orderdate")


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation, region and a band of their balance."""
    customer, nation, region = (_table(spark, sf_dir, name) for name in ("customer", "nation", "region"))
    band = F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") < 5000, "mid").otherwise("high")
    joined = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .withColumn("balance_band", band)
        .withColumnsRenamed({"c_mktsegment": "segment", "n_name": "nation", "r_name": "region"})
    )
    return user_profiles(joined, PROPERTIES, user_id="c_custkey")


def noisy_click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log as a careless client would send it: every name in one of seven spellings."""
    events = _table(spark, sf_dir, "events")
    name = F.col("event_type")
    length = F.length(name)
    # Left alone, last letter lost, upper case, letter doubled, first letter lost, prefixed, reversed.
    spellings = F.array(
        name,
        F.substring(name, F.lit(1), length - 1),
        F.upper(name),
        F.concat(name, F.substring(name, length, F.lit(1))),
        F.substring(name, F.lit(2), length),
        F.concat(F.lit("web_"), name),
        F.reverse(name),
    )
    return events.select("user_id", F.get(spellings, (F.col("event_id") % 7).cast("int")).alias("event"), "ts")


def noisy_profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(property, value) pairs of a careless client: three spellings of the property, four of the value."""
    pairs = customer_profiles(spark, sf_dir).select(
        "user_id", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("v")) for p in PROPERTIES]))
    )
    length = F.length("v")
    props = F.array(
        F.col("p"), F.concat(F.substring("p", 1, 4), F.substring("p", F.lit(6), F.length("p"))), F.initcap("p")
    )
    values = F.array(
        F.col("v"), F.lower("v"), F.substring("v", F.lit(1), length - 1), F.concat("v", F.lit(" customers"))
    )
    return pairs.select(
        F.get(props, (F.col("user_id") % 3).cast("int")).alias("property"),
        F.get(values, (F.col("user_id") % 4).cast("int")).alias("value"),
    )


def _tokens(table: DataFrame) -> DataFrame:
    return table.select(F.explode(F.split("text", "[ \\n]+")).alias("event")).filter("event <> ''")


def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents and conversations, as they stand there: a dictionary that grows with the tables."""
    parts = [_tokens(_table(spark, sf_dir, name)) for name in ("documents", "conversations")]
    return parts[0].unionByName(parts[1]).distinct()


def misspelt_words(spark: SparkSession, sf_dir: str, dictionary: DataFrame | None = None) -> DataFrame:
    """All words of the benchmark: those that the dictionary (``word_dictionary``, if it is not given) knows with their last letter doubled,
    the unknown ones as they stand."""
    words = _tokens(_table(spark, sf_dir, "benchmark")).distinct()
    known = (word_dictionary(spark, sf_dir) if dictionary is None else dictionary).select("event", F.lit(True).alias("known"))
    damaged = F.when(F.col("known"), F.concat("event", F.substring("event", -1, 1))).otherwise(F.col("event"))
    return words.join(known, "event", "left").select(damaged.alias("event"))


def click_states(spark: SparkSession, sf_dir: str) -> UserStates:
    """The bitmap states of the click log, all days at once."""
    states = UserStates(spark, scratch_path(spark, "click-states"))
    states.add_days(click_log(spark, sf_dir))
    return states


def fresh_store(spark: SparkSession) -> SegmentStore:
    return SegmentStore(spark, scratch_path(spark, "segments"))

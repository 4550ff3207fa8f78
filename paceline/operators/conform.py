"""Correcting misspelt event names, property names and property values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.numeric import round_exact
from paceline.functions.text import best_of_lists
from paceline.operators.similarity import NAME, most_similar
from paceline.session import materialise

LEAST_SCORE = 0.9  # fixed value: similarity from which a match is accepted
LIST_NAMES = 1000  # a dictionary of no more names goes to every task as lists; a larger one is searched through an index


def _known_names(names: DataFrame | Sequence[str], column: str, feed: DataFrame) -> DataFrame:
    """Known names, once each, as ``(kind, known)`` of one kind."""
    if not isinstance(names, DataFrame):
        names = feed.sparkSession.createDataFrame([(str(n),) for n in names], f"`{column}` string")
    listed = names.select(F.lit("").alias("kind"), F.col(column).cast("string").alias("known"))
    return listed.filter(F.col("known").isNotNull()).distinct()


def _short_lists(known: DataFrame) -> dict[str, list[str]] | None:
    """The names of every kind, if they are ``LIST_NAMES`` at most; never more than one beyond that come to the driver."""
    rows = known.limit(LIST_NAMES + 1).collect()
    if len(rows) > LIST_NAMES:
        return None
    lists: dict[str, list[str]] = {}
    for kind, name in rows:
        lists.setdefault(kind, []).append(name)
    return lists


def _accepted(score: str, match: str) -> Column:
    return F.when(F.col(score) >= LEAST_SCORE, F.col(match))


def best_matches(unknown: DataFrame, known: DataFrame, lists: dict[str, list[str]] | None) -> DataFrame:
    """``kind, name, match, score``: the most similar known name of the kind (null, if it is not acceptable) and its score;
    names without any candidate score 0.

    ``unknown`` has distinct ``(kind, name)``, ``known`` distinct ``(kind, known)``; ``lists`` are those of ``_short_lists``.
    """
    if lists is not None:
        return unknown.select(*NAME, best_of_lists(lists)(*NAME).alias("found")).select(*NAME, "found.match", "found.score")
    return most_similar(unknown, known, LEAST_SCORE)


def name_conformance(feed: DataFrame, dictionary: DataFrame | Sequence[str], column: str = "event") -> DataFrame:
    """``(from_name, to_name, score)`` of every unknown name in the feed, once.

    A name is known only in its exact spelling. ``to_name`` is null below the least score. Only the
    distinct unknown names reach Python. With a dictionary of at most ``LIST_NAMES`` names nothing is written or joined.
    """
    known = _known_names(dictionary, column, feed)
    lists = _short_lists(known)
    names = feed.select(F.lit("").alias("kind"), F.col(column).alias("name")).filter(F.col("name").isNotNull())
    if lists is not None:
        unknown = names.filter(~F.col("name").isin(lists.get("", []))).distinct()
    else:
        known = materialise(known, "known-names")  # read by the join and the index
        unknown = names.distinct().join(known.select(F.col("known").alias("name")), "name", "left_anti").select(*NAME)
    return best_matches(unknown, known, lists).select(
        F.col("name").alias("from_name"), _accepted("score", "match").alias("to_name"), round_exact("score", 3).alias("score")
    )


def conformed_event_log(log: DataFrame, dictionary: DataFrame | Sequence[str]) -> DataFrame:
    """The log with accepted corrections applied; other names stay as they are.

    Writes the corrections first. Adaptive execution broadcasts them if they are small; else the log is
    joined by shuffle, where it splits hot names.
    """
    corrections = name_conformance(log, dictionary).filter(F.col("to_name").isNotNull())
    fixed = materialise(corrections.select(F.col("from_name").alias("event"), "to_name"), "corrections")
    rest = [c for c in log.columns if c != "event"]
    return log.join(fixed, "event", "left").select(F.coalesce("to_name", "event").alias("event"), *rest)


def property_conformance(feed: DataFrame, properties: Sequence[str], values: DataFrame) -> DataFrame:
    """``(property, value, to_property, to_value, property_score, value_score)`` for every distinct
    pair in the feed whose property or value is unknown.

    The property is corrected first, and its value checked against the values of the corrected
    property; values of an unknown property are not checked. ``to_*`` is the name to use: the
    known one, the accepted match, or null if nothing was accepted. Scores are null for known names.
    """
    rows = values.select("property", "value").filter(F.col("value").isNotNull()).distinct()
    pairs = feed.select("property", "value").filter(F.col("property").isNotNull() & F.col("value").isNotNull()).distinct()

    corrected = name_conformance(pairs, [str(p) for p in properties], "property").select(
        F.col("from_name").alias("property"), F.col("to_name").alias("prop_match"), F.col("score").alias("property_score")
    )
    typed = pairs.join(corrected, "property", "left").withColumn(
        "to_property", F.when(F.col("property_score").isNull(), F.col("property")).otherwise(F.col("prop_match"))
    )
    known_pairs = rows.select(F.col("property").alias("to_property"), "value", F.lit(True).alias("known"))
    checked = materialise(typed.join(known_pairs, ["to_property", "value"], "left"), "checked-values")
    # Only values that are unknown, of a property that has a dictionary, are scored.
    open_values = checked.filter(F.col("known").isNull()).select(F.col("to_property").alias("kind"), F.col("value").alias("name")).distinct()
    listed = rows.select(F.col("property").alias("kind"), F.col("value").alias("known")).filter(F.col("kind").isNotNull())
    open_values = open_values.join(listed.select("kind").distinct(), "kind", "left_semi")
    scored = best_matches(open_values, listed, _short_lists(listed)).select(
        F.col("kind").alias("to_property"), F.col("name").alias("value"), _accepted("score", "match").alias("value_match"),
        round_exact("score", 3).alias("value_score"),
    )
    return (
        checked.join(scored, ["to_property", "value"], "left")
        .filter(F.col("property_score").isNotNull() | F.col("value_score").isNotNull())
        .select(
            "property",
            "value",
            "to_property",
            F.when(F.col("value_score").isNull(), F.col("value")).otherwise(F.col("value_match")).alias("to_value"),
            "property_score",
            "value_score",
        )
    )

"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as sequences of lower-case words; the edit bound is one word replaced, inserted or deleted, for lines of
five words or more (so that four fifths agree), and none for shorter ones. A line goes if an earlier line lies within the
bound; "earlier" is by ``doc_id``, then line number.

Equal lines are first reduced to one. Two lines one edit apart share their first or their last half (of the longer one), so
only lines with a half that some other line has are taken further; this drops no pair. Those emit a hashed key for
the line itself and for each line that deleting one word leaves:

* equal keys from deleting the *same* position: the lines differ in that word at most, all of them from each other, so
  each is compared with the earliest alone;
* a key equal to a whole line's: that line is the other without one word; a key meets one such line.

Both joins are linear in the number of keys, however many lines share one. Every link is then verified on the words: common
prefix and suffix must cover all but one word.

Defined cases: null and empty texts and lines without a word have no lines to compare; rows with one ``doc_id`` are one
document, so a repeated row repeats nothing; a null ``doc_id`` comes first; an empty table gives an empty table; other
columns are ignored; lines of any length are read to the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import bitmap, passes
from paceline.session import materialise

LEAST_WORDS = 5
LINE = ["h1", "h2"]


def line_words(docs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """doc_id, line_no and the words of every line that has one; of those at the given places (and a few others) alone, if there are such."""
    lines = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line_no", F.col("line_no").cast("long"))
    if places is not None:
        lines = lines.filter(passes(F.xxhash64("doc_id", "line_no"), bitmap(places.select(F.xxhash64("doc_id", "line_no").alias("hash")))))
    plain = F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}\p{N}]+", " ")).alias("plain")
    return lines.select("doc_id", "line_no", plain).filter("plain <> ''").withColumn("words", F.split("plain", " "))


def halves() -> Column:
    """Hashes of the first and last words of a line, as many as half a line of its length or one word longer has."""
    n = F.size("words")

    def both(m: Column) -> list[Column]:
        head, tail = F.slice("words", F.lit(1), m), F.slice("words", n - m + 1, m)
        return [F.xxhash64(F.lit(side), m, F.array_join(part, " ")) for side, part in (("head", head), ("tail", tail))]

    found = F.array_distinct(F.array(*both(F.floor(n / 2).cast("int")), *both(F.floor((n + 1) / 2).cast("int"))))
    return F.when(n >= LEAST_WORDS, found).otherwise(F.array().cast("array<bigint>"))


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, words and the 128-bit address (h1, h2) of every line."""
    return line_words(docs).select("doc_id", "line_no", "words", F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(1), "plain").alias("h2"))


def sharing_halves(lines: DataFrame) -> DataFrame:
    """Addresses of the lines of which some other line has a half."""
    each = lines.select(*LINE, F.explode("halves").alias("half"))
    shared = each.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("half")
    shared = materialise(shared, "halves")
    return each.filter(passes(F.col("half"), bitmap(shared))).join(shared, "half", "left_semi").select(*LINE).distinct()


def deletion_keys(lines: DataFrame) -> DataFrame:
    """h1, h2, first, gone, key: one row for each word of a line, with the hash of the line without it.

    A line's hash is the exclusive or of its words hashed with their positions; words after the gap move up by one.
    """
    words = lines.select(*LINE, "first", F.posexplode("words").alias("gone", "word"))
    upto = Window.partitionBy(*LINE).orderBy("gone")
    before, upto_here = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(Window.unboundedPreceding, 0)
    placed = words.select(*LINE, "first", "gone", F.xxhash64("word", "gone").alias("here"), F.xxhash64("word", F.col("gone") - 1).alias("moved"))
    left = F.coalesce(F.bit_xor("here").over(before), F.lit(0).cast("long"))
    right = F.bit_xor("moved").over(Window.partitionBy(*LINE)).bitwiseXOR(F.bit_xor("moved").over(upto_here))
    return placed.select(*LINE, "first", "gone", left.bitwiseXOR(right).alias("key"))


def whole_key() -> Column:
    """The hash of a line as it is, by the rule of ``deletion_keys``."""
    return F.aggregate(F.transform("words", lambda w, i: F.xxhash64(w, i)), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def candidate_links(lines: DataFrame) -> DataFrame:
    """h1, h2 of a line and to_h1, to_h2 of another that shares a key with it; the earlier one is ``to``.

    Keys that no other line has are told from counts of their hashes and go first.
    """
    target = F.struct("first", *LINE)
    keys = deletion_keys(lines)
    wholes = lines.select(whole_key().alias("key"), target.alias("to"))
    both = F.xxhash64("key", "gone")
    repeated = keys.select(both.alias("hash")).groupBy("hash").count().filter("count > 1").select("hash")
    keys = keys.filter(passes(both, bitmap(repeated)) | passes(F.col("key"), bitmap(wholes.select("key"))))
    keys = materialise(keys, "keys")
    earliest = keys.groupBy("key", "gone").agg(F.min(target).alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "gone", "to")
    earliest = materialise(earliest, "earliest")
    replaced = keys.join(earliest, ["key", "gone"]).select(target.alias("of"), "to")
    shortened = keys.select("key", target.alias("of")).join(wholes, "key")
    ordered = shortened.select(F.greatest("of", "to").alias("of"), F.least("of", "to").alias("to"))
    pairs = replaced.unionByName(ordered).filter("of > to").distinct()
    return pairs.select(*[F.col(f"of.{c}").alias(c) for c in LINE], *[F.col(f"to.{c}").alias(f"to_{c}") for c in LINE])


def within_one_word(a: str, b: str) -> Column:
    """Whether common prefix and suffix of two word arrays cover all but one word of the longer."""

    def shared(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        at = F.array_position(same, F.lit(False))
        return F.when(at == 0, F.size(same)).otherwise(at - 1)

    longer = F.greatest(F.size(a), F.size(b))
    return shared(F.col(a), F.col(b)) + shared(F.reverse(a), F.reverse(b)) >= longer - 1


def near_duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no of every line to remove, the place of the earliest line within the bound, and the edits (0 or 1).

    The addresses of all lines are written once; the words of those taken further are read from the documents again.
    """
    lines = materialise(addressed(docs).withColumn("halves", halves()).drop("words"), "lines")
    place = F.struct("doc_id", "line_no")
    reduced = lines.groupBy(*LINE).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    chosen = materialise(reduced.join(sharing_halves(lines), LINE).select(*LINE, "first"), "chosen-lines")
    # Lines are brought to their normal form once for their addresses, and again only where a chosen line stands first.
    texts = line_words(docs, chosen.select("first.*")).withColumn("h1", F.xxhash64("plain"))
    spelt = (
        texts.select("doc_id", "line_no", "plain", "h1", F.xxhash64(F.lit(1), "plain").alias("h2"))
        .join(chosen.select(F.col("first.doc_id").alias("at_id"), F.col("first.line_no").alias("line_no"), *LINE, "first"), ["line_no", *LINE])
        .filter(F.col("doc_id").eqNullSafe(F.col("at_id")))
        .select(*LINE, "first", F.split("plain", " ").alias("words"))
        .dropDuplicates(LINE)
    )
    spelt = materialise(spelt, "candidate-lines")
    links = candidate_links(spelt)
    of, to = spelt.select(*LINE, F.col("words").alias("a")), spelt.select(*[F.col(c).alias(f"to_{c}") for c in LINE], "first", F.col("words").alias("b"))
    verified = links.join(of, LINE).join(to, ["to_h1", "to_h2"]).filter(within_one_word("a", "b"))
    nearest = verified.groupBy(*LINE).agg(F.min("first").alias("near"))
    # Written, so that the occurrences of a very common line are dealt out for the last join alone and can be split.
    verdicts = materialise(reduced.join(nearest, LINE, "left").filter("last > first or near is not null"), "verdicts")
    return (
        lines.filter(passes(F.col("h1"), bitmap(verdicts.select("h1"))))
        .join(verdicts, LINE)
        .withColumn("to", F.when(F.col("near").isNotNull(), F.least("first", "near")).otherwise(F.col("first")))
        .filter(place > F.col("to"))
        .select(
            "doc_id", "line_no", F.col("to.doc_id").alias("kept_doc_id"), F.col("to.line_no").alias("kept_line_no"),
            F.when(F.col("to") < F.col("first"), 1).otherwise(0).cast("long").alias("edits"),
        )
        .distinct()
    )


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without the removed lines."""
    gone = removed.groupBy(F.col("doc_id").alias("_of_id")).agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_of_id"]), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("_gone"), i.cast("long"))), "\n")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)

"""Shards of near-equal bytes by histogram sort, in DataFrame operations only.

Documents are ordered by (digest of the text, digest of ``doc_id``, place in the scan), so equal texts lie side by side. Shard
borders, the splitters, are found without sorting: a round cuts each key range that is still open into ``probes`` parts, counts the exact
bytes and rows below every part's border across all partitions, and keeps only the part that holds the wanted byte. A range
shrinks to the keys that occur in it, first within the text digests, then, for a text that is too large for the tolerance, within its
``doc_id`` digests, and last within the places of repeated rows. What a round leaves is at most one range a splitter.

A splitter stands at the border of a group of equal texts if the nearest one is within ``tolerance_permille`` thousandths of a mean
shard, else at the nearest border of a row; so a group is cut only where keeping it whole would cost the balance. After the last
round rows are exchanged once, by ranges of (shard, key). A task gets a range, not a whole shard; a row's
slot in its shard is its number in the range, and the numbers of rows in the ranges before.

Defined cases: a null text has no bytes and is digested like the empty text; a null ``doc_id`` is digested like an empty string;
repeated rows are kept, and may be cut apart; ties in both digests are ordered by place; with fewer rows than shards some shards are
empty; an empty table gives an empty table; other columns are passed on, and added columns get underscores in front if their name is taken.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import div, free_name, whole_text
from paceline.session import materialise

LEVELS = ("text_key", "id_key", "place")
DIGEST_END, PLACE_END = 1 << 60, (1 << 63) - 1
OUTPUTS = ("size", "text_crc32", "shard", "slot")
OVERHEAD = 16  # bytes that a document counts beside its text

Key = tuple[int, int, int]


@dataclass(frozen=True)
class OpenRange:
    """Keys from ``low`` to before ``high`` that hold a wanted byte; ``level`` is the part of the key that is being narrowed."""

    level: int
    low: Key
    high: Key
    below: int


def digest(value: Column) -> Column:
    """The first 60 bits of the md5 of a string, as a number that is not negative."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, size, text_crc32, text_key, id_key, place): the columns to pass on lie in ``row``, so that no name can clash."""
    text = whole_text()
    return docs.select(
        F.struct(*columns).alias("row"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        digest(text).alias("text_key"),
        digest(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id_key"),
        F.monotonically_increasing_id().alias("place"),
    )


def key_of(values: Key) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(name) for v, name in zip(values, LEVELS, strict=True)])


def borders_upto(borders: list[Key]) -> Column:
    """How many of the ascending borders are not above a row's key, by halving."""
    if not borders:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    listed, key = F.array(*map(key_of, borders)), F.struct(*LEVELS)

    def further(at: Column, step: Column) -> Column:
        to = at + step
        return F.when((to <= len(borders)) & (F.get(listed, to - 1) <= key), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def counted(keys: DataFrame, ranges: list[OpenRange], goals: list[tuple[int, int]], scale: int, probes: int) -> dict[int, dict]:
    """For each goal (byte times ``scale``, number of its range) the part that holds it: what lies below, its size, rows and least and
    largest key of every level. Comes as one row a goal, however many rows and parts there are."""
    at = borders_upto([r.low for r in ranges]) - 1
    numbers = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    inside = keys.withColumn("range", at).filter((F.col("range") >= 0) & (F.struct(*LEVELS) < F.get(F.array(*[key_of(r.high) for r in ranges]), F.col("range"))))
    value = F.get(F.array(*LEVELS), F.get(F.array(*[F.lit(r.level) for r in ranges]), F.col("range")))
    first = F.get(numbers(r.low[r.level] for r in ranges), F.col("range"))
    width = F.get(numbers(max(1, -(-(r.high[r.level] - r.low[r.level] + 1) // probes)) for r in ranges), F.col("range"))
    ends = [f(name).alias(f"{side}_{name}") for name in LEVELS for side, f in (("least", F.min), ("most", F.max))]
    parts = inside.groupBy("range", div(value - first, width).alias("part")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *ends)
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = parts.withColumn("below", before + F.get(numbers(r.below for r in ranges), F.col("range")))
    wanted = F.array(*[F.struct(F.lit(k).alias("goal"), F.lit(goal).cast("long").alias("byte"), F.lit(of).alias("of")) for k, (goal, of) in enumerate(goals)])
    hit = (F.col("want.of") == F.col("range")) & (F.col("want.byte") >= F.col("below") * scale) & (F.col("want.byte") < (F.col("below") + F.col("bytes")) * scale)
    found = laid.withColumn("want", F.explode(F.filter(wanted, lambda w: w["of"] == F.col("range")))).filter(hit)
    return {r["want"]["goal"]: r.asDict() for r in found.collect()}


def splitters(keys: DataFrame, shards: int, tolerance_permille: int = 1, probes: int = 4096) -> list[Key]:
    """The least keys of shards 1, 2, ...: ascending, at most one a border; a row is in the last shard whose splitter is not above its key."""
    total = keys.agg(F.sum("size").alias("bytes")).first()["bytes"]
    if total is None:
        return []
    goals, settled = {i: i * total for i in range(1, shards)}, {}
    whole = OpenRange(0, (0, 0, 0), (DIGEST_END, 0, 0), 0)
    held = dict.fromkeys(goals, whole)
    while held:
        ranges = sorted(set(held.values()), key=lambda r: r.low)
        asked = [(goals[i], ranges.index(held[i])) for i in held]
        hits = counted(keys, ranges, asked, shards, probes)
        held = {i: narrowed(hits[k], held[i], goals[i], shards, Fraction(tolerance_permille * total, 1000)) for k, i in enumerate(held)}
        settled |= {i: x for i, x in held.items() if not isinstance(x, OpenRange)}
        held = {i: x for i, x in held.items() if isinstance(x, OpenRange)}
    return [settled[i] for i in sorted(settled)]


def narrowed(hit: dict, was: OpenRange, goal: int, scale: int, tolerance: Fraction) -> Key | OpenRange:
    """The splitter, if the part that holds the wanted byte is a row, or a group whose border is near enough; else what to search next."""
    least, most = (tuple(hit[f"{side}_{name}"] for name in LEVELS) for side in ("least", "most"))
    level, below, after = was.level, hit["below"], hit["below"] + hit["bytes"]
    to_start, to_end = goal - below * scale, after * scale - goal
    if least[level] < most[level]:
        high = (most[0] + 1, 0, 0) if level == 0 else (least[0], most[1] + 1, 0) if level == 1 else (*least[:2], most[2] + 1)
        return OpenRange(level, (*least[: level + 1], 0, 0)[:3], high, below)
    if hit["n"] == 1 or level == 0 and min(to_start, to_end) <= tolerance:
        ends = [(least[0] + 1, 0, 0), (least[0], least[1] + 1, 0), (*least[:2], least[2] + 1)]
        starts = [(least[0], 0, 0), (*least[:2], 0), least]
        return starts[level] if to_start <= to_end else ends[level]
    if level == 0:
        return OpenRange(1, (*least[:2], 0), (least[0], most[1] + 1, 0), below)
    return OpenRange(2, least, (*least[:2], most[2] + 1), below)


def shard_documents(
    docs: DataFrame, shards: int = 40, columns: list[str] | None = None, tolerance_permille: int = 1, probes: int = 4096
) -> DataFrame:
    """The documents with ``size``, ``text_crc32``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without gaps, in the shard).

    ``columns`` are passed on, by default all. The rows lie in files of the shared folder, in the order of shard and slot.
    """
    columns = docs.columns if columns is None else columns
    rows = materialise(keyed(docs, columns), "keyed-documents")
    borders = splitters(rows.select("size", *LEVELS), shards, tolerance_permille, probes)
    order = ["shard", *LEVELS]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("shard", borders_upto(borders)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id that counts rows holds the number of the range in its upper bits; written, so that it stands.
    dealt = materialise(dealt.select("row", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "sorted-documents")
    part = F.shiftright("at", 33)
    starts = dealt.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each border between shards or ranges at most.
    starts = F.broadcast(starts.select(F.col("shard").alias("of_shard"), "part", (before - F.col("first")).alias("shift")))
    placed = dealt.join(starts, (F.col("shard") == F.col("of_shard")) & (part == F.col("part")))
    taken = docs.select(*columns)
    added = [F.col("size"), F.col("text_crc32"), F.col("shard").cast("int"), F.col("at") + F.col("shift")]
    return placed.select(*[F.col("row").getField(c).alias(c) for c in columns], *[c.alias(free_name(taken, name)) for c, name in zip(added, OUTPUTS, strict=True)])


def write_shards(docs: DataFrame, path: str, shards: int = 40, **settings: int) -> None:
    """Parquet files at ``path``, a folder ``shard=N`` for each shard; the rows of a file are in the order of their slots."""
    shard_documents(docs, shards, **settings).write.partitionBy(free_name(docs, "shard")).parquet(path)
